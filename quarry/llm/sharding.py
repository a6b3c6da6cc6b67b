"""Operator 7: consistent-hash ring with virtual nodes and bounded loads.

The ring has ``POINTS`` points.  Each shard owns ``VNODES`` of them, placed by
hash; a row falls on the point that its key hashes to and belongs to the next
virtual node clockwise.  A shard holds ``ceil`` or ``floor`` of the mean row
count (the law ``rows``); keys that overflow a full shard go on clockwise to
the next virtual node whose shard has room.

Only counts per ring point leave the tasks.  Since the ring has a fixed number
of points, the walk over them is small and the same for any table size: it
turns into runs ("rows 120 to 340 of this arc go to shard 7, from slot 5 on"),
and every row finds its run by its rank on its point.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import scan, text_of
from quarry.llm.registry import llm_query
from quarry.operators.ordinal import with_ordinal
from quarry.session import materialize

SHARDS = 40
VNODES = 64
POINTS = 1 << 16
#: Rows of a point that one task ranks, at least; more than this and ``HOT_TIMES`` the mean are ranked by ranges.
HOT_ROWS, HOT_TIMES = 10_000, 16
#: Bytes that a row takes beside its text.
ROW_BYTES = 16


def ring(shards: int, vnodes: int = VNODES, points: int = POINTS) -> list[tuple[int, int]]:
    """Sorted ``(point, shard)`` of all virtual nodes, one at most on a point.

    A node's place depends on its shard and number alone; when places
    collide the smaller shard has it and the other moves on clockwise, so a
    further shard takes points only from the free ones."""
    taken: dict[int, int] = {}
    for shard in range(shards):
        for v in range(vnodes):
            at = int.from_bytes(hashlib.md5(f"shard {shard} node {v}".encode()).digest()[:8], "big") % points
            while at in taken:
                at = (at + 1) % points
            taken[at] = shard
    return sorted(taken.items())


def arc_of_points(nodes: list[tuple[int, int]], points: int = POINTS) -> list[int]:
    """For each point, the index of the first virtual node at or after it, clockwise."""
    places = [p for p, _ in nodes]
    return [bisect_left(places, p) % len(places) for p in range(points)]


def capacities(rows: int, shards: int) -> list[int]:
    """Row bounds of the shards: their sum is ``rows``, and they differ by one at most."""
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def place(counts: list[int], nodes: list[tuple[int, int]], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Runs ``(arc, first rank, past rank, shard, slot of the first)``.

    ``counts`` has the rows of each arc.  First every arc fills its own shard,
    in ring order; what is over walks clockwise, in ring order, to the next
    shard with room."""
    free, used, runs, over = list(room), [0] * len(room), [], []

    def take(arc: int, rank: int, n: int, shard: int) -> int:
        n = min(n, free[shard])
        if n:
            runs.append((arc, rank, rank + n, shard, used[shard]))
            free[shard] -= n
            used[shard] += n
        return n

    for arc, n in enumerate(counts):
        done = take(arc, 0, n, nodes[arc][1])
        if done < n:
            over.append((arc, done, n))
    for arc, rank, n in over:
        step = arc
        while rank < n:
            step = (step + 1) % len(nodes)
            rank += take(arc, rank, n - rank, nodes[step][1])
    return runs


def ring_point(id_: Column, instead: Column, points: int = POINTS) -> Column:
    """The point that a row's key hashes to; rows without id use ``instead``."""
    key = F.when(id_.isNotNull(), F.xxhash64(id_)).otherwise(F.xxhash64(instead))
    return F.pmod(key, F.lit(points)).cast("int")


def ranked_on_points(rows: DataFrame, order: list[str], on_point: dict[int, int]) -> DataFrame:
    """``rows`` with ``_n``, the rank on their point from 0 on.

    Points that hold very many rows (one id again and again) are numbered by
    ranges over the cluster, in the same order; rows alike are spread by a
    number of their own."""
    bound = max(HOT_ROWS, HOT_TIMES * sum(on_point.values()) // POINTS)
    hot, before = [], 0
    for point in sorted(on_point):
        if on_point[point] > bound:
            hot.append((point, before))
            before += on_point[point]
    alone = Window.partitionBy("_point").orderBy(*order)
    number = F.row_number().over(alone).cast("long") - 1
    if not hot:
        return rows.withColumn("_n", number)
    # Fewer than POINTS / HOT_TIMES rows.
    hot = F.broadcast(rows.sparkSession.createDataFrame(hot, "_point int, _before long"))
    spread = rows.join(hot, "_point").withColumn("_own", F.monotonically_increasing_id())
    spread = with_ordinal(spread, ["_point", *order, "_own"], name="_n").withColumn("_n", F.col("_n") - F.col("_before"))
    rest = rows.join(hot, "_point", "left_anti").withColumn("_n", number)
    return rest.unionByName(spread.select(*rest.columns))


def shard_by_ring(
    docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", vnodes: int = VNODES
) -> DataFrame:
    """One row per input row: id, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard``.

    The law is ``rows``: counts of any two shards differ by one at most.
    ``size`` is the text's UTF-8 bytes (null: none) plus 16.  Slots count from
    0 in each shard without gaps.  The key is the id (for a null id the
    text's checksum, so that rows without id spread too).  Ties on a point
    are ordered by id, checksum and size; rows alike in all three are
    interchangeable, and repeated rows take a slot each.  An empty table
    gives an empty result.  Other columns are not read.  ``grown_shard`` is
    null, as it belongs to the law ``key``.
    """
    if not 0 < shards * vnodes <= POINTS:
        raise ValueError(f"the ring has room for {POINTS} virtual nodes")
    spark = docs.sparkSession
    text = text_of(text_col)
    # The rows without their texts: read for the counts and again for the result.
    rows = materialize(
        docs.select(
            F.col(id_col).alias(id_col),
            (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
        ).withColumn("_point", ring_point(F.col(id_col), F.col("text_crc32")))
    )
    # At most POINTS rows, whatever the table's size.
    on_point = {r["_point"]: r["n"] for r in rows.groupBy("_point").agg(F.count(F.lit(1)).alias("n")).collect()}
    nodes = ring(shards, vnodes)
    arcs = arc_of_points(nodes)
    on_arc, first_rank = [0] * len(nodes), {}
    # An arc may begin before point 0; its ranks follow the points' numbers all the same.
    for point in sorted(on_point):
        first_rank[point] = on_arc[arcs[point]]
        on_arc[arcs[point]] += on_point[point]
    runs = place(on_arc, nodes, capacities(sum(on_arc), shards))
    by_arc: dict[int, list] = {}
    for arc, *run in runs:
        by_arc.setdefault(arc, []).append(tuple(run))
    targets = spark.createDataFrame(
        [(p, first_rank[p], by_arc[arcs[p]]) for p in on_point],
        "_point int, _first long, _runs array<struct<first:long,past:long,shard:int,slot:long>>",
    )
    ranked = (
        ranked_on_points(rows, [id_col, "text_crc32", "size"], on_point)
        .join(F.broadcast(targets), "_point")
        .withColumn("_n", F.col("_n") + F.col("_first"))
        .withColumn("_run", F.filter("_runs", lambda r: (r["first"] <= F.col("_n")) & (F.col("_n") < r["past"]))[0])
    )
    return ranked.select(
        id_col, "size", "text_crc32", F.lit("rows").alias("law"), F.col("_run.shard").alias("shard"),
        (F.col("_run.slot") + F.col("_n") - F.col("_run.first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


@llm_query("op7_sharding")
def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in 40 shards of equal row counts."""
    return shard_by_ring(scan(spark, sf_dir).select("doc_id", "text"))
