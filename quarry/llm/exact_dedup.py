"""Operator 8: exact de-duplication with a heavy-hitter split.

Equal texts have equal SHA-256 digests of the normalised text.  Only digests
and ids move:

1. every task summarises its digests with ``counters`` Misra-Gries counters
   (a digest held by more than ``n / (counters + 1)`` rows always survives,
   wherever its rows lie); the summaries are added up and pruned again;
2. the surviving candidates, at most ``counters`` of them, are counted exactly
   (partial aggregation), and those that are frequent indeed are broadcast:
   their rows are settled on the map side and never shuffled;
3. the other digests, each of which is rare by the same guarantee, go through
   an ordinary shuffle by digest.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import SPACE, free_names, scan, text_of
from quarry.llm.registry import llm_query
from quarry.operators.joins import bounded_broadcast
from quarry.session import materialize

COUNTERS = 1024
#: Rows up to which the list of dropped documents is broadcast (about 100 bytes each).
BROADCAST_ROWS = 100_000


def text_digest(text_col: str) -> Column:
    """SHA-256, in lowercase hex, of the text with each run of white space as one space."""
    return F.sha2(F.regexp_replace(text_of(text_col), SPACE, " ").cast("binary"), 256)


def prune(counts: dict, counters: int) -> dict:
    """Misra-Gries: subtract the (counters + 1)-th largest count, keep what is above zero."""
    if len(counts) <= counters:
        return counts
    cut = sorted(counts.values(), reverse=True)[counters]
    return {k: n - cut for k, n in counts.items() if n > cut}


def _summaries(counters: int):
    def run(batches):
        held: dict = {}
        for batch in batches:
            for x in pc.value_counts(batch.column(0)).to_pylist():
                held[x["values"]] = held.get(x["values"], 0) + x["counts"]
            held = prune(held, counters)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())],
            names=["digest", "n"],
        )

    return run


def frequent_digests(digests: DataFrame, id_col: str, digest_col: str, counters: int = COUNTERS) -> list:
    """Rows ``(digest, smallest id, count)`` of the frequent digests, at most ``counters``."""
    summed = (
        digests.select(digest_col)
        .mapInArrow(_summaries(counters), "digest string, n long")
        .groupBy("digest")
        .agg(F.sum("n").alias("n"))
    )
    top = summed.orderBy(F.desc("n"), "digest").limit(counters + 1).collect()
    candidates = list(prune({r["digest"]: r["n"] for r in top}, counters))
    if not candidates:
        return []
    spark = digests.sparkSession
    wanted = F.broadcast(spark.createDataFrame([(d,) for d in candidates], f"{digest_col} string"))
    exact = (
        digests.join(wanted, digest_col)
        .groupBy(digest_col)
        .agg(F.min(id_col).alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    )
    floor = max(2, digests.count() // (counters + 1))
    return [tuple(r) for r in exact.filter(F.col("group_size") >= floor).collect()]


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS
) -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Null counts as the empty text; texts are equal when identical after each
    run of white space becomes one space.  The smallest id of a group stays;
    a null id is never smallest unless the whole group has none.  Repeated
    rows (same id and text) count each in ``group_size`` and share one
    verdict, since the id names the row.  An empty table gives an empty
    result; other columns of ``docs``, whatever their names, are not read.
    """
    spark = docs.sparkSession
    digests = materialize(
        docs.select(F.col(id_col).alias(id_col), text_digest(text_col).alias("text_sha256"))
    )
    heavy = frequent_digests(digests, id_col, "text_sha256", counters)
    kind = digests.schema[id_col].dataType.simpleString()
    winners = spark.createDataFrame(heavy, f"text_sha256 string, keep_id {kind}, group_size long")
    by_digest = Window.partitionBy("text_sha256")
    settled = digests.join(F.broadcast(winners), "text_sha256")
    rest = (
        digests.join(F.broadcast(winners.select("text_sha256")), "text_sha256", "left_anti")
        .withColumn("keep_id", F.min(id_col).over(by_digest))
        .withColumn("group_size", F.count(F.lit(1)).over(by_digest))
    )
    cols = [id_col, "keep_id", "group_size", F.col(id_col).eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"]
    return settled.select(*cols).unionByName(rest.select(*cols))


def one_of_each(rows: DataFrame, keys: list[str], row_col: str) -> DataFrame:
    """One row for each value of ``keys``: the struct ``row_col`` whose JSON text comes
    first.  Partial aggregation, so a hot key costs one row per task."""
    return rows.groupBy(*keys).agg(F.min_by(row_col, F.to_json(row_col)).alias(row_col))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text an earlier id holds; all columns stay.

    Of rows alike in id and text (repeated rows, or a group in which no row has
    an id) one stays, by the order of their JSON texts.  Columns of any names
    may stand beside the two."""
    ruled_id, ruled_text = free_names(docs, "_ruled", "_ruled_text")
    copies = exact_dedup(docs, id_col, text_col).filter("group_size > 1")
    ruled = copies.select(F.col(id_col).alias(ruled_id), F.col("text_sha256").alias(ruled_text), F.col("kept").alias("_kept"))
    ruled = ruled.groupBy(ruled_id, ruled_text, "_kept").agg(F.count(F.lit(1)).alias("_n"))
    ruled = materialize(ruled.filter("NOT _kept OR _n > 1"))
    same = F.col(id_col).eqNullSafe(F.col(ruled_id)) & (text_digest(text_col) == F.col(ruled_text))
    gone = bounded_broadcast(ruled.select(ruled_id, ruled_text), BROADCAST_ROWS)
    alone = docs.join(gone, same, "left_anti")
    repeated = ruled.filter("_kept").select(ruled_id, ruled_text)
    if repeated.isEmpty():
        return alone
    repeated = bounded_broadcast(repeated, BROADCAST_ROWS)
    held = docs.join(repeated, same, "left_semi").select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
        F.col(id_col).alias("_id"), text_digest(text_col).alias("_digest"),
    )
    return alone.unionByName(one_of_each(held, ["_id", "_digest"], "_row").select("_row.*"))


@llm_query(
    "op8_exact_dedup",
    r"""
    WITH t AS (
        SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body
        FROM documents
    ), d AS (SELECT doc_id, sha256(body) AS text_sha256 FROM t)
    SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           doc_id = min(doc_id) OVER w AS kept, text_sha256
    FROM d WINDOW w AS (PARTITION BY text_sha256)
    """,
)
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicates among all whole texts of ``documents``."""
    return exact_dedup(scan(spark, sf_dir).select("doc_id", "text"))
