import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from conftest import SF_SMALL
from helpers import ODD, empty_table, odd_table, rows_of
from pyspark.sql import functions as F
from quarry.llm import mixing, sharding
from quarry.llm.mixing import mix, mixed_documents, source_targets
from quarry.llm.registry import ORACLE, QUERIES
from quarry.llm.sharding import arc_of_points, capacities, place, ring, shard_by_ring
from quarry.session import materialize


def test_ring_growth_takes_points_only_into_the_new_shard():
    small, grown = dict(ring(40)), dict(ring(41))
    assert len(small) == 40 * 64 and len(grown) == 41 * 64
    assert all(grown[p] == s for p, s in small.items())
    a, b = arc_of_points(ring(40)), arc_of_points(ring(41))
    owner = lambda n, arcs: [ring_[x][1] for ring_ in [ring(n)] for x in arcs]
    moved = [(s, t) for s, t in zip(owner(40, a), owner(41, b), strict=True) if s != t]
    assert moved and {t for _, t in moved} == {40}


def walk(counts, nodes, room):
    """One row at a time: own shard first, then clockwise."""
    free, out = list(room), defaultdict(list)
    over = []
    for arc, n in enumerate(counts):
        for rank in range(n):
            if free[nodes[arc][1]]:
                free[nodes[arc][1]] -= 1
                out[arc].append(nodes[arc][1])
            else:
                over.append((arc, rank))
    for arc, _ in over:
        step = arc
        while True:
            step = (step + 1) % len(nodes)
            if free[nodes[step][1]]:
                free[nodes[step][1]] -= 1
                out[arc].append(nodes[step][1])
                break
    return out


def test_runs_equal_a_walk_of_single_rows():
    draw = random.Random(3)
    nodes = ring(5, 4)
    for _ in range(20):
        counts = [draw.choice([0, 1, 3, 40]) for _ in nodes]
        room = capacities(sum(counts), 5)
        runs = place(counts, nodes, room)
        got = defaultdict(list)
        for arc, first, past, shard, _ in sorted(runs):
            got[arc] += [shard] * (past - first)
        assert got == walk(counts, nodes, room)
        used = Counter()
        for *_, shard in [(r[0], r[3]) for r in runs]:
            used[shard] += 1
        slots = sorted((r[3], r[4], r[2] - r[1]) for r in runs)
        at = Counter()
        for shard, slot, n in slots:
            assert slot == at[shard]
            at[shard] += n
        assert [at[s] for s in range(5)] == room


def check_shards(rows, docs, shards):
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    sizes = [len(by[s]) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    want = [(k, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for k, t in docs]
    assert sorted([(r.doc_id, r.size, r.text_crc32) for r in rows], key=repr) == sorted(want, key=repr)


def test_odd_rows_in_shards(spark):
    docs = [(r[0], r[1]) for r in ODD]
    for shards in (1, 3, 40):
        check_shards(shard_by_ring(odd_table(spark), shards).collect(), docs, shards)
    assert shard_by_ring(empty_table(spark)).count() == 0
    with pytest.raises(ValueError):
        shard_by_ring(odd_table(spark), 5000)


def test_one_id_for_most_rows(spark):
    rows = [(7, f"t{k}") for k in range(300)] + [(k, "u") for k in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check_shards(shard_by_ring(df, 8).collect(), rows, 8)


def test_a_hot_point_is_ranked_by_several_tasks(spark, monkeypatch):
    rows = [(7, f"t{k}") for k in range(300)] + [(None, "same")] * 600 + [(k, "u") for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    cols = ["doc_id", "text_crc32", "size", "shard", "slot"]
    want, tasks = rows_of(shard_by_ring(df, 8), *cols), []
    numbered = sharding.with_ordinal

    def spy(frame, order, **more):
        out = numbered(frame, order, **more)
        tasks.extend(r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect())
        return out

    monkeypatch.setattr(sharding, "HOT_ROWS", 50)
    monkeypatch.setattr(sharding, "with_ordinal", spy)
    assert rows_of(shard_by_ring(df, 8), *cols) == want
    assert sum(tasks) >= 900 and max(tasks) < 300  # 600 rows are alike


def test_sharding_query_and_movement(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    check_shards(QUERIES["op7_sharding"](spark, SF_SMALL).collect(), docs, 40)
    df = spark.range(20_000).selectExpr("id doc_id", "'x' text")
    a = {r.doc_id: r.shard for r in shard_by_ring(df, 40).collect()}
    b = {r.doc_id: r.shard for r in shard_by_ring(df, 41).collect()}
    assert sum(a[k] != b[k] for k in a) < 0.35 * len(a)  # all but 1/40 by modulo


def targets(sizes, weights=(5, 2, 1), cap=3):
    """Words by weight; what is above a cap is shared again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        if not free:
            return fixed
        level = (total - sum(fixed.values())) / sum(w[s] for s in free)
        above = [s for s in free if level * w[s] >= cap * sizes[s]]
        if not above:
            return fixed | {s: level * w[s] for s in free}
        fixed |= {s: cap * sizes[s] for s in above}


@pytest.mark.parametrize(
    "sizes",
    [
        {"a": 10, "b": 1000, "c": 5000, None: 100, "é": 3, "Z": 40},
        {"a": 7},
        {"a": 0, "b": 0},
        {"a": 1, "b": 1, "c": 1, "d": 100_000},
        {f"s{k}": (k * 37) % 91 + 1 for k in range(40)},
    ],
)
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "_source string, source_size long")
    got = {r._source: r.target for r in source_targets(df).collect()}
    want = targets(sizes)
    assert got.keys() == want.keys()
    assert all(got[s] == pytest.approx(want[s], rel=1e-12) for s in want)


def check_mix(rows, docs):
    """``docs`` by id: (text, source); one row per document."""
    words = {k: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for k, (t, _) in docs.items()}
    sizes, taken, largest = Counter(), Counter(), Counter()
    for k, (_, s) in docs.items():
        sizes[s] += words[k]
    want = targets(dict(sizes))
    for r in rows:
        source = docs[r.doc_id][1]
        assert r.size == words[r.doc_id] and r.source_size == sizes[source]
        assert r.target == pytest.approx(want[source], rel=1e-9)
        assert 0 <= r.taken <= 3 * r.size and (not r.size or r.taken % r.size == 0)
        taken[source] += r.taken
        largest[source] = max(largest[source], r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6, s


def test_samples_have_a_fixed_size_and_their_probabilities(spark):
    """Over many seeds documents are taken as often as their own probabilities say."""
    rng = random.Random(8)
    sizes = [rng.randrange(100, 160) for _ in range(60)] + [rng.randrange(400, 900) for _ in range(30)] + [7, 0, 0]
    rows = [(str(k), "s", n) for k, n in enumerate(sizes)] + [(f"t{k}", "t", 100 + k) for k in range(40)]
    df = mixing._classed(spark.createDataFrame(rows, "_key string, _source string, _size long"))
    plan = spark.createDataFrame([("s", 0.37), ("t", 0.5)], "_source string, _fraction double")
    classes = df.groupBy("_source", "_class").agg(
        F.count(F.lit(1)).alias("_rows"), F.sum("_size").alias("_words"), F.max("_size").alias("_largest"))
    drawn = materialize(mixing.sample_sizes(classes, plan))
    by_class = defaultdict(lambda: [0, 0.0, 0])
    known = {r._key: r for r in mixing._with_class(df, drawn).withColumn("_p", mixing.probability()).collect()}
    for r in known.values():
        held = by_class[r._source, r._class]
        held[0], held[1], held[2] = r._n, held[1] + r._p, held[2] + 1
        assert 0 <= r._p <= 1 + 1e-9
    for n, total, rows_in in by_class.values():
        assert total == pytest.approx(n) and n <= rows_in
    assert any(len({round(r._p, 6) for r in known.values() if (r._source, r._class) == c}) > 3 for c in by_class)
    wanted = {"s": 0.37 * sum(sizes), "t": 0.5 * sum(100 + k for k in range(40))}
    expected = Counter()
    for r in known.values():
        expected[r._source] += r._p * r._size
    assert all(abs(expected[s] - wanted[s]) < 0.03 * wanted[s] for s in wanted)
    # The samples themselves: every seed is one more group of the same classes.
    seeds = 400
    many = df.crossJoin(spark.range(seeds)).withColumns({
        "_source": F.concat("_source", F.lit("/"), F.col("id").cast("string")),
        "_key": F.concat("_key", F.lit("/"), F.col("id").cast("string"))}).drop("id")
    table = drawn.crossJoin(spark.range(seeds)).withColumn(
        "_source", F.concat("_source", F.lit("/"), F.col("id").cast("string"))).drop("id")
    table = materialize(table)
    ranks = mixing.ranked(many, table, "x")
    ends = mixing._beside(table, mixing._ends(ranks.filter("_q IS NOT NULL")))
    taken = mixing.ranked(many, ends, "x").filter(mixing._in_sample()).select("_source", "_class", "_key").collect()
    times, sampled = Counter(), Counter()
    for r in taken:
        times[r._key.split("/")[0]] += 1
        sampled[r._source, r._class] += 1
    for (source, number), n in sampled.items():
        assert n == by_class[source.split("/")[0], number][0]
    for key, r in known.items():
        p = min(max(r._p, 0), 1)
        assert abs(times[key] / seeds - p) <= 5 * (p * (1 - p) / seeds) ** 0.5 + 0.01, (key, p, times[key])


def test_odd_rows_in_the_mix(spark):
    df = odd_table(spark).filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    docs = {r[0]: (r[1], r[3]) for r in ODD if r[0] is not None}
    check_mix(mix(df).collect(), docs)
    assert mix(odd_table(spark)).count() == len(ODD)
    assert mix(empty_table(spark)).count() == 0 == mixed_documents(empty_table(spark)).count()


def test_mixed_documents_are_those_taken(spark):
    df = odd_table(spark)
    taken = Counter()
    for r in mix(df).collect():
        taken[r.doc_id] += r.taken // r.size if r.size else 0
    out = mixed_documents(df)
    assert out.columns == df.columns
    got = Counter(r.doc_id for r in out.filter("length(trim(text)) > 2").collect())
    assert all(got[k] == n for k, n in taken.items() if n)


def test_mixing_query(spark):
    docs = {r.doc_id: (r.text, r.source) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    first, again = (QUERIES["op10_mixing"](spark, SF_SMALL) for _ in range(2))
    check_mix(first.collect(), docs)
    cols = ["doc_id", "size", "source_size", "target", "taken"]
    assert rows_of(first, *cols) == rows_of(again.repartition(7), *cols)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF_SMALL}/documents.parquet'")
    want = con.execute(f"SELECT doc_id, size, source_size, taken FROM ({ORACLE['op10_mixing']})").fetchall()
    assert rows_of(first, "doc_id", "size", "source_size", "taken") == sorted(want, key=repr)
