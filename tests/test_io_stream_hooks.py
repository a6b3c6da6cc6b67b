"""Sources/sinks round trips, streaming re-runs, user hooks."""

import json
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarry.operators import hooks, sample
from quarry.sources import files
from quarry.streaming import ingest


def test_delimited_roundtrip(spark, scratch):
    df = spark.createDataFrame([("first line\nsecond",), ("  two  ",)], "text string")
    path = os.path.join(scratch, "d")
    files.write_delimited(df.coalesce(1), path, "<END>")
    raw = open([os.path.join(path, f) for f in os.listdir(path) if f.startswith("part")][0]).read()
    assert raw == "first line\nsecond\n<END>\n  two  \n<END>\n"
    got = [r.text for r in files.read_delimited(spark, path, "<END>", strip=True).collect()]
    assert got == ["first line\nsecond", "two"]
    kept = [r.text for r in files.read_delimited(spark, path, "<END>").collect()]
    assert kept == ["first line\nsecond\n", "\n  two  \n"]


def test_answer_archive(spark, scratch):
    path = os.path.join(scratch, "a.json")
    with open(path, "w") as f:
        json.dump({"pubmed_qs_ans_8_greedy_561": "a1\n<END>\na2\n<END>\n"}, f)
    rows = files.read_answer_archive(spark, path).orderBy("pos").collect()
    assert [(r.run, r.pos, r.answer) for r in rows] == [
        ("pubmed_qs_ans_8_greedy_561", 0, "a1\n"), ("pubmed_qs_ans_8_greedy_561", 1, "\na2\n")]


def test_transcripts(spark, scratch):
    path = os.path.join(scratch, "t.json")
    with open(path, "w") as f:
        json.dump({"v1": [{"text": "x"}, {"text": "y"}], "v2": [{"text": "z"}]}, f)
    rows = files.read_transcripts(spark, path).orderBy("video", "seg_no").collect()
    assert [(r.video, r.seg_no, r.text) for r in rows] == [("v1", 0, "x"), ("v1", 1, "y"), ("v2", 0, "z")]


def test_escaped_csv(spark, scratch):
    path = os.path.join(scratch, "e.csv")
    with open(path, "w") as f:
        f.write("a,b\nx\\,y,z\\\\\n")
    r = files.read_escaped_csv(spark, path, ["a", "b"]).first()
    assert (r.a, r.b) == ("x,y", "z\\")


def test_run_partitions_prune(spark, scratch):
    df = spark.createDataFrame([("pubmed", False, "8", "greedy", "561", 1, "ans")],
                               "dataset string, formatted boolean, rank string, decoding string, "
                               "checkpoint string, qid long, answer string")
    path = os.path.join(scratch, "runs")
    files.write_runs(df, path)
    sel = spark.read.parquet(path).filter((F.col("dataset") == "pubmed") & (F.col("checkpoint") == "561"))
    assert "PartitionFilters" in sel._jdf.queryExecution().executedPlan().toString()
    assert sel.count() == 1


def test_jsonl(spark, scratch):
    df = spark.createDataFrame([(1, "x")], "id long, s string")
    path = os.path.join(scratch, "j")
    files.write_jsonl(df.coalesce(1), path)
    part = [f for f in os.listdir(path) if f.startswith("part")][0]
    assert open(os.path.join(path, part)).read() == '{"id":1,"s":"x"}\n'


def test_resumable_ingest_reruns(spark, scratch):
    land, sink, ck = (os.path.join(scratch, x) for x in ("land", "sink", "ck"))
    spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string").write.mode("append").parquet(land)
    schema = spark.read.parquet(land).schema

    def run():
        ingest.resumable_ingest(spark, ingest.open_stream(spark, land, schema, fmt="parquet"),
                                sink=sink, checkpoint=ck, keys=["k"])
        return sorted(r.k for r in spark.read.parquet(sink).collect())

    assert run() == [1, 2]
    assert run() == [1, 2]
    spark.createDataFrame([(2, "b"), (3, "c")], "k long, v string").write.mode("append").parquet(land)
    assert run() == [1, 2, 3]


def test_generate_hook(spark):
    def _toy_generator():
        return lambda prompts, decoding, **given: [f"{p} -> {decoding}" for p in prompts]

    q = spark.createDataFrame([(1, "why\n"), (2, "how")], "qid long, question string")
    out = hooks.generate_answers(q, _toy_generator, key_cols=["qid"], batch_size=1).collect()
    got = sorted((r.qid, r.decoding, r.answer) for r in out)
    assert got == [(1, "greedy", "-> greedy"), (1, "nucleus", "-> nucleus"),
                   (2, "greedy", "-> greedy"), (2, "nucleus", "-> nucleus")]


def test_map_batches_drops_columns(spark):
    df = spark.createDataFrame([(1, "ab")], "k long, text string")
    out = hooks.map_batches(df, lambda p: p.assign(n=p.text.str.len()), "k long, n long", drop=["text"])
    assert [tuple(r) for r in out.collect()] == [(1, 2)]


def logged_model(log, fails_at=None):
    """A generator that writes down its prompts, and fails at one of them."""

    def build():
        def generate(prompts, decoding, **given):
            if fails_at in prompts:
                raise RuntimeError("killed")
            with open(f"{log}/{os.getpid()}", "a") as f:
                f.writelines(f"{p}\n" for p in prompts)
            return [f"{p} answer" for p in prompts]

        return generate

    return build


def test_a_killed_generation_goes_on_where_it_was(spark, scratch):
    log = os.path.join(scratch, "log")
    os.makedirs(log)
    rows = [(k, f"q{k}") for k in range(60)]
    df = spark.createDataFrame(rows, "k long, question string").repartition(2)
    given = {"key_cols": ["k"], "parts": 6, "decodings": ("greedy",), "parameters": {}}
    with pytest.raises(Exception, match="killed"):
        hooks.generate_resumable(df, logged_model(log, "q17"), f"{scratch}/t", **given)
    kept = spark.read.parquet(f"{scratch}/t").count() if os.path.isdir(f"{scratch}/t") else 0
    done = {r.k for r in spark.read.parquet(f"{scratch}/t").collect()} if kept else set()
    out = hooks.generate_resumable(df, logged_model(log), f"{scratch}/t", **given)
    assert sorted((r.k, r.answer) for r in out.collect()) == sorted((k, "answer") for k, _ in rows)
    calls = Counter(x.strip() for name in os.listdir(log) for x in open(os.path.join(log, name)))
    assert set(calls) == {q for _, q in rows} and all(calls[f"q{k}"] == 1 for k in done)
    # Nothing is left to do; questions added later are answered alone.
    more = df.union(spark.createDataFrame([(99, "late")], df.schema))
    assert hooks.generate_resumable(more, logged_model(log), f"{scratch}/t", **given).count() == 61
    again = Counter(x.strip() for name in os.listdir(log) for x in open(os.path.join(log, name)))
    assert again - calls == Counter(["late"])


@pytest.mark.parametrize("ordered", [20_000, 3])
def test_first_rows_by_hash_equal_a_sort(spark, monkeypatch, ordered):
    monkeypatch.setattr(sample, "ORDERED", ordered)
    ids = [*range(500), None, None, *[7] * 40]
    df = spark.createDataFrame([(i, f"r{k}") for k, i in enumerate(ids)], "id long, t string").repartition(5)
    df = df.withColumn("key", F.coalesce(sample.seeded_key("id"), F.lit("00")))
    rows = sorted(((r.key, r.id is not None, r.id or 0) for r in df.collect()))
    at = next(k for k, r in enumerate(rows) if r[2] == 7 and r[1])
    for n in (0, 1, 2, 5, 100, at + 1, at + 20, len(ids) - 1, len(ids), len(ids) + 9):
        got = sorted((r.key, r.id is not None, r.id or 0) for r in sample.first_by_hash(df, n, "key", "id").collect())
        assert got == rows[:n]
    plan = sample.first_by_hash(df, 100, "key", "id")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" not in plan and "Sort" not in plan


def test_a_draw_from_a_stream_survives_restarts(spark, scratch):
    schema = "id long, ok boolean"
    for wave in range(6):
        rows = [(wave * 10 + k if k else 0, k % 3 != 1) for k in range(10)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(f"{scratch}/in")
    df = spark.read.schema(schema).json(f"{scratch}/in")

    def run(name, n, checkpoint="c"):
        stream = ingest.open_stream(spark, f"{scratch}/in", df.schema, max_files_per_trigger=1)
        ingest.draw_stream(
            spark, stream, n, sink=f"{scratch}/{name}", checkpoint=f"{scratch}/{name}-{checkpoint}", id_col="id", accept=F.col("ok"))
        return sorted(r.id for r in spark.read.parquet(f"{scratch}/{name}").collect())

    whole = run("a", 17)
    assert len(whole) == len(set(whole)) == 17 and 0 in whole
    assert run("a", 17) == whole
    # Batches that were written, but not committed, add nothing when they are replayed.
    assert run("a", 17, "lost") == whole
    first = run("b", 9)
    assert len(first) == 9 and run("b", 9, "lost") == first and set(first) < set(run("b", 17, "more"))
    # Fewer accepted records than wanted: all of them.
    assert run("c", 1000) == sorted({r.id for r in df.filter("ok").collect()})
