"""Cases that the supplied tables do not hold: empty and unterminated records,
escapes, dropped sections, markup, model caches, ingest failures, no hits."""

import contextlib
import gzip
import random
import os

import duckdb
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quarry.functions.html import paragraph_text
from quarry.operators import agg, hooks
from quarry.sources import files
from quarry.streaming import ingest


def _write(folder, name, text):
    path = os.path.join(folder, name)
    with open(path, "w", newline="") as f:
        f.write(text)
    return path


def test_only_the_piece_after_the_last_marker_is_dropped(spark, scratch):
    _write(scratch, "a.txt", "r1<END>\n\n<END>r3<END>tail")
    _write(scratch, "b.txt", "<END>é x<END>")
    _write(scratch, "c.txt", "no marker")
    got = [r.text for r in files.read_delimited(spark, scratch, "<END>").collect()]
    assert sorted(got) == sorted(["r1", "\n\n", "r3", "", "é x"])


def test_markers_over_several_splits(spark, scratch):
    records = [f"{k}:" + "x" * (k % 50) for k in range(3000)]
    path = _write(scratch, "long.txt", "<END>".join(records) + "<END>tail")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        df = files.read_delimited(spark, path, "<END>")
        assert sorted(r.text for r in df.collect()) == sorted(records)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


@contextlib.contextmanager
def splits_of(spark, size):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        yield
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def plain_records(data: bytes, marker: str):
    return sorted(data.decode("utf-8-sig").split(marker)[:-1])


@pytest.mark.parametrize("marker", ["<END>", "-----------", "\n#\n", "aa", " "])
def test_compressed_files_marks_and_splits(spark, scratch, marker):
    rng = random.Random(4)
    bits = ["one", "", "\n", "é\r\n", "a", "-" * 5, "x y", "#"]
    files_of = []
    for k, end in enumerate([marker, "tail", "", marker + "\n", marker * 2]):
        text = marker.join("".join(rng.choices(bits, k=rng.randrange(30))) for _ in range(200)) + end
        raw = (b"\xef\xbb\xbf" if k % 2 else b"") + text.encode()
        files_of.append(raw)
        for name, data in ((f"{k}.txt", raw), (f"{k}z.txt.gz", gzip.compress(raw))):
            with open(f"{scratch}/{name}", "wb") as f:
                f.write(data)
    want = sorted(r for raw in files_of for r in plain_records(raw, marker) * 2)
    for size in ("128m", "700"):
        with splits_of(spark, size):
            assert sorted(r.text for r in files.read_delimited(spark, scratch, marker).collect()) == want


def test_the_last_record_of_small_files(spark, scratch):
    text = "one<END>two<END>"
    for name, data in (("a.txt.gz", gzip.compress(text.encode())), ("b.txt", ("\ufeff" + text).encode())):
        with open(f"{scratch}/{name}", "wb") as f:
            f.write(data)
        got = sorted(r.text for r in files.read_delimited(spark, f"{scratch}/{name}", "<END>").collect())
        assert got == ["one", "two"]


def test_empty_fields_and_records_come_back(spark, scratch):
    df = spark.createDataFrame([("",), (None,), ("x",)], "a string").coalesce(1)
    files.write_escaped_csv(df, f"{scratch}/one")
    assert sorted(r.a for r in files.read_escaped_csv(spark, f"{scratch}/one", ["a"]).collect()) == ["", "", "x"]


def test_one_escaped_file_is_read_by_several_tasks(spark, scratch):
    rng = random.Random(6)
    bits = ["x", "\n", "\\", ",", "é", "\r", "word "]
    rows = [(str(k), "".join(rng.choices(bits, k=rng.randrange(40)))) for k in range(2000)] + [("long", "\n" * 5000)]
    files.write_escaped_csv(spark.createDataFrame(rows, "a string, b string").coalesce(1), f"{scratch}/f")
    for size in ("128m", "3k", "50"):
        with splits_of(spark, size):
            back = files.read_escaped_csv(spark, f"{scratch}/f", ["a", "b"])
            assert sorted(map(tuple, back.collect())) == sorted(rows)
            assert (back.rdd.getNumPartitions() > 9) == (size != "128m")
    head = files.read_escaped_csv(spark, f"{scratch}/f", ["a", "b"], max_rows=7)
    assert [tuple(r) for r in head.collect()] == rows[:7]


def test_long_runs_of_backslashes_before_a_delimiter(spark, scratch):
    path = f"{scratch}/runs"
    rows = [(f"{n}" + "\\" * n, "x," * 3 + "\\" * n, "\n" * n) for n in (0, 1, 99, 100, 101, 5000)] + [("", "y" * 300_000, "")]
    files.write_escaped_csv(spark.createDataFrame(rows, "a string, b string, c string").coalesce(1), path)
    got = [tuple(r) for r in files.read_escaped_csv(spark, path, ["a", "b", "c", "d"]).collect()]
    assert got == [(*r, None) for r in rows]


def test_escaped_backslash_before_a_delimiter(spark, scratch):
    path = _write(scratch, "e.csv", "a,b\nx\\\\,y\nx\\,y,z\\\\\na,b\nq\\\nr,s\n\n")
    rows = [tuple(r) for r in files.read_escaped_csv(spark, path, ["a", "b"]).collect()]
    assert rows == [("x\\", "y"), ("x,y", "z\\"), ("a", "b"), ("q\nr", "s"), ("", None)]
    assert files.read_escaped_csv(spark, path, ["a", "b"], max_rows=2).count() == 2


def test_a_page_without_kept_sections_is_empty(spark):
    rows = [("P", 0, "References", "x"), ("Q", 1, "B", "b"), ("Q", 0, "A", "a"), ("Q", 2, "EXTERNAL LINKS", "c"),
            ("R", 0, None, "n")]
    df = spark.createDataFrame(rows, "title string, sec_no int, sec_title string, text string")
    assert {r.title: r.text for r in agg.page_text(df).collect()} == {"P": "", "Q": "a\nb\n", "R": "n\n"}


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<p>a <pre>b</pre> c</p>d", "a b c"),
        ("<p>a <picture>b</picture> c</p >d<p>e", "a b ce"),
        ("<p>&#8217; &hellip; &eacute; &#x27; &amp;lt; &nosuch; &#0; &#xD800; &amp &copy;</p>",
         "’ … é ' &lt; &nosuch; � � & ©"),
        ("<p>&NotEqualTilde;&#128512;&CounterClockwiseContourIntegral;</p>", "≂̸\U0001F600∳"),
    ],
)
def test_paragraphs(spark, html, text):
    assert spark.range(1).select(paragraph_text(F.lit(html))).first()[0] == text


def _factory(name):
    def build():
        return lambda prompts, decoding, **kw: [f"{name} {kw}" for _ in prompts]

    return build


def test_two_models_of_one_factory_in_one_session(spark):
    q = spark.createDataFrame([(1, "why")], "qid long, question string").coalesce(1)
    for name in ("modelA", "modelB", "modelA"):
        out = hooks.generate_answers(q, _factory(name), key_cols=["qid"], decodings=("nucleus",)).collect()
        assert out[0].answer == f"{name} {{'max_new_tokens': 96, 'do_sample': True, 'top_p': 0.95}}"
    assert hooks.model_digest(_factory("x")) == hooks.model_digest(_factory("x"))
    assert hooks.model_digest(_factory("x")) != hooks.model_digest(_factory("y"))


def test_ingest_keeps_the_first_row_of_a_key(spark, scratch):
    land, sink, ck = (os.path.join(scratch, x) for x in ("land", "sink", "ck"))
    rows = [(1, 5, "e"), (1, 2, "b"), (2, 1, "a"), (1, 9, "z")]
    spark.createDataFrame(rows, "k long, n long, v string").repartition(3).write.parquet(land)
    stream = ingest.open_stream(spark, land, spark.read.parquet(land).schema, fmt="parquet")
    ingest.resumable_ingest(spark, stream, sink=sink, checkpoint=ck, keys=["k"], order=["n"])
    assert sorted(map(tuple, spark.read.parquet(sink).collect())) == [(1, 2, "b"), (2, 1, "a")]


@pytest.mark.parametrize("broken", ["no key", "no table"])
def test_ingest_does_not_take_a_broken_sink_for_an_empty_one(spark, scratch, broken):
    land, sink, ck = (os.path.join(scratch, x) for x in ("land", "sink", "ck"))
    spark.createDataFrame([(1, "a")], "k long, v string").write.parquet(land)
    if broken == "no key":
        spark.createDataFrame([(1,)], "other long").write.parquet(sink)
    else:
        os.mkdir(sink)
        _write(sink, "part-0.parquet", "this is not a table")
    stream = ingest.open_stream(spark, land, spark.read.parquet(land).schema, fmt="parquet")
    with pytest.raises(StreamingQueryException):
        ingest.resumable_ingest(spark, stream, sink=sink, checkpoint=ck, keys=["k"])


def test_a_question_without_hits_keeps_its_row(spark, scratch):
    spark.createDataFrame([(1, "alpha beta", "en", "s", 10), (2, "beta gamma", "en", "s", 10)],
                          "doc_id long, text string, lang string, source string, n_chars long"
                          ).coalesce(1).write.parquet(f"{scratch}/documents.parquet")
    turns = [(1, 0, "user", "q one"), (1, 1, "assistant", "beta"), (2, 0, "user", "q two"), (2, 1, "assistant", "zzz")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"
                          ).coalesce(1).write.parquet(f"{scratch}/conversations.parquet")
    got = entry.queries()["hyde_context"](spark, scratch)
    rows = sorted(map(tuple, got.select("conv_id", "turn", "question", "doc_ids", "context").collect()))
    assert rows[1] == (2, 1, "q two", "", "") and rows[0][3] == "1,2"
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{scratch}/{t}.parquet/*.parquet'")
    sql = entry.oracle_sql()["hyde_context"]
    want = con.execute(f"SELECT conv_id, turn, question, doc_ids, context FROM ({sql})").fetchall()
    assert rows == sorted(want)
