import hashlib
import re

import duckdb
from conftest import SF_SMALL
from helpers import ODD, empty_table, odd_table, rows_of
from quarry.llm.exact_dedup import drop_exact_duplicates, exact_dedup, frequent_digests, prune
from quarry.llm.registry import ORACLE, QUERIES


def plain(rows):
    by = {}
    for doc_id, text in rows:
        body = re.sub(r"[\x20\x09-\x0D]+", " ", text or "")
        by.setdefault(hashlib.sha256(body.encode()).hexdigest(), []).append(doc_id)
    out = []
    for digest, ids in by.items():
        least = min((i for i in ids if i is not None), default=None)
        out += [(i, least, len(ids), i == least, digest) for i in ids]
    return sorted(out, key=repr)


COLS = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def test_odd_rows(spark):
    got = rows_of(exact_dedup(odd_table(spark)), *COLS)
    assert got == plain([(r[0], r[1]) for r in ODD])


def test_empty_table(spark):
    assert exact_dedup(empty_table(spark)).count() == 0
    assert drop_exact_duplicates(empty_table(spark)).count() == 0


def test_hot_text_is_settled_by_the_broadcast(spark):
    rows = [(k, "hot" if k % 3 == 0 else f"text {k % 400}") for k in range(1200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert rows_of(exact_dedup(df, counters=4), *COLS) == plain(rows)
    digests = df.selectExpr("doc_id", "sha2(text, 256) d")
    heavy = frequent_digests(digests, "doc_id", "d", counters=4)
    assert heavy == [(hashlib.sha256(b"hot").hexdigest(), 0, 400)]


def test_misra_gries_keeps_what_is_frequent():
    counts = {f"k{k}": 3 for k in range(10)} | {"hot": 40}
    assert prune(counts, 4) == {"hot": 37}
    assert prune(counts, 20) == counts


def test_dropping_keeps_all_columns_and_other_texts_of_an_id(spark):
    df = spark.createDataFrame([(1, "x", "p"), (2, "x", "q"), (2, "y", "r")], "doc_id long, text string, keep_id string")
    assert rows_of(drop_exact_duplicates(df), "doc_id", "text", "keep_id") == [(1, "x", "p"), (2, "y", "r")]


def test_one_of_the_rows_alike_in_id_and_text_stays(spark):
    rows = [(1, "x", "p"), (1, "x ", "q"), (1, "x", "p"), (1, "y", "r"), (2, "x", "s"), (2, "z", "t")]
    rows += [(None, "n  n", "b"), (None, "n n", "a"), (None, "y", "u"), (None, "m", "v"), (None, None, "w"), (None, "", "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _row string").repartition(4)
    got = drop_exact_duplicates(df)
    assert got.columns == df.columns
    want = [(1, "x", "p"), (1, "x ", "q"), (1, "y", "r"), (2, "z", "t"), (None, "m", "v")]
    some = [r for r in rows_of(got, "doc_id", "text", "_row") if r[2] not in ("a", "b", "w")]
    assert some == sorted(want, key=repr)
    assert got.filter("doc_id IS NULL").count() == 3 and got.filter("_row IN ('a', 'b')").count() == 1
    again = drop_exact_duplicates(df.repartition(7))
    assert rows_of(again, *df.columns) == rows_of(got, *df.columns)


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF_SMALL}/documents.parquet'")
    want = con.execute(f"SELECT {', '.join(COLS)} FROM ({ORACLE['op8_exact_dedup']})").fetchall()
    assert rows_of(QUERIES["op8_exact_dedup"](spark, SF_SMALL), *COLS) == sorted(want, key=repr)
