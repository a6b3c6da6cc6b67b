import hashlib
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from conftest import SF_SMALL
from helpers import ODD, empty_table, odd_table, rows_of
from pyspark.sql import functions as F
from quarry.llm.fim import Marks, Units, feed_marks, fill_in_middle, layout_of, lead_marks, restored, words_of
from quarry.llm.registry import ORACLE, QUERIES

COLS = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]


def plain(doc_id, text, unit="line", rate=100, seed=7):
    """One text, by slicing code points."""
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text) if unit == "line" else list(text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return doc_id, n, "plain", None, None, text
    if h4 % 100 < 50:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_marks_select_every_byte():
    rng = random.Random(1)
    for size in (0, 1, 7, 8, 9, 63, 64, 200):
        data = bytes(rng.choice(b"\n\n\x0b\x8a\x00\xffa") for _ in range(size))
        marks = Marks(feed_marks(words_of(np.frombuffer(data, np.uint8)) if size else np.zeros(1, np.uint64)))
        where = [i for i, b in enumerate(data) if b == 10]
        assert marks.select(np.arange(len(where))).tolist() == where
        at = np.arange(size + 1)
        assert marks.rank(at).tolist() == [data[:i].count(10) for i in range(size + 1)]


def test_lead_marks_count_code_points():
    text = "aé中\U0001f600\n" * 5
    data = np.frombuffer(text.encode(), np.uint8)
    marks = Marks(lead_marks(words_of(data)))
    assert marks.rank(np.array([len(data)])).tolist() == [len(text)]


def test_boundaries_of_sliced_columns():
    texts = ["x\ny", "", "\n\n", "é\n中", "no feed", "a\nb\n"] * 4
    column = pa.array(["skipped\n", *texts]).slice(1)
    data, offsets = layout_of(column)
    for unit in ("line", "char"):
        units = Units(data, offsets, unit)
        for k in range(8):
            cut = units.boundary(np.minimum(units.n, k))
            for t, a, b in zip(texts, units.starts, cut, strict=True):
                want = re.findall(r"[^\n]*\n|[^\n]+", t) if unit == "line" else list(t)
                assert bytes(data[a:b]).decode() == "".join(want[:k])


@pytest.mark.parametrize("unit,rate", [("line", 100), ("char", 100), ("line", 60)])
def test_odd_rows_equal_the_plain_version(spark, unit, rate):
    got = rows_of(fill_in_middle(odd_table(spark), unit=unit, rate=rate), *COLS)
    assert got == sorted((plain(r[0], r[1], unit, rate) for r in ODD), key=repr)


def test_random_texts_and_round_trip(spark):
    rng = random.Random(3)
    alphabet = ["\n", "\n", "a", "é", "中", "\U0001f600", "<", "P", "S", "M", ">", "\r", "\x85", " "]
    rows = [(k, "".join(rng.choices(alphabet, k=rng.randrange(60)))) for k in range(3000)]
    rows += [(3000, "<P>"), (3001, "x<S>"), (3002, "<M"), (3003, "\n" * 300_000), (3004, "ab" * 200_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = fill_in_middle(docs)
    assert rows_of(out, *COLS) == sorted((plain(*r) for r in rows), key=repr)
    assert rows_of(out.select("doc_id", restored().alias("text")), "doc_id", "text") == sorted(rows, key=repr)
    forms = {r["form"] for r in out.select("form").distinct().collect()}
    assert forms == {"plain", "psm", "spm"}


def test_empty_table_clashes_and_units(spark):
    assert fill_in_middle(empty_table(spark)).count() == 0
    clash = spark.createDataFrame([(1, "a\nb")], "doc_id long, text string")
    clash = clash.withColumns({c: F.lit("z") for c in ("output", "form", "n", "_h1", "_text")})
    assert rows_of(fill_in_middle(clash), *COLS) == [plain(1, "a\nb")]
    with pytest.raises(ValueError):
        fill_in_middle(clash, unit="page")


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF_SMALL}/documents.parquet'")
    cols = [*COLS[:-1], "output_sha256", "restored_sha256"]
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({ORACLE['op12_fill_in_middle']})").fetchall()
    assert rows_of(QUERIES["op12_fill_in_middle"](spark, SF_SMALL), *cols) == sorted(want, key=repr)
