"""Every registered query with an oracle statement equals DuckDB at sf0.001."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from quarry.plans import catalog
from quarry.sources.tables import TABLES

from conftest import SF_SMALL

# The training-data queries have their own tests in tests/llm.
ORACLE = catalog.ORACLE


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def _rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted((tuple(_norm(x) for x in r) for r in pdf[cols].itertuples(index=False, name=None)),
                        key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    got = entry.queries()[name](spark, SF_SMALL).toPandas()
    want = con.execute(ORACLE[name]).df()
    gc, gr = _rows(got)
    wc, wr = _rows(want)
    assert gc == wc
    assert len(gr) == len(wr)
    assert gr == wr


def test_every_query_runs_and_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["conv_id", "turn", "question", "doc_ids", "context"]
    assert df.count() > 0
    assert set(catalog.QUERIES) <= set(entry.queries())


def test_every_query_has_an_oracle():
    assert set(catalog.QUERIES) == set(ORACLE)
