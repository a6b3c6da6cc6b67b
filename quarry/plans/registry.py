"""Named queries over a data directory, each with its DuckDB oracle statement.

A query is ``fn(spark, data_dir) -> DataFrame``.  The oracle is plain SQL over
the same tables (views named after the parquet files); queries whose work is
an order-dependent fold (chunking) or a user hook have no oracle and are
checked against brute force in the tests instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn

    return deco
