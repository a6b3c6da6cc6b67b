"""Seeded shuffle, first-N and draw-until-N.

The first N rows by a hash are a filter: a histogram of the keys' leading
digits, refined where the N-th row lies, gives the N-th key, and all rows up to
it are kept where they are.  Only counts and one small range of keys leave the
tasks, however large N is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seeded_key(id_col: str, seed: int = 42) -> Column:
    """a sort key that is a pure function of (id, seed): stable under any
    partitioning, and the same hex digest DuckDB's ``md5`` gives."""
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}")))


def seeded_shuffle(df: DataFrame, id_col: str, seed: int = 42, name: str = "shuffle_key") -> DataFrame:
    return df.withColumn(name, seeded_key(id_col, seed))


#: Leading hex digits of a key that one histogram tells apart, and keys that are ordered in one task.
DIGITS = 4
ORDERED = 20_000


def first_n(df: DataFrame, n: int, order: list[str | Column]) -> DataFrame:
    """first ``n`` rows under any total order, for a small ``n``
    (``TakeOrderedAndProject``: each task keeps its own ``n`` best)."""
    return df.orderBy(*order).limit(n)


def first_by_hash(df: DataFrame, n: int, key_col: str, id_col: str) -> DataFrame:
    """the ``n`` rows that come first by ``key_col`` (hex digits, evenly spread), then ``id_col``.

    Rows alike in both are interchangeable.  All rows if there are no more than ``n``."""
    if n <= 0:
        return df.limit(0)
    keys = df.select(F.col(key_col).alias("_k"), F.col(id_col).alias("_i"))
    prefix, wanted = "", n
    while True:
        bins = (
            keys.filter(F.startswith("_k", F.lit(prefix)))
            .groupBy(F.substring("_k", len(prefix) + 1, DIGITS).alias("_b"))
            .agg(F.count(F.lit(1)).alias("_n"))
        )
        held = sorted((r["_b"], r["_n"]) for r in bins.collect())  # 16 ** DIGITS at most
        if sum(x for _, x in held) < wanted:
            return df
        for digits, rows in held:
            if rows >= wanted:
                break
            wanted -= rows
        prefix += digits
        if rows <= ORDERED or len(digits) < DIGITS:
            break
    # The n-th row by key and id; rows before it in its range are no more than ORDERED
    # unless they share a whole key.
    edge = keys.filter(F.startswith("_k", F.lit(prefix)))
    if rows > ORDERED:
        edge = edge.groupBy("_k", "_i").agg(F.count(F.lit(1)).alias("_n"))
    else:
        edge = edge.withColumn("_n", F.lit(1))
    upto = F.sum("_n").over(Window.partitionBy("_k0").orderBy("_k", "_i").rowsBetween(Window.unboundedPreceding, 0))
    placed = edge.withColumn("_k0", F.lit(prefix)).withColumn("_upto", upto).filter(F.col("_upto") >= wanted)
    last = placed.orderBy("_k", "_i").limit(1).first()
    same = (F.col(key_col) == F.lit(last["_k"])) & F.col(id_col).eqNullSafe(F.lit(last["_i"]))
    # Nulls come first, as in an ascending order.
    id_before = F.lit(False) if last["_i"] is None else F.coalesce(F.col(id_col) < F.lit(last["_i"]), F.lit(True))
    before = df.filter((F.col(key_col) < F.lit(last["_k"])) | ((F.col(key_col) == F.lit(last["_k"])) & id_before))
    return before.unionByName(df.filter(same).limit(n - before.count()))


def draw_n(df: DataFrame, n: int, id_col: str, accept: Column | None = None, seed: int = 42) -> DataFrame:
    """``n`` distinct accepted rows in seeded random order, no repeats.

    The acceptance filter runs before the draw, so rejected rows are never
    drawn (the reference re-drew until ``n`` were accepted)."""
    if accept is not None:
        df = df.filter(accept)
    return first_by_hash(df.withColumn("draw_key", seeded_key(id_col, seed)), n, "draw_key", id_col)
