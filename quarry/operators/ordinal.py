"""Row order made explicit (E1, E2) and positional slices.

``with_ordinal`` numbers rows 0..n-1 without a global window: rows are
range-partitioned (or kept in scan order), materialized, counted per
partition (one tiny row per partition), and each row adds its partition's
prefix offset to its position inside the partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from quarry.session import materialize


def with_ordinal(
    df: DataFrame,
    order_cols: list[str | Column] | None = None,
    *,
    name: str = "pos",
    num_partitions: int | None = None,
    keys: DataFrame | None = None,
) -> DataFrame:
    """Add ``name`` = 0-based row number in ``order_cols`` order (ties broken by
    the given columns only, so pass a unique key), or in scan order when no
    order is given.

    Ranges are cut on a sample, for which ``df`` is computed once more.  ``keys``,
    a cheaper frame of one column with the values of the first order column,
    ascending, saves that (unless its values are not numbers or many are equal)."""
    spark = df.sparkSession
    if order_cols:
        n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
        part = _range_of(keys, order_cols[0], n) if keys is not None else None
        ranged = df.repartitionByRange(n, *order_cols) if part is None else df.repartitionById(n, part)
        laid = ranged.sortWithinPartitions(*order_cols)
    else:
        laid = df
    # Both passes below must see identical partitions: cut lineage first.
    laid = materialize(laid.withColumn("_pid", F.spark_partition_id()).withColumn(
        "_mid", F.monotonically_increasing_id()))
    counts = laid.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    # One row per partition: this window's input is bounded by the partition count.
    offsets = counts.select(
        "_pid",
        (F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)))
        .alias("_off"),
    ).fillna(0, ["_off"])
    local = F.col("_mid") - F.shiftleft(F.col("_pid").cast("bigint"), 33)
    return (
        laid.join(F.broadcast(offsets), "_pid")
        .withColumn(name, (F.col("_off") + local).cast("bigint"))
        .drop("_pid", "_mid", "_off")
    )


def _range_of(keys: DataFrame, col: str | Column, n: int) -> Column | None:
    """The number of a value's range, of ``n`` with about equal rows, nulls first; none if
    the values are no numbers, or if equal ones or nulls may fill a range."""
    key = keys.columns[0]
    if not isinstance(keys.schema[0].dataType, IntegralType):
        return None
    at = F.percentile_approx(key, [i / n for i in range(1, n)] or [0.5], 100 * n)
    marks, rows, held = keys.agg(at, F.count(F.lit(1)), F.count(key)).first()
    if not marks or len(set(marks)) < len(marks) or (rows - held) * n > rows:
        return None
    value = F.col(col) if isinstance(col, str) else col
    below = F.filter(F.array(*[F.lit(m).cast("bigint") for m in marks[: n - 1]]), lambda m: m < value)
    return F.when(value.isNull() | F.lit(n == 1), 0).otherwise(F.size(below)).cast("int")


def positional_slice(df: DataFrame, start: int, end: int | None, pos_col: str = "pos") -> DataFrame:
    """Rows with ``start <= pos < end`` (``df[start:end]``)."""
    cond = F.col(pos_col) >= start
    if end is not None:
        cond = cond & (F.col(pos_col) < end)
    return df.filter(cond)


def batch_id(pos_col: str = "pos", batch_rows: int = 400) -> Column:
    """Fixed-size batches over an ordinal."""
    return F.floor(F.col(pos_col) / F.lit(batch_rows)).cast("bigint")


def running_offset(value: str, partition_cols: list[str], order_col: str) -> Column:
    """Exclusive running sum inside a (bounded) batch."""
    w = Window.partitionBy(*partition_cols).orderBy(order_col).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return F.sum(value).over(w) - F.col(value)
