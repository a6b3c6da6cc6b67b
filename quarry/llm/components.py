"""Connected components of an edge table, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.session import materialize


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node reachable) of all nodes with an edge.

    ``edges`` has two integer columns.  Alternating large and small stars:
    every node hands its smallest neighbour to the larger ones, then to all
    smaller ones, until each node has one edge, to its component's smallest
    node.  Each half is a partial minimum and a join, so a node with very many
    neighbours costs one row a task in the minimum; the minima are materialized
    before the join, so that it reads two plain exchanges and adaptive execution
    can split such a node's rows.  Lineage is cut after each round."""
    a, b = edges.columns
    now = materialize(
        edges.filter(F.col(a) != F.col(b))
        .select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v"))
        .distinct()
    )
    before = _state(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large)
        down = materialize(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(down, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialize(small.unionByName(down.select("u", F.col("m").alias("v"))).distinct())
        after = _state(now)
        if after == before:
            break
        before = after
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
