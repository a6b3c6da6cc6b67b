"""Parquet tables of a data directory (one ``<name>.parquet`` per table)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, data_dir: str, name: str) -> DataFrame:
    """Lazy scan; Catalyst prunes columns and pushes filters into the reader."""
    return spark.read.parquet(f"{data_dir.rstrip('/')}/{name}.parquet")
