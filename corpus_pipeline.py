"""The corpus pipeline: stages over ``documents``, each one of the training-data operators.

Every stage works on all that the stage before kept and returns the columns of
``documents``; the last one returns the packed pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm.common import scan
from quarry.llm.exact_dedup import drop_exact_duplicates
from quarry.llm.minhash import drop_near_duplicates
from quarry.llm.mixing import mixed_documents
from quarry.llm.packing import pack, public_vocabulary
from quarry.llm.quality import keep_good
from quarry.session import scratch_folder
from quarry.sources.tables import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones, predicts good."""
    return keep_good(docs, table(spark, sf_dir, "labels")).select(*COLUMNS)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest id stays."""
    return drop_exact_duplicates(docs).select(*COLUMNS)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the smallest id stays."""
    return drop_near_duplicates(docs).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a row appears as often as it is taken."""
    return mixed_documents(docs).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in training sequences."""
    return pack(docs, public_vocabulary())


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("near dedup", near_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: No SQL states the learnt and the tokenizing stages; the tests hold the rows against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again."""
    folder = scratch_folder(spark, "pipeline")
    docs = scan(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = f"{folder}/{k}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
