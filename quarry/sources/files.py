"""File sources and sinks.

Readers return lazy DataFrames with declared schemas; writers are one
writer per task (never a file opened per record).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.text import py_strip
from quarry.sources.records import escaped_records, marked_records

# ---- A1 / A10: marker-delimited records ---------------------------------------


def read_delimited(spark: SparkSession, path: str, marker: str, *, strip: bool = False,
                   source: str | None = None) -> DataFrame:
    """A1: records separated by ``marker`` (multi-character allowed).

    Of each file exactly the piece after its last marker is dropped, whatever
    it holds; empty records between markers stay.  Compressed files and files
    with a byte order mark (which is no part of a record) give the same
    records as plain ones.  ``strip`` removes the white space around each
    record (the Wikipedia reader strips, PubMed does not)."""
    records = marked_records(spark, path, marker)
    text = py_strip("record") if strip else F.col("record")
    cols = [text.alias("text")]
    if source is not None:
        cols.append(F.lit(source).alias("source"))
    return records.select(*cols)


def write_delimited(df: DataFrame, path: str, marker: str, text_col: str = "text",
                    mode: str = "overwrite") -> None:
    """A10: each record followed by ``\\n<marker>\\n``."""
    df.select(text_col).write.mode(mode).option("lineSep", f"\n{marker}\n").text(path)


# ---- A2 / A11: one record per line --------------------------------------------


def read_lines(spark: SparkSession, path: str, name: str = "line") -> DataFrame:
    """A2: one row per line (``readlines``); number rows with
    ``ordinal.with_ordinal`` when positions matter."""
    return spark.read.text(path).select(F.col("value").alias(name))


def write_lines(df: DataFrame, path: str, col: str, mode: str = "overwrite") -> None:
    """A11."""
    df.select(col).write.mode(mode).text(path)


# ---- A3 / A4 / A12 / A13: CSV and tables ----------------------------------------


def read_csv_multiline(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A3: header row, quoted fields that may hold newlines."""
    return (spark.read.schema(schema).option("header", True).option("multiLine", True)
            .option("quote", '"').option("escape", '"').csv(path))


def _pieces(column: str, mark: str):
    """What stands between marks that no backslash escapes: plain characters and
    escaped pairs are matched as such, so runs of backslashes may have any length."""
    piece = rf"(?s){mark}([^\\{mark}]*+(?:\\.[^\\{mark}]*+)*+\\?)"
    return F.regexp_extract_all(F.concat(F.lit(mark), F.col(column)), F.lit(piece), F.lit(1))


def read_escaped_csv(spark: SparkSession, path: str, columns: list[str],
                     max_rows: int | None = None) -> DataFrame:
    """A4: unquoted CSV where ``\\`` escapes the delimiter, the newline and
    itself.  The first record of each file is its header; an empty record is
    one whose only field is empty.  Splits of a file are read in parallel, a
    record may cross them.  ``max_rows`` keeps the head in file and record
    order; by default all records are read."""
    records = escaped_records(spark, path)
    if max_rows is not None:
        records = records.orderBy("_file", "_block", "_n").limit(max_rows)
    plain = F.transform(_pieces("record", ","), lambda c: F.regexp_replace(c, r"(?s)\\(.)", "$1"))
    return records.select(*[F.get(plain, i).alias(c) for i, c in enumerate(columns)])


def write_escaped_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A12 without quotes: backslash, comma and newline are escaped by a backslash; null is empty."""
    def escaped(name: str):
        value = F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))
        return F.regexp_replace(value, r"([\\,\n])", r"\\$1")

    line = F.concat_ws(",", *[escaped(c) for c in df.columns])
    header = ",".join(df.columns)
    # A header per part file: the first row of each partition brings it along.
    first = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0
    df.select(F.when(first, F.concat(F.lit(header + "\n"), line)).otherwise(line).alias("value")).write.mode(mode).text(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Header, overwrite."""
    df.write.mode(mode).option("header", True).option("escape", "\"").option("quoteAll", True).option(
        "ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def append_table(df: DataFrame, path: str) -> None:
    """Create on first write, append afterwards (schema travels with
    Parquet, so column order can never be swapped as a headerless CSV can)."""
    df.write.mode("append").parquet(path)


# ---- A5 / A6 / A7: JSON inputs ------------------------------------------------------

TRANSCRIPT_TYPE = "map<string, array<struct<text: string>>>"


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """A5: JSON files mapping video id -> list of ``{text}``; one row per
    element, in file order (``video``, ``seg_no``, ``text``)."""
    files = spark.read.text(path, wholetext=True)
    m = files.select(F.from_json("value", TRANSCRIPT_TYPE).alias("m"))
    per_video = m.select(F.explode("m").alias("video", "segs"))
    return per_video.select("video", F.posexplode("segs").alias("seg_no", "s")).select(
        "video", "seg_no", F.col("s.text").alias("text"))


def read_answer_archive(spark: SparkSession, path: str, marker: str = "<END>") -> DataFrame:
    """JSON map run key -> answers each followed by ``marker``; the piece
    after the last marker is dropped; one row per answer ``(run, pos, answer)``."""
    files = spark.read.text(path, wholetext=True)
    m = files.select(F.explode(F.from_json("value", "map<string,string>")).alias("run", "v"))
    pieces = F.split("v", re.escape(marker), -1)
    kept = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))
    return m.select("run", F.posexplode(kept).alias("pos", "answer"))


def read_nested(spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "json") -> DataFrame:
    """Nested QA records from a landing directory with a declared schema."""
    return spark.read.schema(schema).format(fmt).load(path)


# ---- A14 / A15: run-partitioned answers, JSON lines ------------------------------------

RUN_PARTITIONS = ["dataset", "formatted", "rank", "decoding", "checkpoint"]


def write_runs(df: DataFrame, path: str, mode: str = "append") -> None:
    """Answers laid out by run parameters, so choosing a run (B11) reads
    only its own directory (partition pruning)."""
    df.write.mode(mode).partitionBy(*RUN_PARTITIONS).parquet(path)


def write_jsonl(df: DataFrame, path: str, json_col: str | None = None, mode: str = "overwrite") -> None:
    """One JSON object per line."""
    col = F.col(json_col) if json_col else F.to_json(F.struct(*df.columns))
    df.select(col.alias("value")).write.mode(mode).text(path)
