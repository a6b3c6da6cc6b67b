"""Records that do not end where lines end, read in parallel.

A file is scanned by lines (or by another character, where a record's marker
holds a line feed); a split reads its own lines and cuts them into records.
Records that lie within a split come out at once.  The first record of each
split may have begun before, and the last may go on behind: these pieces, at
most two a split, are put together by file.  How a split's first piece is to
be read does not depend on the splits before it, only whether they left a
record open; a running count of closed pieces says which belong together.

Nothing is decided by file sizes, so compressed files and byte order marks do
not matter, and a record may cross any number of splits.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.operators.joins import bounded_broadcast
from quarry.session import materialize

#: Records of one output batch of a task, and their characters.
BATCH_ROWS = 4096
BATCH_CHARS = 4 << 20
PIECE = "_file string, _block long, _n long, record string, closes boolean, edge boolean"


def cut_by_marker(marker: str, glue: str):
    """A cutter for records that each end with ``marker``."""

    def cut(parts: list[str], line: str):
        first, *others = line.split(marker)
        parts.append(first)
        for other in others:
            yield glue.join(parts)
            parts[:] = [other]

    return cut


def cut_by_line_end(parts: list[str], line: str):
    """A cutter for records that end with a line whose end no backslash escapes."""
    parts.append(line)
    if (len(line) - len(line.rstrip("\\"))) % 2 == 0:
        yield "\n".join(parts)
        parts.clear()


def _cutter(cut, glue: str):
    def run(batches):
        held: list[list] = []
        chars = 0
        where, parts, n, first = None, [], 0, True

        def send():
            columns = list(zip(*held, strict=True)) or [[]] * 6
            types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_()]
            names = [f.split()[0] for f in PIECE.split(", ")]
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)
            held.clear()
            return out

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:2] != where:
                    if parts:
                        held.append([*where, n, glue.join(parts), False, True])
                    where, parts, n, first = row[:2], [], 0, True
                for record in cut(parts, row[2]):
                    held.append([*where, n, record, True, first])
                    n, first, chars = n + 1, False, chars + len(record)
                if len(held) >= BATCH_ROWS or chars >= BATCH_CHARS:
                    yield send()
                    chars = 0
        if parts:
            held.append([*where, n, glue.join(parts), False, True])
        if held:
            yield send()

    return run


def _read(spark: SparkSession, path: str, separator: str, cut, glue: str, counts: Column) -> DataFrame:
    """``(_file, _block, _n, record)`` of all records within a split, and of the edge
    records for which ``counts`` holds: a condition on ``closed`` and on ``_k``, the
    record's number among the file's edge records.

    The edge pieces are collected in a first scan.  While the records made of
    them are few, a second scan puts them in their places, so rows come in the
    order of the file; else they are added to it."""
    lines = spark.read.option("lineSep", separator).text(path).select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), "value")
    pieces = lines.mapInArrow(_cutter(cut, glue), PIECE)
    before = Window.partitionBy("_file").orderBy("_block", "_n").rowsBetween(Window.unboundedPreceding, -1)
    number = F.coalesce(F.sum(F.col("closes").cast("long")).over(before), F.lit(0).cast("long"))
    parts = F.sort_array(F.collect_list(F.struct("_block", "_n", "record")))
    mended = pieces.filter("edge").withColumn("_k", number).groupBy("_file", "_k").agg(
        parts.alias("_p"), F.max("closes").alias("closed"))
    mended = materialize(mended.filter(counts).select(
        "_file", F.col("_p")[0]["_block"].alias("_block"), F.col("_p")[0]["_n"].alias("_n"),
        F.array_join(F.transform("_p", lambda x: x["record"]), glue).alias("_whole"),
    ))
    keys = ["_file", "_block", "_n"]
    known = bounded_broadcast(mended)
    if known is mended:
        inside = pieces.filter("NOT edge").select(*keys, "record")
        return inside.unionByName(mended.withColumnRenamed("_whole", "record"))
    placed = pieces.join(known, keys, "left").filter("NOT edge OR _whole IS NOT NULL")
    return placed.select(*keys, F.when(F.col("edge"), F.col("_whole")).otherwise(F.col("record")).alias("record"))


def marked_records(spark: SparkSession, path: str, marker: str) -> DataFrame:
    """``(_file, _block, _n, record)``: of each file what stands before each ``marker``;
    what follows the last one is no record."""
    if not marker:
        raise ValueError("the marker is empty")
    # Lines never hold a part of a marker that begins in another line.
    separator = next(c for c in ["\n", " ", "\t", "\r", *map(chr, range(33, 127))] if c not in marker)
    return _read(spark, path, separator, cut_by_marker(marker, separator), separator, F.col("closed"))


def escaped_records(spark: SparkSession, path: str) -> DataFrame:
    """``(_file, _block, _n, record)``: lines whose ends are not escaped by a backslash, put
    together with the lines before them whose ends are; the first record of each
    file, its header, is left out.  Empty records stay; nothing follows the last
    line end."""
    return _read(spark, path, "\n", cut_by_line_end, "\n", F.col("_k") > 0)
