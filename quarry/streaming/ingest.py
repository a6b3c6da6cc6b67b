"""Record streams (A8, M1) and resumable ingest (M2) on Structured Streaming.

The reference pulls one record at a time, keeps a ledger of done keys and
appends to a CSV.  Here a file-stream source replays landed files, the
streaming checkpoint remembers which files were processed, and each
micro-batch is deduplicated and anti-joined against what the sink already
holds before it is appended, so a re-run or a re-delivered file never
duplicates a key (and a crash between write and commit is replayed without
duplicates).
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators.agg import prepare_threads
from quarry.operators.joins import bounded_broadcast
from quarry.operators.sample import first_by_hash, seeded_key

THREAD_SCHEMA = T.StructType([
    T.StructField("qid", T.LongType()),
    T.StructField("date", T.StringType()),
    T.StructField("question", T.StringType()),
    T.StructField("metadata", T.ArrayType(T.StringType())),
    T.StructField("answers", T.ArrayType(T.StructType([
        T.StructField("text", T.StringType()),
        T.StructField("pm_score", T.IntegerType()),
    ]))),
])


def open_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "json",
                max_files_per_trigger: int | None = None) -> DataFrame:
    """A replayable record stream over a landing directory."""
    r = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path)


def thread_stream(spark: SparkSession, path: str, **kw) -> DataFrame:
    """M1: the stateless per-record thread transform applied to a stream
    (the same function as the batch query; append mode, no state)."""
    return prepare_threads(open_stream(spark, path, THREAD_SCHEMA, **kw))


def _sink(spark: SparkSession, path: str) -> DataFrame | None:
    """The sink's table, or ``None`` before its first write.  Only a missing or
    empty folder counts as such; any other failure to read it is raised."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def resumable_ingest(
    spark: SparkSession,
    stream: DataFrame,
    *,
    sink: str,
    checkpoint: str,
    keys: list[str],
    order: list[str] | None = None,
    transform: Callable[[DataFrame], DataFrame] | None = None,
    max_batch_keys: int = 1_000_000,
) -> None:
    """M2: process everything available now, skip keys already in the sink,
    append the rest, then stop.  Running it again is a no-op; new files add
    only their new keys.  Of a key that a batch holds twice, the first row by
    ``order`` (all other columns unless given) is kept.

    The sink is probed with the batch's keys: up to ``max_batch_keys`` they are
    broadcast into its scan, so the sink's keys are not shuffled."""

    def write_batch(batch: DataFrame, _epoch: int) -> None:
        b = transform(batch) if transform else batch
        rest = order or [c for c in b.columns if c not in keys]
        others = [c for c in b.columns if c not in keys and c not in rest]
        # A batch of more splits than shuffle partitions is grouped in as many: a task's
        # share of it does not grow with the batch.
        splits = b.rdd.getNumPartitions()
        if splits > int(spark.conf.get("spark.sql.shuffle.partitions")):
            b = b.repartition(splits, *keys)
        if rest:
            first = F.min(F.struct(*rest, *others)).alias("_first")
            b = b.groupBy(*keys).agg(first).select(*keys, "_first.*").select(*b.columns)
        else:
            b = b.dropDuplicates(keys)
        held = _sink(spark, sink)
        if held is not None:
            b = b.persist()
            wanted = bounded_broadcast(b.select(*keys), max_batch_keys)
            done = held.select(*keys).join(wanted, keys, "left_semi").distinct()
            b.join(done, keys, "left_anti").write.mode("append").parquet(sink)
            b.unpersist()
        else:
            b.write.mode("append").parquet(sink)

    q = (stream.writeStream.foreachBatch(write_batch)
         .option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def draw_stream(
    spark: SparkSession,
    stream: DataFrame,
    n: int,
    *,
    sink: str,
    checkpoint: str,
    id_col: str,
    accept: Column | None = None,
    seed: int = 42,
) -> None:
    """F3 on a stream: take accepted records, each id once, until ``n`` are in the sink, then stop.

    Every micro-batch gives all of its accepted records that the sink lacks;
    the one that would pass ``n`` gives those with the first seeded keys (of
    an id that it holds twice, one record).  What was taken is counted in the
    sink, whose appends are whole: a run that ends midway and is run again
    draws the same records as one that does not."""
    full = threading.Event()

    def write_batch(batch: DataFrame, _epoch: int) -> None:
        held = _sink(spark, sink)
        wanted = n - (held.count() if held is not None else 0)
        if wanted <= 0:
            full.set()
            return
        rows = batch.filter(accept) if accept is not None else batch
        rest = [c for c in rows.columns if c != id_col]
        rows = rows.groupBy(id_col).agg(F.min_by(F.struct(*rest), F.to_json(F.struct(*rest))).alias("_first"))
        rows = rows.select(id_col, "_first.*").select(*batch.columns)
        if held is not None:
            rows = rows.join(held.select(id_col), id_col, "left_anti")
        taken = first_by_hash(rows.withColumn("draw_key", seeded_key(id_col, seed)), wanted, "draw_key", id_col)
        taken.write.mode("append").parquet(sink)

    q = (stream.writeStream.foreachBatch(write_batch)
         .option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    while not q.awaitTermination(0.2):
        if full.is_set():
            q.stop()


def stream_to_parquet(df: DataFrame, *, sink: str, checkpoint: str) -> None:
    """Append-mode file sink for a stateless stream, run to completion."""
    q = (df.writeStream.format("parquet").option("path", sink)
         .option("checkpointLocation", checkpoint).outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination()
