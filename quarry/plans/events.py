"""Loss-log and stream queries (events, conversations, documents)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.agg import distinct_scores, epoch_loss, not_meta
from quarry.operators.layout import spread
from quarry.plans import fixtures as fx
from quarry.plans.dialog import thread_prepare
from quarry.plans.registry import ORACLE, query
from quarry.session import materialize, scratch_folder
from quarry.sources.tables import table
from quarry.streaming import ingest


@query(
    "loss_perplexity",
    """SELECT event_type AS epoch, CAST(count(*) AS BIGINT) AS steps,
  round(avg(value / 100.0e0), 6) AS mean_loss, round(exp(avg(value / 100.0e0)), 6) AS perplexity
FROM events GROUP BY event_type""",
)
def loss_perplexity(spark: SparkSession, d: str) -> DataFrame:
    """Mean loss and perplexity per epoch over a loss log (events: the
    event type is the epoch, value / 100 the step loss)."""
    log = table(spark, d, "events").select(F.col("event_type").alias("epoch"),
                                           (F.col("value") / F.lit(100.0)).alias("loss"))
    out = epoch_loss(log, "epoch", "loss")
    return out.select("epoch", F.col("steps").cast("bigint").alias("steps"),
                      F.round("mean_loss", 6).alias("mean_loss"),
                      F.round("perplexity", 6).alias("perplexity"))


@query("stream_twin")
def stream_twin(spark: SparkSession, d: str) -> DataFrame:
    """A8 + M1: thread records landed as JSON files (several per trigger
    window) and run through the streaming form of the thread transform; the
    result must equal the batch query ``thread_prepare``."""
    base = scratch_folder(spark, "threads")
    fx.threads(spark, d).repartition(4).write.json(f"{base}/landing")
    stream = ingest.thread_stream(spark, f"{base}/landing", max_files_per_trigger=1)
    ingest.stream_to_parquet(stream, sink=f"{base}/sink", checkpoint=f"{base}/ckpt")
    return spark.read.parquet(f"{base}/sink")


ORACLE["stream_twin"] = ORACLE["thread_prepare"]
assert thread_prepare  # the batch twin


@query(
    "resume_ingest",
    "SELECT doc_id, source, md5(text) AS text_md5 FROM documents",
)
def resume_ingest(spark: SparkSession, d: str) -> DataFrame:
    """M2: documents land in two waves, the second re-delivering part of the
    first; the ingest is run, re-run, and run again after the second wave.
    The sink must hold every document exactly once."""
    base = scratch_folder(spark, "ingest")
    docs = spread(table(spark, d, "documents").select("doc_id", "source", "text"))
    # As many files as the scan has splits; each wave is taken in about two triggers.
    files = math.ceil(docs.rdd.getNumPartitions() / 2)
    wave = F.col("doc_id") % 2
    docs.filter(wave == 0).write.mode("append").parquet(f"{base}/landing")
    stream = lambda: ingest.open_stream(spark, f"{base}/landing", docs.schema, fmt="parquet",
                                        max_files_per_trigger=files)
    run = lambda: ingest.resumable_ingest(spark, stream().select("doc_id", "source", "text"),
                                          sink=f"{base}/sink", checkpoint=f"{base}/ckpt",
                                          keys=["doc_id"])
    run()
    run()
    # Second wave: the other half plus a re-delivery of the first.
    docs.write.mode("append").parquet(f"{base}/landing")
    run()
    return spark.read.parquet(f"{base}/sink").select("doc_id", "source",
                                                      F.md5("text").alias("text_md5"))


WAVES, STREAM_DRAW = 4, 40


@query(
    "stream_draw",
    f"""WITH {fx.SQL_THREADS}
SELECT qid, md5(CAST(qid AS VARCHAR) || ':42') AS draw_key FROM threads
WHERE len(list_distinct(list_transform(answers, lambda a: a.pm_score))) = len(answers)
  AND NOT contains(metadata[1], 'meta')
ORDER BY qid % {WAVES}, draw_key LIMIT {STREAM_DRAW}""",
)
def stream_draw(spark: SparkSession, d: str) -> DataFrame:
    """F3 on a stream (+ A8, B6, B7): threads land in waves; accepted ones are taken until the
    draw is full.  The first run sees two waves, the second one goes on with all of them."""
    base = scratch_folder(spark, "draw")
    threads = materialize(fx.threads(spark, d))
    for wave in range(WAVES):
        threads.filter(F.col("qid") % WAVES == wave).coalesce(1).write.mode("append").json(f"{base}/landing")
        if wave in (1, WAVES - 1):
            stream = ingest.open_stream(spark, f"{base}/landing", ingest.THREAD_SCHEMA, max_files_per_trigger=1)
            ingest.draw_stream(
                spark, stream.select("qid", "answers", "metadata"), STREAM_DRAW, sink=f"{base}/sink",
                checkpoint=f"{base}/ckpt", id_col="qid", accept=distinct_scores() & not_meta(),
            )
    return spark.read.parquet(f"{base}/sink").select("qid", "draw_key")
