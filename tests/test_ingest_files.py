"""resume_ingest: the landed files follow the input's splits."""

import glob

from quarry.plans.events import resume_ingest
from quarry.session import checkpoint_dir


def test_a_wave_lands_in_as_many_files_as_splits(spark, scratch):
    rows = [(i, f"s{i % 3}", f"text {i}") for i in range(400)] + [(None, "s", "no id"), (400, None, None)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").coalesce(1).write.parquet(f"{scratch}/documents.parquet")
    where = checkpoint_dir(spark).removeprefix("file:")
    before = set(glob.glob(f"{where}/ingest-*/data/landing/*.parquet"))
    out = resume_ingest(spark, scratch)
    landed = set(glob.glob(f"{where}/ingest-*/data/landing/*.parquet")) - before
    # Before: two files a wave, each written by one task, whatever the input's size.
    assert len(landed) >= 2 * min(8, spark.sparkContext.defaultParallelism) > 4
    ids = [r["doc_id"] for r in out.collect()]
    assert sorted(ids, key=repr) == sorted([r[0] for r in rows], key=repr)


def test_a_batch_of_many_splits_is_grouped_in_as_many(spark, scratch):
    from quarry.streaming import ingest

    docs = spark.range(3000).selectExpr("id % 1500 AS doc_id", "cast(id AS string) AS text").repartition(12)
    docs.write.parquet(f"{scratch}/landing")
    conf = {"spark.sql.shuffle.partitions": "2", "spark.sql.files.maxPartitionBytes": "4096",
            "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    was = {c: spark.conf.get(c) for c in conf}
    for c, v in conf.items():
        spark.conf.set(c, v)
    try:
        ingest.resumable_ingest(spark, ingest.open_stream(spark, f"{scratch}/landing", docs.schema, fmt="parquet"),
                                sink=f"{scratch}/sink", checkpoint=f"{scratch}/ckpt", keys=["doc_id"])
    finally:
        for c, v in was.items():
            spark.conf.set(c, v)
    # Before: two tasks wrote the batch.
    assert len(glob.glob(f"{scratch}/sink/*.parquet")) > 2
    assert spark.read.parquet(f"{scratch}/sink").agg({"doc_id": "count"}).first()[0] == 1500
