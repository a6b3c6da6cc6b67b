"""Session construction and shared-storage helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(
    master: str | None = None,
    app_name: str = "quarry",
    shuffle_partitions: int | None = None,
    driver_memory: str = "16g",
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Session tuned for this engine: AQE on, UI off, Arrow on, UTC clock.

    ``master`` defaults to ``local[$BENCH_CPUS or 8]``; on a cluster pass the
    cluster master (or ``None`` with spark-submit) and size
    ``shuffle_partitions`` to the data (roughly input bytes / 128 MB).
    """
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    builder = SparkSession.builder.appName(app_name)
    if master is None and not os.environ.get("SPARK_MASTER"):
        master = f"local[{cpus}]"
    if master:
        builder = builder.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.shuffle.partitions": str(shuffle_partitions or cpus),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.memory": driver_memory,
        # Checkpoint files go when the frames that read them are gone.
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder used to cut lineage (``spark.checkpoint.dir``).

    The cluster's setting always wins.  Only a local-mode session with no
    setting gets a fresh scratch folder; on a cluster an unset value is an
    error, because a machine-local folder would not survive executor loss.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get(CHECKPOINT_CONF, None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return sc.getCheckpointDir() or current
    if not sc.master.startswith("local"):
        raise RuntimeError(
            f"{CHECKPOINT_CONF} is not set; point it at shared storage (HDFS/S3/DBFS)"
        )
    path = tempfile.mkdtemp(prefix="quarry-ckpt-")
    spark.conf.set(CHECKPOINT_CONF, path)
    sc.setCheckpointDir(path)
    return path


def path_exists(spark: SparkSession, path: str) -> bool:
    sc = spark.sparkContext
    place = sc._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(sc._jsc.hadoopConfiguration()).exists(place)


def scratch_folder(spark: SparkSession, tag: str) -> str:
    """A path for a new folder under the shared one, deleted when the driver's JVM ends."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    sc = spark.sparkContext
    place = sc._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(sc._jsc.hadoopConfiguration())
    files.mkdirs(place)
    files.deleteOnExit(place)
    return f"{path}/data"


def materialize(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: cuts lineage into shared storage, keeps partitioning."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
