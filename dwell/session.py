"""Session helpers: a local session for tests/bench, and checkpoint directory handling."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "dwell", driver_memory: str = "8g",
                  event_log_dir: str | None = None) -> SparkSession:
    """A local session configured the way the library expects (tests, bench)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if event_log_dir:
        builder = (builder.config("spark.eventLog.enabled", "true")
                   .config("spark.eventLog.dir", event_log_dir))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint directory.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used as is.
    Only when it is unset on a *local* master (tests, bench, smoke runs) do we
    create a private one under the system temp folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; set it to a shared folder that all "
            "executors can reach (lineage is cut there after range partitioning)")
    path = tempfile.mkdtemp(prefix="dwell-ckpt-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def written(df: DataFrame, *partitions: str) -> DataFrame:
    """``df`` written once as Parquet beside the checkpoints and read back: cuts the lineage as a reliable
    checkpoint does, but a reader takes only its columns, and only its ``partitions`` where it filters by them."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/written-{uuid.uuid4().hex}"
    (df.write.partitionBy(*partitions) if partitions else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*[F.col(f"`{c}`") for c in df.columns])


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    """Eager, reliable checkpoint (never a local one): survives executor loss and
    fixes a non-deterministic partitioning (range bounds) once.

    The input is persisted for the duration of the checkpoint: an eager
    checkpoint runs one job to materialise the rows and another to write them,
    and without the cache the second job would recompute the whole lineage."""
    from pyspark import StorageLevel
    ensure_checkpoint_dir(df.sparkSession)
    cached = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return cached.checkpoint(eager=True)
    finally:
        cached.unpersist(blocking=False)
