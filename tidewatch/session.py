"""Session defaults and the one place where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "16g",
}


def local_session(cores: str = "8", app: str = "tidewatch", **extra: str) -> SparkSession:
    """A session for tests and the bench. On a cluster the caller owns the session."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    conf = {**LOCAL_DEFAULTS, "spark.sql.shuffle.partitions": str(cores).replace("*", "8"), **extra}
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def pin(spark: SparkSession) -> SparkSession:
    """Timestamps are compared and printed in UTC everywhere.

    Window and Arrow stages here are bound by computing, not by bytes: a small
    minimum lets AQE keep one partition per core where the data is small. Large
    shuffles are not affected, their partitions are above any minimum.
    """
    for key, value in {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64KB",
    }.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as the session names it.

    Only a local master may fall back to a temporary folder: on a cluster a
    machine-local path would be invisible to the other executors.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="tidewatch-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write once, read back: cuts lineage, survives executor loss, and lets the
    readers prune columns, which a cached or checkpointed plan would not."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
