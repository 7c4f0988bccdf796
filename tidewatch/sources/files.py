"""File sources and sinks: snapshots, images, JSON documents, versioned tables."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.schemas import TABLES
from tidewatch.session import pin

SNAPSHOT_TIME = "yyyy.MM.dd.HH.mm.ss"
IMAGE_PATTERN = r"(?i)\.(png|jpg|jpeg)$"


def read_snapshots(spark: SparkSession, path: str, channel: int = 0) -> DataFrame:
    """(file, ts, signal): headerless tab-separated files, one row per file.

    A file is one snapshot of about 20 thousand lines; it is read whole by one task,
    which keeps the sample order. Files without a readable number are left out.
    """
    text = pin(spark).read.text(path, wholetext=True, recursiveFileLookup=True)
    lines = F.filter(F.split(F.regexp_replace("value", "\r", ""), "\n"), lambda s: F.trim(s) != "")
    cells = F.transform(lines, lambda s: F.split(s, "\t"))
    numbers = F.transform(cells, lambda c: F.get(c, channel).try_cast("double"))
    name = F.col("_metadata.file_name")
    return (
        text.select(name.alias("file"), numbers.alias("signal"))
        .where((F.size("signal") > 0) & ~F.exists("signal", lambda v: v.isNull()))
        .select("file", F.try_to_timestamp("file", F.lit(SNAPSHOT_TIME)).alias("ts"), "signal")
    )


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, label, split, content) of png / jpg / jpeg files; class and split from the path."""
    raw = pin(spark).read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return classify_images(raw.select("path", "content"))


def classify_images(files: DataFrame) -> DataFrame:
    """def_front -> defective, ok_front -> good, anything else is dropped."""
    low = F.lower("path")
    label = F.when(low.contains("def_front"), "defective").when(low.contains("ok_front"), "good")
    split = F.when(low.contains("test"), "test").otherwise("train")
    kept = files.where(F.col("path").rlike(IMAGE_PATTERN)).withColumns({"label": label, "split": split})
    return kept.where(F.col("label").isNotNull())


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def read_document(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A JSON array or object; a missing file is an empty table of the same schema."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return pin(spark).read.schema(schema).json(path, multiLine=True)


def empty_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[name])


def conform(df: DataFrame, name: str) -> DataFrame:
    """Cast to the typed schema of an operational table; absent columns become NULL."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in TABLES[name].fields
        ]
    )


def version_path(root: str) -> str:
    """A path for a new version below `root`; later ones sort behind earlier ones."""
    stamp = datetime.datetime.now(datetime.timezone.utc).strftime("%Y%m%dT%H%M%S%f")
    return f"{root.rstrip('/')}/v={stamp}-{uuid.uuid4().hex[:8]}"


def write_version(df: DataFrame, root: str, partition_by: list[str] | None = None, form: str = "parquet") -> str:
    """A new immutable version directory; readers of the old one are not disturbed."""
    path = version_path(root)
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).format(form).save(path)
    return path


def latest_version(spark: SparkSession, root: str) -> str | None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        return None
    # a version counts once its job has committed
    done = [s.getPath() for s in fs.listStatus(hadoop) if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    names = sorted(p.toString() for p in done if p.getName().startswith("v="))
    return names[-1] if names else None


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    path = latest_version(spark, root)
    if path is None:
        return empty_table(spark, name)
    return pin(spark).read.schema(TABLES[name]).parquet(path)


def write_processed(df: DataFrame, root: str) -> dict[str, str]:
    """The processed table partitioned by split, and the test rows as a replay source."""
    return {
        "processed": write_version(df, f"{root}/processed", ["split"]),
        "test_stream": write_version(df.where(F.col("split") == "test"), f"{root}/test_stream"),
    }


def write_report(df: DataFrame, root: str) -> str:
    """Small result tables go out as JSON lines."""
    return write_version(df, root, form="json")
