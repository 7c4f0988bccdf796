"""Derived tables that several queries share, written once per application.

The feature table and the score table are the two results worth keeping; every
reader then prunes columns and partitions from parquet instead of repeating
the cleaning shuffles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewatch.session import pin, scratch_path

_PATHS: dict[tuple[str, str, str], tuple[str, object]] = {}


def stored(
    spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame], partition_by: str | None = None
) -> DataFrame:
    pin(spark)
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _PATHS:
        df = build()
        path = scratch_path(spark, name)
        writer = df.write
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
        _PATHS[key] = (path, df.schema)
    path, schema = _PATHS[key]
    return spark.read.schema(schema).parquet(path)
