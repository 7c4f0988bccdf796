"""Series sources: CSV files and the event / order / line-item tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.schemas import RAW_SERIES
from tidewatch.session import pin

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return pin(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def nan_to_null(column):
    """NaN sorts above every number in Spark and poisons max(); a missing value is NULL."""
    return F.when(~F.isnan(column), column)


def read_series_csv(spark: SparkSession, path: str) -> DataFrame:
    """timestamp,value with a header. The schema is declared, so nothing is read twice."""
    df = pin(spark).read.schema(RAW_SERIES).option("header", True).csv(path)
    return df.withColumn("value", nan_to_null(F.col("value")))


def normalise_value_column(df: DataFrame, name: str = "value") -> DataFrame:
    """Without a `value` column, the first numeric column takes its place."""
    if name in df.columns:
        return df
    numeric = [c for c, dtype in df.dtypes if dtype in NUMERIC or dtype.startswith("decimal")]
    return df.withColumnRenamed(numeric[0], name) if numeric else df


def as_readings(df: DataFrame, sensor: str, ts: str, value: str, seq: str, extra: tuple[Column, ...] = ()) -> DataFrame:
    """Any table as readings: (sensor_id, ts, value, seq, extra...); seq is the ingestion order."""
    return df.select(
        F.col(sensor).cast("string").alias("sensor_id"),
        F.col(ts).cast("timestamp").alias("ts"),
        nan_to_null(F.col(value).cast("double")).alias("value"),
        F.col(seq).cast("bigint").alias("seq"),
        *extra,
    )


def event_readings(
    spark: SparkSession, sf_dir: str, sensor: str = "event_type", extra: tuple[Column, ...] = ()
) -> DataFrame:
    return as_readings(table(spark, sf_dir, "events"), sensor, "ts", "value", "event_id", extra)


def order_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily order totals per priority: a second, denser series."""
    return as_readings(
        table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderdate", "o_totalprice", "o_orderkey"
    )
