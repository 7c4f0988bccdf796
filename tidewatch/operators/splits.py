"""Labels, chronological splits and scaling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewatch.operators.clean import floor_div
from tidewatch.operators.scan import join_on

# fixed values: the four known failure windows of the machine temperature series
MACHINE_TEMPERATURE_WINDOWS = [
    ("2013-12-10 06:25:00", "2013-12-12 05:35:00"),
    ("2013-12-15 17:50:00", "2013-12-17 17:00:00"),
    ("2014-01-27 14:20:00", "2014-01-29 13:30:00"),
    ("2014-02-07 14:55:00", "2014-02-09 14:05:00"),
]

TRAIN_SHARE = 0.70
VAL_SHARE = 0.85
BURN_IN_SHARE = 0.15


def label_windows(df: DataFrame, windows: list[tuple[str, str]]) -> DataFrame:
    """label = 1 inside any [start, end]. A literal list is a predicate, not a join."""
    inside: Column = F.lit(False)
    for start, end in windows:
        inside = inside | F.col("ts").between(F.to_timestamp(F.lit(start)), F.to_timestamp(F.lit(end)))
    return df.withColumn("label", F.when(inside, 1).otherwise(0))


def merge_intervals(intervals: DataFrame) -> DataFrame:
    """Disjoint intervals per sensor, so that a reading can match one at most.

    The table of known failures is small per sensor; the window runs over it.
    """
    w = W.partitionBy("sensor_id").orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col("start") > reach), F.col("start"))
    return (
        intervals.withColumn("_fresh", fresh)
        .withColumn("_group", F.last("_fresh", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)))
        .groupBy("sensor_id", "_group")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"))
        .drop("_group")
    )


def label_from_table(df: DataFrame, intervals: DataFrame, bucket_seconds: int = 86400) -> DataFrame:
    """The same labels from a (sensor_id, start, end) table of any size.

    Both sides get a time bucket, which turns the range join into an equi-join.
    """
    bucket = lambda c: floor_div(F.unix_seconds(c), bucket_seconds)
    spread = merge_intervals(intervals).withColumn(
        "_bucket", F.explode(F.sequence(bucket(F.col("start")), bucket(F.col("end"))))
    )
    left = df.withColumn("_bucket", bucket(F.col("ts")))
    match = (
        (left["sensor_id"] == spread["sensor_id"])
        & (left["_bucket"] == spread["_bucket"])
        & left["ts"].between(spread["start"], spread["end"])
    )
    joined = left.join(spread.withColumn("_hit", F.lit(1)), match, "left")
    return joined.select(*[left[c] for c in df.columns], F.coalesce("_hit", F.lit(0)).alias("label"))


def split_bounds(n_rows: Column) -> tuple[Column, Column]:
    return F.floor(n_rows * F.lit(TRAIN_SHARE)), F.floor(n_rows * F.lit(VAL_SHARE))


def chronological_split(df: DataFrame) -> DataFrame:
    """70 / 15 / 15 by row index. On the grid the index is `pos`: no window, no shuffle."""
    train_end, val_end = split_bounds(F.col("n_rows"))
    return df.withColumn(
        "split",
        F.when(F.col("pos") < train_end, "train").when(F.col("pos") < val_end, "val").otherwise("test"),
    )


def split_off_grid(df: DataFrame, order: str = "ts", ties: tuple[str, ...] = ("seq",)) -> DataFrame:
    """The same split for a series without a grid: distributed row numbers."""
    from tidewatch.operators.scan import row_number

    rank = F.unix_micros(order) if dict(df.dtypes)[order] == "timestamp" else F.col(order)
    numbered = row_number(df.withColumn("_order", rank), ["sensor_id"], "_order", list(ties), "pos").drop("_order")
    totals = df.groupBy("sensor_id").agg(F.count("*").alias("n_rows"))
    return chronological_split(numbered.join(totals, "sensor_id"))


def burn_in(df: DataFrame) -> DataFrame:
    """The first 15 % of the train rows, without known anomalies."""
    train_len = split_bounds(F.col("n_rows"))[0]
    return df.where((F.col("pos") < F.floor(train_len * F.lit(BURN_IN_SHARE))) & (F.col("label") == 0))


def fit_scaler(df: DataFrame, column: str = "value") -> DataFrame:
    """(sensor_id, mean, scale): population deviation; a constant series scales by 1."""
    deviation = F.stddev_pop(column)
    return df.groupBy("sensor_id").agg(
        F.avg(column).alias("mean"),
        F.when(deviation == 0, F.lit(1.0)).otherwise(deviation).alias("scale"),
    )


def apply_scaler(df: DataFrame, scaler: DataFrame, column: str = "value") -> DataFrame:
    """Adds the scaled column. A sensor that the scaler does not know keeps its raw value there;
    `unknown_to` counts such rows."""
    scaled = (F.col(column) - F.col("mean")) / F.col("scale")
    return join_on(df, scaler, ["sensor_id"], "left").withColumn(
        f"{column}_scaled", F.when(F.col("scale").isNull(), F.col(column)).otherwise(scaled)
    ).drop("mean", "scale")


def unknown_to(scaler: DataFrame, df: DataFrame) -> DataFrame:
    """(sensor_id, n): the rows of sensors without a fitted scaler."""
    known = scaler.where("scale IS NOT NULL").select(F.col("sensor_id").alias("_known"))
    rest = df.join(known, F.col("sensor_id").eqNullSafe(F.col("_known")), "left_anti")
    return rest.groupBy("sensor_id").agg(F.count("*").alias("n"))


def scale_columns(df: DataFrame, features: list[str], fit_on: Column) -> DataFrame:
    """Standard-scale several columns by the moments of the rows in `fit_on` (one aggregate)."""
    moments = df.where(fit_on).agg(
        *[F.avg(c).alias(f"_m_{c}") for c in features], *[F.stddev_pop(c).alias(f"_s_{c}") for c in features]
    )
    row = moments.first()
    scaled = {}
    for c in features:
        spread = row[f"_s_{c}"] or 1.0
        scaled[c] = (F.col(c) - F.lit(row[f"_m_{c}"])) / F.lit(spread)
    return df.withColumns(scaled)


def leakage_report(df: DataFrame) -> DataFrame:
    """Per sensor: do the splits follow each other strictly, is the burn-in clean?"""
    at = lambda s, f: f(F.when(F.col("split") == s, F.col("ts")))
    in_burn = F.col("pos") < F.floor(split_bounds(F.col("n_rows"))[0] * F.lit(BURN_IN_SHARE))
    per_sensor = df.groupBy("sensor_id").agg(
        at("train", F.max).alias("train_end"),
        at("val", F.min).alias("val_start"),
        at("val", F.max).alias("val_end"),
        at("test", F.min).alias("test_start"),
        F.sum(F.when(in_burn, F.col("label")).otherwise(0)).alias("burn_in_anomalies"),
    )
    return per_sensor.withColumn(
        "in_order", (F.col("train_end") < F.col("val_start")) & (F.col("val_end") < F.col("test_start"))
    )


def prefix_split(df: DataFrame, order: str, size: int = 400) -> DataFrame:
    """is_normal = among the first `size` rows by `order`: a top-N and one scalar."""
    cut = df.select(order).orderBy(order).limit(size).agg(F.max(order).alias("cut"))
    return df.withColumn("is_normal", F.when(F.col(order) <= cut.scalar(), 1).otherwise(0))


def normal_rows(df: DataFrame, split: str = "train") -> DataFrame:
    return df.where((F.col("split") == split) & (F.col("label") == 0))


def retraining_extract(readings: DataFrame, size: int = 10000, train_upto: int = 8000) -> DataFrame:
    """The newest `size` readings by id with label and split.

    `split` keeps the two-way cut (rows 0..train_upto train, rest test);
    `split3` is the three-way split the evaluation needs (70/15/15).
    The window runs over `size` rows only.
    """
    newest = readings.orderBy(F.col("id").desc()).limit(size)
    w = W.orderBy("id")
    numbered = newest.withColumn("pos", F.row_number().over(w) - 1).withColumn(
        "n_rows", F.count("*").over(W.partitionBy())
    )
    three = chronological_split(numbered).withColumnRenamed("split", "split3")
    return three.withColumn("label", F.col("is_anomaly").cast("int")).withColumn(
        "split", F.when(F.col("pos") > train_upto, "test").otherwise("train")
    )
