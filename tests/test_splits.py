import pytest
from pyspark.sql import functions as F

from tests.conftest import at
from tidewatch.operators import splits


def test_labels_are_inclusive(series):
    df = series([("s", t, 1.0) for t in ("2013-12-10 06:20:00", "2013-12-10 06:30:00", "2013-12-12 05:30:00", "2013-12-12 05:35:00", "2013-12-12 05:40:00")])
    out = splits.label_windows(df, splits.MACHINE_TEMPERATURE_WINDOWS).orderBy("ts").collect()
    assert [r["label"] for r in out] == [0, 1, 1, 1, 0]


def test_table_labels_do_not_multiply_rows(spark, series):
    df = series([("s", 5 * i, 1.0) for i in range(1000)] + [("t", 0, 1.0)])
    spans = [("s", at("2024-01-01 01:00:00"), at("2024-01-02 01:00:00")), ("s", at("2024-01-01 02:00:00"), at("2024-01-01 03:00:00")), ("s", at("2024-01-02 00:00:00"), at("2024-01-02 02:00:00"))]
    known = spark.createDataFrame(spans, "sensor_id string, start timestamp, end timestamp")
    out = splits.label_from_table(df, known)
    assert out.count() == 1001
    assert out.agg(F.sum("label")).first()[0] == 25 * 12 + 1


def grid(spark, n, labels=()):
    return spark.range(n).select(
        F.lit("s").alias("sensor_id"), F.col("id").alias("pos"), F.lit(n).alias("n_rows"),
        F.when(F.col("id").isin(*labels), 1).otherwise(0).alias("label"), F.col("id").cast("double").alias("value"),
        F.timestamp_seconds(F.col("id") * 300).alias("ts"),
    )


def test_split_sizes_and_order(spark):
    out = splits.chronological_split(grid(spark, 100))
    assert {r["split"]: r["count"] for r in out.groupBy("split").count().collect()} == {"train": 70, "val": 15, "test": 15}
    report = splits.leakage_report(out).first()
    assert report["in_order"] and report["burn_in_anomalies"] == 0


def test_burn_in_leaves_anomalies_out(spark):
    kept = splits.burn_in(grid(spark, 100, [3]))
    assert sorted(r["pos"] for r in kept.collect()) == [0, 1, 2, 4, 5, 6, 7, 8, 9]


def test_split_off_grid_equals_grid_rule(series):
    df = series([("s", 3 * i + (i % 2), float(i)) for i in range(100)])
    out = splits.split_off_grid(df)
    assert {r["split"]: r["count"] for r in out.groupBy("split").count().collect()} == {"train": 70, "val": 15, "test": 15}


def test_scaler_population_deviation_and_constant(spark):
    df = spark.createDataFrame([("a", 10.0), ("a", 11.0), ("a", 12.0), ("b", 5.0), ("b", 5.0)], "sensor_id string, value double")
    fitted = {r["sensor_id"]: (r["mean"], r["scale"]) for r in splits.fit_scaler(df).collect()}
    assert fitted["a"] == pytest.approx((11.0, (2 / 3) ** 0.5)) and fitted["b"] == (5.0, 1.0)
    out = splits.apply_scaler(df, splits.fit_scaler(df)).where("sensor_id = 'b'").collect()
    assert [r["value_scaled"] for r in out] == [0.0, 0.0]


def test_retraining_extract_positions(spark):
    readings = spark.range(30).select(
        F.col("id"), F.lit("s").alias("sensor_id"), F.current_timestamp().alias("ts"), F.lit(1.0).alias("value"), (F.col("id") % 2 == 0).alias("is_anomaly")
    )
    out = splits.retraining_extract(readings, size=10, train_upto=7).orderBy("pos").collect()
    assert [r["id"] for r in out] == list(range(20, 30))
    assert [r["split"] for r in out].count("train") == 8


def test_prefix_split(spark):
    out = splits.prefix_split(spark.range(10), "id", 4).orderBy("id").collect()
    assert [r["is_normal"] for r in out] == [1] * 4 + [0] * 6
