import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_features import by_pandas, walk
from tidewatch.operators import features
from tidewatch.plans.streaming_queries import STREAM_SCHEMA
from tidewatch.schemas import ALERTS
from tidewatch.streaming import buffer, drift, scoring, sources

ORIGIN = datetime.datetime(2024, 1, 1)


def frame(spark, rows):
    """rows: (sensor, slot, value or None)"""
    data = [(s, ORIGIN + datetime.timedelta(minutes=5 * i), i, v, v) for s, i, v in rows]
    return spark.createDataFrame(data, STREAM_SCHEMA)


def run(spark, tmp_path, parts, build, schema):
    sources.use_rocksdb(spark)
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in parts:
        frame(spark, part).write.mode("append").parquet(inbox)
        scoring.run_available(build(sources.reading_stream(spark, inbox, STREAM_SCHEMA)), str(tmp_path / "cp"), out)
    return spark.read.schema(schema).parquet(out)


def test_kernel_equals_pandas():
    values = walk(150, 3)
    table = buffer.buffer_features(values[:20][-64:], values[20:])
    for i in (20, 40, 64, 65, 100, 149):
        want = by_pandas(values[max(0, i - 64) : i + 1]).iloc[-1].fillna(0.0)
        # the kernel only knows 20 old values, which is all there are
        assert np.allclose(table[i - 20], want), i


def test_restart_order_late_and_missing(spark, tmp_path):
    values = walk(90, 4)
    first = [("s", i, float(values[i])) for i in range(40)][::-1] + [("t", 0, 1.0)]
    second = [("s", i, float(values[i])) for i in range(40, 90)] + [("s", 3, 99.0), ("t", 1, None), ("t", 2, 2.0)]
    out = run(spark, tmp_path, [first, second], buffer.online_features, buffer.OUTPUT)
    s = out.where("sensor_id = 's'")
    assert [r["value"] for r in s.where("late").collect()] == [99.0]
    got = s.where("not late").orderBy("seq").select(features.FEATURES).toPandas()
    for i in (0, 39, 40, 64, 65, 89):
        want = by_pandas(values[max(0, i - 64) : i + 1]).iloc[-1].fillna(0.0)
        assert np.allclose(got.iloc[i], want), i
    t = {r["seq"]: r for r in out.where("sensor_id = 't'").collect()}
    assert t[1]["lag_1"] is None and t[2]["lag_1"] == 1.0  # the missing value was not buffered


def test_warm_start(spark, tmp_path):
    values = walk(130, 5)
    past = frame(spark, [("s", i, float(values[i])) for i in range(100)])
    warm = buffer.warm_rows(past)
    assert warm.count() == 65
    out = run(spark, tmp_path, [[("s", i, float(values[i])) for i in range(100, 130)]], lambda d: buffer.online_features(d, warm), buffer.OUTPUT)
    row = out.where("seq = 100").first()
    want = by_pandas(values[36:101]).iloc[-1]
    assert row["ewma_60"] == pytest.approx(want["ewma_60"]) and row["roll_mean_60"] == pytest.approx(want["roll_mean_60"])


def test_scoring_without_model_and_idempotent_sink(spark, tmp_path):
    sources.use_rocksdb(spark)
    scaler = spark.createDataFrame([("s", 0.0, 1.0)], "sensor_id string, mean double, scale double")
    frame(spark, [("s", i, float(i)) for i in range(5)]).select("sensor_id", "ts", "seq", "value").write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    stream = sources.reading_stream(spark, str(tmp_path / "in"), schema, files_per_trigger=100)
    scored = scoring.score_stream(stream, scaler, None, 0.5, "m", [])
    sink = scoring.table_sink(str(tmp_path / "tables"))
    scoring.run_available(scored, str(tmp_path / "cp"), lambda b, i: (sink(b, i), sink(b, i))[0])
    rows = scoring.read_sink(spark, str(tmp_path / "tables"), "readings").collect()
    assert len(rows) == 5 and {r["reason"] for r in rows} == {"Model or features not loaded"}


def test_a_sensor_without_scaler_is_scored_on_its_raw_value(spark, tmp_path):
    sources.use_rocksdb(spark)

    class RocScore:
        def transform(self, df, name="score"):
            return df.withColumn(name, F.abs("roc"))

    scaler = spark.createDataFrame([("s", 0.0, 2.0)], "sensor_id string, mean double, scale double")
    rows = [("s", i, 50.0 if i == 10 else 1.0) for i in range(20)] + [("new", i, 30.0 if i == 5 else 1.0) for i in range(9)]
    frame(spark, rows).select("sensor_id", "ts", "seq", "value").write.parquet(str(tmp_path / "in"))
    stream = sources.reading_stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
    scored = scoring.score_stream(stream, scaler, RocScore(), 10.0, "roc", [("roc", 0.0, 1.0)])
    scoring.run_available(scored, str(tmp_path / "cp"), scoring.table_sink(str(tmp_path / "t")))
    kept = scoring.read_sink(spark, str(tmp_path / "t"), "readings").collect()
    assert len(kept) == 29
    assert sorted((r["sensor_id"], r["seq"]) for r in kept if r["is_anomaly"]) == [("new", 5), ("new", 6), ("s", 10), ("s", 11)]
    assert len({r["id"] for r in kept}) == 29
    raised = scoring.read_sink(spark, str(tmp_path / "t"), "alerts")
    assert raised.drop("batch_id").columns == [f.name for f in ALERTS.fields] and raised.count() == 4
    assert {r["reading_id"] for r in raised.collect()} == {r["id"] for r in kept if r["is_anomaly"]}


def test_watermark_drops_and_counts(spark, tmp_path):
    inbox = str(tmp_path / "in")
    schema = STREAM_SCHEMA
    out = str(tmp_path / "out")
    parts = [[("s", 0, 1.0), ("s", 100, 2.0)], [("s", 1, 5.0), ("s", 101, 3.0)], [("s", 400, 1.0)]]
    dropped = 0
    for part in parts:
        frame(spark, part).write.mode("append").parquet(inbox)
        query = scoring.run_available(scoring.running_kpis(sources.reading_stream(spark, inbox, schema), "1 hour"), str(tmp_path / "cp"), out)
        dropped += scoring.dropped_late(query)
    got = spark.read.parquet(out)
    assert dropped == 1 and got.where("mean_value = 5.0").count() == 0 and got.count() >= 2


def test_drift_window_is_bounded(spark, tmp_path):
    sources.use_rocksdb(spark)
    stats = [("value", 0.0, 1.0)]
    parts = [[("s", i, 0.1) for i in range(300)], [("s", i, 5.0) for i in range(300, 800)]]
    out = run(spark, tmp_path, parts, lambda d: drift.drift_stream(d, stats), drift.OUTPUT)
    last = out.orderBy(F.col("as_of").desc()).first()
    assert last["n"] == 500 and last["shift"] == pytest.approx(5.0, abs=1e-6) and last["status"] == "critical"


def test_request_validation(spark):
    df = spark.createDataFrame([(None, "s", 1.0), (ORIGIN, None, 1.0), (ORIGIN, "s", None)], "ts timestamp, sensor_id string, value double")
    good, bad = sources.requests(df)
    assert good.count() == 1 and bad.count() == 2
