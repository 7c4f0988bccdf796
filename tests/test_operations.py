import pytest
from pyspark.sql import functions as F

from tests.conftest import at
from tidewatch.operators import alerts, faults, registry


def readings(spark, n=200, hits=(5, 100)):
    return spark.range(1, n + 1).select(
        "id", F.timestamp_seconds(F.col("id") * 60).alias("ts"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("sensor_id"),
        F.col("id").cast("double").alias("value"), F.lit(2.5).alias("anomaly_score"), F.col("id").isin(*hits).alias("is_anomaly"),
        F.lit("low").alias("severity"), F.lit("why").alias("reason"), F.lit(0.5).alias("inference_ms"),
    )


def test_alert_life(spark):
    rows = alerts.derive_alerts(readings(spark))
    assert [(r["id"], r["reading_id"], r["status"]) for r in rows.orderBy("id").collect()] == [(1, 5, "new"), (2, 100, "new")]
    updates = spark.createDataFrame(
        [(1, "investigating", "look", at("2024-01-01"), 1), (2, "resolved", None, at("2024-01-02"), 2), (2, "paused", "x", at("2024-01-03"), 3)],
        "alert_id bigint, status string, note string, at timestamp, seq bigint",
    )
    out = {r["id"]: r for r in alerts.apply_status(rows, updates).collect()}
    assert (out[1]["status"], out[1]["operator_note"], out[1]["resolved_at"]) == ("investigating", "look", None)
    assert (out[2]["status"], out[2]["resolved_at"]) == ("resolved", at("2024-01-02"))
    assert alerts.rejected_updates(updates).count() == 1
    acked = alerts.acknowledge(rows, spark.createDataFrame([(2,), (2,), (77,)], "alert_id bigint"))
    assert [(r["id"], r["acknowledged"]) for r in acked.orderBy("id").collect()] == [(1, False), (2, True)]
    assert alerts.list_alerts(acked, acknowledged=True).count() == 1
    gone, count = alerts.clear_alerts(rows)
    assert gone.count() == 0 and count.first()["deleted"] == 2


def test_replay_and_incident(spark):
    rows = readings(spark)
    hits = alerts.derive_alerts(rows)
    got = {r["alert_id"]: (r["lo"], r["hi"]) for r in alerts.replay(hits, rows).groupBy("alert_id").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).collect()}
    assert got == {1: (1, 35), 2: (70, 130)}
    centre = [r["reading_id"] for r in alerts.incident(hits, rows).where("alert_id = 2").orderBy("place").collect()]
    assert centre == list(range(95, 106))
    own = alerts.replay_by_sensor(hits, rows, context=2).where("alert_id = 2")
    assert sorted(r["id"] for r in own.collect()) == [96, 98, 100, 102, 104]


def test_kpis_and_rates(spark):
    runs = spark.createDataFrame([(1, "old", *[0.1] * 6), (2, "new", *[0.123456789] * 6)], "id bigint, model string, precision double, recall double, f1 double, pr_auc double, roc_auc double, threshold double")
    out = alerts.kpis(readings(spark), runs).first()
    assert (out["total_readings"], out["total_anomalies"], out["anomaly_rate"], out["latest_model"]) == (200, 2, 1.0, "new")
    assert out["latest_precision"] == 0.1235 and out["latest_threshold"] == 0.123457
    empty = alerts.kpis(readings(spark).limit(0), runs.limit(0)).first()
    assert (empty["total_readings"], empty["anomaly_rate"], empty["latest_model"]) == (0, 0.0, None)
    assert alerts.stream_rate(readings(spark), "1970-01-01 01:00:00").first()[0] == 2
    assert [r["id"] for r in alerts.latest_readings(readings(spark), 3).collect()] == [198, 199, 200]


def entry(name, at_, seq, threshold=1.0, path="p"):
    return (name, path, threshold, None, False, at(at_), seq)


SCHEMA = "name string, artifact_path string, threshold double, metrics map<string,double>, is_production boolean, registered_at timestamp, seq bigint"


def test_registry(spark):
    old = spark.createDataFrame([entry("m", "2030-01-01", 1), entry("rolling_zscore", "2024-01-01", 2), entry("x", "2024-01-01", 3, path=None)], SCHEMA)
    new = spark.createDataFrame([("m", "q", 3.0, {"threshold": 7.0}, False, at("2024-02-01"), 4)], SCHEMA)
    reg = registry.upsert(old, new)
    assert reg.count() == 3 and registry.get(reg, "m").first()["threshold"] == 3.0
    assert [r["name"] for r in registry.set_production(reg, "m").where("is_production").collect()] == ["m"]
    assert registry.set_production(reg, "none").where("is_production").count() == 0
    picked = {r["name"]: (r["threshold"], r["outcome"]) for r in registry.select_model(reg).collect()}
    assert picked == {"m": (7.0, "ok"), "rolling_zscore": (None, "refused: baseline"), "x": (None, "refused: no artifact")}
    assert registry.select_model(reg, "unknown").count() == 0


def schedule(spark, kind, steps, size, minute=0, fault=1):
    return spark.createDataFrame([(fault, "s", kind, at(f"2024-01-01 00:{minute:02d}:00"), steps, float(size))], "fault_id bigint, sensor_id string, fault_type string, start timestamp, duration_steps int, magnitude double")


@pytest.mark.parametrize(
    "kind,steps,size,values,want",
    [
        ("spike", 10, 50, [10.0] * 4, [60, 60, 60, 10]),
        ("gradual_drift", 10, 100, [0.0, 0.0], [0, 10]),
        ("sensor_stuck", 10, 0, [15.0, 20.0], [15, 15]),
        ("missing_values", 10, 0, [10.0], [None]),
        ("overheating", 10, 100, [0.0] * 3, [0, 1, 4]),
        ("spike", 2, 5, [1.0] * 4, [6, 6, 1, 1]),
        ("vibration_fault", 10, 50, [1.0], [1]),
        ("whatever", 10, 50, [1.0], [1]),
    ],
)
def test_fault_formulas(spark, series, kind, steps, size, values, want):
    df = series([("s", 5 * i, v) for i, v in enumerate(values)])
    out = faults.inject(df, schedule(spark, kind, steps, size)).orderBy("ts").collect()
    assert [r["injected"] for r in out] == want


def test_fault_hits_only_its_sensor_and_a_new_fault_replaces(spark, series):
    df = series([(s, 5 * i, 0.0) for i in range(8) for s in "st"])
    both = schedule(spark, "gradual_drift", 8, 8).unionByName(schedule(spark, "spike", 2, 50, minute=10, fault=2))
    out = faults.inject(df, both)
    assert out.where("sensor_id = 't' and fault_id is not null").count() == 0
    got = [(r["fault_id"], r["injected"]) for r in out.where("sensor_id = 's'").orderBy("ts").collect()]
    assert got == [(1, 0.0), (1, 1.0), (2, 50.0), (2, 50.0)] + [(None, 0.0)] * 4


def test_long_fault_spans_buckets(spark, series):
    n = faults.CHUNK * 2 + 5
    df = series([("s", 5 * i, 1.0) for i in range(n)])
    out = faults.inject(df, schedule(spark, "gradual_drift", n, n))
    last = out.orderBy(F.col("ts").desc()).first()
    assert last["step"] == n - 1 and last["injected"] == pytest.approx(n)


def test_noise_is_repeatable_and_normal(spark, series):
    df = series([("s", 5 * i, 0.0) for i in range(3000)])
    a, b = (faults.inject(df.repartition(k), schedule(spark, "noise_burst", 3000, 2)).agg(F.avg("injected"), F.stddev("injected")).first() for k in (1, 4))
    assert a[0] == pytest.approx(b[0]) and abs(a[0]) < 0.2 and a[1] == pytest.approx(2, abs=0.15)


def test_status_and_refusal(spark):
    s = schedule(spark, "spike", 3, 1)
    for when, step, active in (("2023-12-31 23:59:00", 0, False), ("2024-01-01 00:05:00", 2, True), ("2024-01-01 01:00:00", 3, False)):
        r = faults.fault_status(s, when).first()
        assert (r["step"], r["active"]) == (step, active)
    assert faults.rejected_requests(schedule(spark, "vibration_fault", 1, 1)).count() == 1


@pytest.mark.parametrize("nth,start,first", [(0, 0, 0), (0, 7, 7), (0, 999, 0), (1, 0, 10), (2, 0, 100), (3, 4, 4)])
def test_replay_start(spark, nth, start, first):
    label = F.when(F.col("id").between(60, 70) | F.col("id").between(150, 151), 1).otherwise(0)
    rows = spark.range(200).select(F.lit("s").alias("sensor_id"), F.col("id").alias("pos"), label.alias("label"))
    assert faults.replay_from_anomaly(rows, nth, start).agg(F.min("pos")).first()[0] == first
