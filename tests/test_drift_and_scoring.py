import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import drift, scoring
from tidewatch.streaming.drift import window_drift

STATS = [("a", 10.0, 2.0), ("b", 0.0, 1.0), ("c", 5.0, 0.0)]


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_psi(spark):
    tenth = [F.lit(0.1)] * 10
    shifted = [F.lit(0.01)] * 5 + [F.lit(0.19)] * 5
    assert one(spark, drift.psi(tenth, tenth)) == 0.0
    assert one(spark, drift.psi(tenth, shifted)) > 0.1


@pytest.mark.parametrize("psi,shift,want", [(0.05, 1, "stable"), (0.15, 1, "warning"), (0.05, 2.5, "warning"), (0.3, 1, "critical"), (0.05, -3.5, "critical")])
def test_classes(spark, psi, shift, want):
    assert one(spark, drift.classify(F.lit(psi), F.lit(float(shift)))) == want


def test_normal_shares():
    shares = drift.normal_shares()
    assert sum(shares) == pytest.approx(1.0)
    assert shares[:5] == pytest.approx([0.0081975359, 0.0277327832, 0.0791393511, 0.1591834475, 0.2257468822], abs=1e-9)


def rows(spark, n, seed=0, move=0.0):
    rng = np.random.default_rng(seed)
    data = [("s", i, float(a), float(b), 5.0) for i, (a, b) in enumerate(zip(rng.normal(10 + move, 2, n), rng.normal(0, 1, n)))]
    return spark.createDataFrame(data, "sensor_id string, pos bigint, a double, b double, c double")


def test_edges_of_the_histogram(spark):
    df = spark.createDataFrame([("s", v, 0.0, 5.0) for v in (4.0, 3.9, -100.0, 16.0, 16.1, 100.0, 10.0)], "sensor_id string, a double, b double, c double")
    got = {r["bin"]: r["n"] for r in drift.histogram(df, ["sensor_id"], STATS).where("feature = 'a'").collect()}
    assert got == {0: 3, 9: 3, 5: 1}


def test_waiting_below_fifty_rows(spark):
    for n, text in ((49, "Waiting for more data"), (50, None)):
        out = drift.check(rows(spark, n, move=30), ["sensor_id"], STATS, [F.col("pos")]).first()
        assert (out["recommendation"] == "Waiting for more data") == (text is not None)


def test_check_of_a_shifted_sensor(spark):
    out = drift.check(rows(spark, 600, move=8), ["sensor_id"], STATS, [F.col("pos")]).first()
    assert out["status"] == "critical" and out["n_rows"] == 500 and out["affected_features"] == ["a"]
    assert out["recommendation"] == "Retraining recommended" and out["mean_shift_sigma"] > 3
    assert drift.check(rows(spark, 60), ["sensor_id"], [], [F.col("pos")]).first()["recommendation"] == "No baseline stats available"


def test_stream_kernel_equals_the_aggregate(spark):
    df = rows(spark, 300, 3, 1.0)
    batch = {r["feature"]: r for r in drift.feature_drift(df, ["sensor_id"], STATS).collect()}
    window = df.orderBy("pos").select("a", "b", "c").toPandas().to_numpy()
    for feature, _, n, psi, shift, status in window_drift(window, STATS):
        assert batch[feature]["n"] == n and batch[feature]["status"] == status
        assert batch[feature]["shift"] == pytest.approx(shift)
        assert (psi is None and batch[feature]["psi"] is None) or batch[feature]["psi"] == pytest.approx(psi)


def test_history_keeps_the_newest(spark):
    rows_ = spark.range(150).select(F.timestamp_seconds("id").alias("timestamp"), F.lit("stable").alias("status"), F.lit(0.1).alias("psi"))
    kept = drift.append_history(rows_.limit(0), rows_)
    assert kept.count() == 100 and drift.latest_status(kept).first()["timestamp"].minute == 2
    assert drift.latest_status(rows_.limit(0)).first()["status"] == "stable"


def test_explanation(spark):
    stats = [("roll_std_15", 0.2, 0.05), ("zscore_15", 0.0, 1.0)]
    df = spark.createDataFrame([(1.2, 0.5)], "roll_std_15 double, zscore_15 double")
    out = scoring.explain(df, stats).first()
    assert out["feature"] == "roll_std_15" and "20.0 std devs" in out["reason"] and "monitor system" in out["reason"]
    tie = scoring.explain(spark.createDataFrame([(0.25, 1.0)], "roll_std_15 double, zscore_15 double"), [("roll_std_15", 0.2, 0.05 - 1e-9), ("zscore_15", 0.0, 1.0 - 1e-9)]).first()
    assert math.isclose(tie["deviation"], 1.0, rel_tol=1e-6)
    assert "missing" in scoring.explain(df, []).first()["reason"]


def test_tie_goes_to_the_first_feature(spark):
    df = spark.createDataFrame([(2.0, 2.0)], "x double, y double")
    assert scoring.explain(df, [("y", 0.0, 1.0), ("x", 0.0, 1.0)]).first()["feature"] == "y"


def test_severity_bounds(spark):
    got = [one(spark, scoring.severity(F.lit(s), F.lit(1.0))) for s in (1.0, 1.5, 2.0, 3.9, 4.0)]
    assert got == ["none", "low", "medium", "medium", "high"]


def test_half_of_the_votes_are_enough(spark):
    df = spark.createDataFrame([(2.0, 0.0, None, 2.0), (2.0, 0.0, None, 0.0)], "a double, b double, c double, d double")
    out = scoring.ensemble_vote(df, {m: (m, 1.0) for m in "abcd"}).collect()
    assert [(r["votes"], r["is_anomaly"]) for r in out] == [(2, True), (1, False)]
    assert out[0]["message"] == "2 of 4 agree → anomaly, 50%" and set(out[0]["model_details"]) == {"a", "b", "d"}


def test_fallbacks(spark):
    df = spark.createDataFrame([(None, 9.0), (1.0, None), (1.0, 9.0)], "value double, score double")
    out = scoring.decide(df, F.lit(1.0), F.lit("m"), F.lit("why")).collect()
    assert [(r["anomaly_score"], r["severity"], r["reason"], r["model"]) for r in out] == [
        (0.0, "none", "Missing value injected", "none"),
        (0.0, "none", "Model or features not loaded", "none"),
        (9.0, "high", "why", "m"),
    ]


def test_explanation_with_a_baseline_of_one_row(spark):
    from tidewatch.operators import scoring

    df = spark.createDataFrame([(5.0, 1.0)], "a double, b double")
    row = scoring.explain(df, [("a", 5.0, None), ("b", None, None)]).first()
    assert row["feature"] == "a" and row["deviation"] == 0.0
