import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import drift

STATS = [("a", 0.0, 1.0), ("b", 2.0, 0.5), ("c", 1.0, 0.0)]


def rows(spark, sizes, seed=1):
    rng = np.random.default_rng(seed)
    parts = []
    for s, n in sizes.items():
        part = pd.DataFrame({"sensor_id": s, "pos": np.arange(n), "a": rng.normal(0, 1, n) + (np.arange(n) > 120) * 2.5, "b": rng.normal(2, 0.5, n), "c": 1.0})
        part.loc[: min(5, n - 1), "b"] = np.nan  # a warm-up
        parts.append(part)
    return spark.createDataFrame(pd.concat(parts)).withColumn("b", F.when(~F.isnan("b"), F.col("b")))


@pytest.mark.parametrize("stretch", [64, 100, 2048])
def test_equal_to_a_check_at_each_reading(spark, stretch):
    table = rows(spark, {"s": 230, "t": 40, "u": 1})
    got = {(r["sensor_id"], r["pos"]): r for r in drift.at_every_reading(table, STATS, size=90, stretch=stretch).collect()}
    assert len(got) == 271
    for sensor, pos in (("s", 0), ("s", 48), ("s", 49), ("s", 50), ("s", 89), ("s", 100), ("s", 163), ("s", 229), ("t", 39), ("u", 0)):
        live = table.where((F.col("sensor_id") == sensor) & F.col("pos").between(pos - 89, pos))
        want = drift.roll_up(drift.feature_drift(live, ["sensor_id"], STATS), ["sensor_id"]).first()
        r = got[sensor, pos]
        assert (r["n_rows"], r["status"], r["affected_features"], r["recommendation"]) == (
            want["n_rows"], want["status"], want["affected_features"], want["recommendation"],
        ), (sensor, pos)
        assert np.isclose(r["psi"], want["psi"]) and np.isclose(r["mean_shift_sigma"], want["mean_shift_sigma"])


def test_groups_are_bounded_and_tables_may_be_empty(spark):
    table = rows(spark, {"s": 230})
    assert drift.at_every_reading(table.limit(0), STATS).count() == 0
    sent = drift.at_every_reading(table, STATS, size=90, stretch=64)
    assert "hashpartitioning(sensor_id" in sent._jdf.queryExecution().executedPlan().toString()
