import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tests.test_features import walk
from tests.test_streaming import frame
from tidewatch.operators import drift as batch_drift
from tidewatch.operators.detectors import halfspace
from tidewatch.streaming import drift, scoring, sources, trees

NAMES = ["a", "b", "c"]


def delivered(spark, tmp_path, rows, cuts, build, schema):
    """Rows in micro-batches of their own, with a restart between them."""
    sources.use_rocksdb(spark)
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    for lo, hi in zip(cuts, cuts[1:]):
        rows.where(F.col("seq").between(lo, hi - 1)).write.mode("append").parquet(inbox)
        scoring.run_available(build(sources.reading_stream(spark, inbox, rows.schema)), str(tmp_path / "cp"), out)
    return spark.read.schema(schema).parquet(out)


def unit_rows(spark, sizes, seed=3):
    rng = np.random.default_rng(seed)
    parts = [
        pd.DataFrame({"sensor_id": s, "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(n) * 5, unit="min"), "seq": np.arange(n)})
        .assign(**{c: rng.beta(2, 3, n) for c in NAMES})
        for s, n in sizes.items()
    ]
    return spark.createDataFrame(pd.concat(parts)).repartition(3)


def test_trees_equal_the_batch_form_over_restarts(spark, tmp_path):
    rows = unit_rows(spark, {"s": 180, "t": 95, "u": 7})
    build = lambda d: trees.tree_scores(d, NAMES, trees=7, height=4, window=40)
    got = delivered(spark, tmp_path, rows, [0, 33, 80, 81, 180], build, trees.OUTPUT)
    want = halfspace.prequential(rows.withColumn("pos", F.col("seq")), NAMES, ["sensor_id"], trees=7, height=4, window=40)
    a, b = (d.toPandas().sort_values(["sensor_id", k]).reset_index(drop=True) for d, k in ((got, "seq"), (want, "pos")))
    assert len(a) == 282 and a["score"].isna().sum() == 40 + 40 + 7
    assert a["score"].isna().equals(b["score"].isna()) and np.allclose(a["score"].dropna(), b["score"].dropna())


def test_drift_of_all_sensors_equals_the_batch_check(spark, tmp_path):
    rows = unit_rows(spark, {"s": 120, "t": 90, "u": 30})
    stats = [("a", 0.4, 0.2), ("b", 0.1, 0.1), ("c", 0.4, 0.0)]
    got = delivered(spark, tmp_path, rows, [0, 50, 51, 120], lambda d: drift.drift_of_all(d, stats, 70), drift.OUTPUT)
    last = got.groupBy("feature").agg(F.max_by(F.struct("n", "psi", "shift", "status"), F.struct("as_of", "n")).alias("d")).select("feature", "d.*")
    live = batch_drift.live_window(rows, [], [F.col("ts"), F.col("sensor_id")], 70).withColumn("scope", F.lit("all"))
    want = batch_drift.feature_drift(live, ["scope"], stats)
    a, b = (d.select("feature", "n", "psi", "shift", "status").orderBy("feature").collect() for d in (last, want))
    for x, y in zip(a, b, strict=True):
        assert (x["feature"], x["n"], x["status"]) == (y["feature"], y["n"], y["status"])
        assert (x["psi"] is None) == (y["psi"] is None) and np.isclose(x["psi"] or 0, y["psi"] or 0) and np.isclose(x["shift"], y["shift"])
