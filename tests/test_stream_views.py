import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import alerts as batch_alerts
from tidewatch.operators import evaluate
from tidewatch.operators.detectors import halfspace, store
from tidewatch.streaming import replay, runs, scoring, serving, sources

ORIGIN = datetime.datetime(2024, 1, 1)
FLAGS = "model string, sensor_id string, ts timestamp, pos bigint, label int, pred int"


def slot(i):
    return ORIGIN + datetime.timedelta(minutes=5 * i)


def flagged(spark, sensors):
    rows = [("m", s, slot(i), i, int(a), int(b)) for s, (label, pred) in sensors.items() for i, (a, b) in enumerate(zip(label, pred))]
    return spark.createDataFrame(rows, FLAGS)


def streamed(spark, tmp_path, rows, cuts, build, schema):
    sources.use_rocksdb(spark)
    for lo, hi in zip(cuts, cuts[1:]):
        rows.where(F.col("pos").between(lo, hi - 1)).write.mode("append").parquet(f"{tmp_path}/in")
        stream = sources.reading_stream(spark, f"{tmp_path}/in", rows.schema)
        scoring.run_available(build(stream), f"{tmp_path}/cp", f"{tmp_path}/out")
    return spark.read.schema(schema).parquet(f"{tmp_path}/out")


def test_advance_equals_the_batch_runs_however_it_is_cut():
    rng = np.random.default_rng(2)
    flag, other = rng.integers(0, 2, 200), rng.integers(0, 2, 200)
    pos, us = np.arange(200), np.arange(200) * 300_000_000
    whole, still = runs.advance(None, flag, other, pos, us)
    for cuts in ([0, 1, 2, 50, 200], [0, 99, 100, 101, 200]):
        run, parts = None, []
        for a, b in zip(cuts, cuts[1:]):
            closed, run = runs.advance(run, flag[a:b], other[a:b], pos[a:b], us[a:b])
            parts += closed
        assert parts == whole and run == still


def test_runs_close_by_rows_and_by_timers(spark, tmp_path):
    # s: a window over the restart, missed; a segment without truth. quiet: falls silent inside a segment.
    s = ("0011110000000000" + "0" * 60, "0000000110000000" + "0" * 60)
    rows = flagged(spark, {"s": s, "quiet": ("0011", "0001")})
    got = streamed(spark, tmp_path, rows, [0, 4, 76], runs.closed_runs, runs.OUTPUT).collect()
    found = {(r["kind"], r["sensor_id"]): (r["start"], r["length"], r["hit"], r["first_hit"], r["latency_min"], r["closed_by"]) for r in got}
    assert found == {
        ("window", "s"): (2, 4, 0, None, 20.0, "row"),
        ("segment", "s"): (7, 2, 0, None, 10.0, "row"),
        ("window", "quiet"): (2, 2, 1, 3, 5.0, "timer"),
        ("segment", "quiet"): (3, 1, 1, 3, 0.0, "timer"),
    }


def test_metrics_of_closed_runs_are_the_batch_s(spark):
    rng = np.random.default_rng(3)
    sensors = {f"s{k}": ("".join(map(str, rng.integers(0, 2, 40))) + "0", "".join(map(str, rng.integers(0, 2, 40))) + "0") for k in range(3)}
    rows = flagged(spark, sensors).withColumn("score", F.col("pred").cast("double"))
    closed = []
    for s, (label, pred) in sensors.items():
        a, b = np.array(list(map(int, label))), np.array(list(map(int, pred)))
        for kind, flag, other in (("segment", b, a), ("window", a, b)):
            for start, length, hit, first, _ in runs.advance(None, flag, other, np.arange(41), np.arange(41))[0]:
                closed.append((kind, "m", s, start, length, hit, first, 5.0 * (length if first is None else first - start), "row"))
    got = runs.latency_by_model(spark.createDataFrame(closed, runs.OUTPUT)).first()
    want = evaluate.window_metrics(rows).first()
    assert np.allclose(got[1:], want[1:])


def test_replay_context_arrives_on_both_sides_of_an_alert(spark, tmp_path):
    sources.use_rocksdb(spark)
    readings = spark.createDataFrame(
        [(i, slot(i), f"s{i % 2}", float(i), 0.5) for i in range(1, 301)], "id bigint, ts timestamp, sensor_id string, value double, anomaly_score double"
    )
    found = spark.createDataFrame([(1, 5, slot(5)), (2, 140, slot(140)), (3, 150, slot(150)), (4, 299, slot(299))], "id bigint, reading_id bigint, ts timestamp")
    for lo, hi in ((0, 141), (141, 400)):
        readings.where(F.col("id").between(lo, hi - 1)).write.mode("append").parquet(f"{tmp_path}/r")
        found.where(F.col("reading_id").between(lo, hi - 1)).write.mode("append").parquet(f"{tmp_path}/a")
        streams = [sources.reading_stream(spark, f"{tmp_path}/{n}", d.schema) for n, d in (("a", found), ("r", readings))]
        joined = replay.replay_stream(*streams)
        scoring.run_available(joined, f"{tmp_path}/cp", f"{tmp_path}/out")
    got = spark.read.schema(joined.schema).parquet(f"{tmp_path}/out")
    want = batch_alerts.replay(found, readings)
    columns = ["alert_id", "id", "sensor_id", "value"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))


@pytest.fixture
def server(spark, tmp_path):
    names = ["a", "b"]
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([(i, *map(float, rng.uniform(0, 1, 2))) for i in range(300)], "seq int, a double, b double")
    paths = {
        name: store.save(halfspace.fit(rows, names, ["seq"], trees=5, height=3, window=100, seed=seed), spark, f"{tmp_path}/{name}")
        for name, seed in (("first", 1), ("second", 2))
    }
    entries = [("first", paths["first"], 0.5, {}), ("second", paths["second"], 0.7, {"threshold": 0.9}), ("rolling_zscore", "x", 3.0, {}), ("bare", None, 1.0, {})]
    table = spark.createDataFrame(entries, "name string, artifact_path string, threshold double, metrics map<string,double>")
    serving.publish(table.withColumn("is_production", F.lit(False)), f"{tmp_path}/registry")
    live = rows.select(F.lit("s").alias("sensor_id"), F.lit(ORIGIN).alias("ts"), F.col("seq").cast("bigint").alias("seq"), "a", "b").limit(20)
    return serving.ModelServer(f"{tmp_path}/registry", f"{tmp_path}/out", names), live


def test_promotion_between_batches_changes_who_scores(spark, server):
    serve, live = server
    with pytest.raises(serving.RefusedModel):
        serve(live, 0)  # nothing is in production yet
    serving.promote(spark, serve.registry_root, "first")
    serve(live, 0)
    serving.promote(spark, serve.registry_root, "second")
    serve(live, 1)
    got = serving.read_predictions(spark, serve.root).groupBy("model", "registry_version", "threshold").count().orderBy("registry_version").collect()
    assert [tuple(r) for r in got] == [("first", 2, 0.5, 20), ("second", 3, 0.9, 20)]
    serve(live, 1)  # a replay writes its batch anew
    assert serving.read_predictions(spark, serve.root).count() == 40


@pytest.mark.parametrize("name", ["rolling_zscore", "bare", "nobody"])
def test_what_may_not_serve_is_refused_and_changes_nothing(spark, server, name):
    serve, _ = server
    before = serving.current(spark, serve.registry_root)[0]
    with pytest.raises(serving.RefusedModel):
        serving.promote(spark, serve.registry_root, name)
    assert serving.current(spark, serve.registry_root)[0] == before
