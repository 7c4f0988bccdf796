import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_features import by_pandas, walk
from tests.test_streaming import frame
from tidewatch.operators import features
from tidewatch.plans.streaming_queries import STREAM_SCHEMA
from tidewatch.streaming import buffer, chunked, scoring, sources


def run(spark, tmp_path, parts, sink=None):
    inbox = str(tmp_path / "in")
    sink = sink or chunked.ChunkedFeatures(spark, str(tmp_path / "out"))
    for part in parts:
        frame(spark, part).write.mode("append").parquet(inbox)
        scoring.run_available(sources.reading_stream(spark, inbox, STREAM_SCHEMA), str(tmp_path / "cp"), sink)
    return chunked.read_features(spark, sink.root)


def test_restart_order_late_and_missing(spark, tmp_path):
    values = walk(90, 4)
    first = [("s", i, float(values[i])) for i in range(40)][::-1] + [("t", 0, 1.0)]
    second = [("s", i, float(values[i])) for i in range(40, 90)] + [("s", 3, 99.0), ("t", 1, None), ("t", 2, 2.0)]
    out = run(spark, tmp_path, [first, second])
    s = out.where("sensor_id = 's'")
    assert [r["value"] for r in s.where("late").collect()] == [99.0]
    got = s.where("not late").orderBy("seq").select(features.FEATURES).toPandas()
    for i in (0, 39, 40, 64, 65, 89):
        want = by_pandas(values[max(0, i - 64) : i + 1]).iloc[-1].fillna(0.0)
        assert np.allclose(got.iloc[i], want), i
    t = {r["seq"]: r for r in out.where("sensor_id = 't'").collect()}
    assert t[1]["lag_1"] is None and t[2]["lag_1"] == 1.0


def test_a_hot_sensor_equals_the_keyed_buffer(spark, tmp_path):
    hot, cold = walk(6000, 1), walk(300, 2)
    rows = [("hot", i, float(v)) for i, v in enumerate(hot)] + [(f"c{i % 3}", i // 3, float(v)) for i, v in enumerate(cold)]
    parts = [[r for r in rows if r[1] < 2000], [r for r in rows if r[1] >= 2000]]
    got = run(spark, tmp_path, parts)
    sources.use_rocksdb(spark)
    keyed = buffer.online_features(frame(spark, rows))
    a, b = (d.orderBy("sensor_id", "seq").toPandas() for d in (got, keyed))
    assert a[["sensor_id", "seq", "late"]].equals(b[["sensor_id", "seq", "late"]])
    assert np.allclose(a[features.FEATURES].astype(float), b[features.FEATURES].astype(float), atol=1e-9)


def test_a_hot_sensor_is_spread_over_tasks(spark):
    rows = frame(spark, [("hot", i, float(i % 7)) for i in range(20_000)])
    out, _ = chunked.features_of_batch(rows, spark.createDataFrame([], chunked.STATE))
    plan = out._jdf.queryExecution().executedPlan().toString()
    # By sensor alone only the state's few rows and their join may go; the readings go by stretch and by chunk.
    keys = [line.split("hashpartitioning(")[1].split("REPARTITION")[0] for line in plan.splitlines() if "REPARTITION_BY_COL" in line]
    assert any("_chunk" in k for k in keys) and any("_span" in k for k in keys)
    placed = out.select(F.floor(F.col("seq") / 1024).alias("c")).distinct().count()
    assert placed == 20


def test_a_replayed_batch_writes_the_same_again(spark, tmp_path):
    values = walk(200, 3)
    sink = chunked.ChunkedFeatures(spark, str(tmp_path / "out"))
    parts = [frame(spark, [("s", i, float(values[i])) for i in range(a, a + 100)]) for a in (0, 100)]
    for batch_id, part in enumerate(parts):
        sink(part, batch_id)
    once = chunked.read_features(spark, sink.root).orderBy("seq").toPandas()
    sink(parts[1], 1)
    again = chunked.read_features(spark, sink.root).orderBy("seq").toPandas()
    assert once.equals(again) and len(again) == 200


def test_warm_start_and_second_start(spark, tmp_path):
    values = walk(130, 5)
    warm = frame(spark, [("s", i, float(values[i])) for i in range(100)])
    sink = chunked.ChunkedFeatures(spark, str(tmp_path / "out"), warm)
    chunked.ChunkedFeatures(spark, sink.root)  # a restarted query keeps the versions it finds
    out = run(spark, tmp_path, [[("s", i, float(values[i])) for i in range(100, 130)]], sink)
    got = out.orderBy("seq").select(features.FEATURES).toPandas()
    want = by_pandas(values[100 - 64 : 101]).iloc[-1].fillna(0.0)
    assert np.allclose(got.iloc[0], want)


@pytest.mark.parametrize("rows", [[], [("s", 0, None)]])
def test_nothing_to_buffer(spark, rows):
    out, state = chunked.features_of_batch(frame(spark, rows), spark.createDataFrame([], chunked.STATE))
    assert out.count() == len(rows) and state.count() == 0
