import random

import numpy as np

from tests.test_features import by_pandas, walk
from tests.test_streaming import frame
from tidewatch.operators import features
from tidewatch.plans.streaming_queries import STREAM_SCHEMA
from tidewatch.streaming import buffer, eventtime, scoring, sources


def run(spark, tmp_path, parts, delay=60, restart=False):
    """Each part is a file and a micro-batch of its own."""
    sources.use_rocksdb(spark)
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    for i, part in enumerate(parts):
        frame(spark, part).coalesce(1).write.mode("append").parquet(inbox)
        stream = sources.reading_stream(spark, inbox, STREAM_SCHEMA, files_per_trigger=1)
        if restart or i == len(parts) - 1:
            scoring.run_available(eventtime.ordered_features(stream, delay), str(tmp_path / "cp"), out)
    return spark.read.schema(buffer.OUTPUT).parquet(out)


def test_shuffled_deliveries_give_the_ordered_features(spark, tmp_path):
    values = walk(120, 4)
    arrival = sorted(range(120), key=lambda i: i + random.Random(i).uniform(0, 11))  # up to 55 minutes
    parts = [[("s", i, float(values[i])) for i in arrival[k : k + 30]] for k in range(0, 120, 30)]
    out = run(spark, tmp_path, parts, restart=True)
    got = out.orderBy("seq").toPandas()
    assert not got["late"].any()
    assert got["seq"].tolist() == list(range(119 - 12 + 1))  # up to an hour before the newest
    for i in (0, 3, 30, 64, 65, 107):
        want = by_pandas(values[max(0, i - 64) : i + 1]).iloc[-1].fillna(0.0)
        assert np.allclose(got[features.FEATURES].iloc[i].astype(float), want), i


def test_late_rows_go_to_the_side_table(spark, tmp_path):
    parts = [
        [("s", i, float(i)) for i in range(0, 30)],
        [("s", 40, 40.0)],
        [("s", 5, 99.0), ("s", 27, 27.5), ("t", 29, 1.0), ("s", 28, None), ("s", 41, 41.0)],  # the horizon is slot 28
        [("s", 70, 70.0)],
    ]
    out = run(spark, tmp_path, parts)
    late = eventtime.late_rows(out).collect()
    assert sorted((r["sensor_id"], r["seq"], r["value"]) for r in late if r["value"] is not None) == [("s", 5, 99.0), ("s", 27, 27.5)]
    assert [r["seq"] for r in late if r["value"] is None] == [28]
    kept = eventtime.on_time(out).toPandas()
    assert sorted(kept[kept["sensor_id"] == "s"]["seq"]) == [*range(30), 40, 41]
    row = kept[(kept["sensor_id"] == "s") & (kept["seq"] == 41)].iloc[0]
    assert row["lag_1"] == 40.0 and row["lag_2"] == 29.0


def test_a_silent_sensor_is_released_by_a_timer(spark, tmp_path):
    parts = [[("quiet", 3, 3.0), ("quiet", 1, 1.0)], [("loud", 50, 5.0)], [("loud", 90, 5.0)]]
    got = run(spark, tmp_path, parts).where("sensor_id = 'quiet'").orderBy("seq").collect()
    assert [(r["seq"], r["lag_1"]) for r in got] == [(1, 0.0), (3, 1.0)]


def test_missing_values_get_a_row_and_are_not_buffered(spark, tmp_path):
    parts = [[("s", 2, 2.0), ("s", 1, None), ("s", 0, 1.0)], [("s", 99, 9.0)], [("s", 199, 9.0)]]
    got = {r["seq"]: r for r in run(spark, tmp_path, parts).collect()}
    assert got[1]["value"] is None and got[1]["lag_1"] is None
    assert got[2]["lag_1"] == 1.0
