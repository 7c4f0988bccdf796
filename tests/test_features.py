import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import features


def frame(spark, values, sensor="s"):
    rows = [(sensor, i, None if v is None or np.isnan(v) else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "sensor_id string, pos bigint, value_scaled double")


def by_pandas(values):
    x = pd.Series(values, dtype=float)
    out = {f"lag_{k}": x.shift(k) for k in (1, 2, 3)} | {"roc": x.diff()}
    for w in features.WINDOWS:
        roll = x.rolling(w)
        out |= {f"roll_mean_{w}": roll.mean(), f"roll_std_{w}": roll.std(), f"roll_min_{w}": roll.min(), f"roll_max_{w}": roll.max()}
        out[f"ewma_{w}"] = x.ewm(span=w, adjust=False).mean()
        out[f"zscore_{w}"] = (x - out[f"roll_mean_{w}"]) / (out[f"roll_std_{w}"] + 1e-9)
    return pd.DataFrame(out)[features.FEATURES]


def collected(df):
    return df.orderBy("sensor_id", "pos").select(*[F.col(c).cast("double") for c in features.FEATURES]).toPandas().astype(float)


def walk(n, seed=0):
    return np.cumsum(np.random.default_rng(seed).normal(size=n))


def test_contract_and_hash(spark):
    assert len(features.FEATURES) == 22 and features.FEATURES[:5] == ["lag_1", "lag_2", "lag_3", "roc", "roll_mean_5"]
    assert features.feature_set_hash(features.FEATURES) == "44767b66"
    column = features.feature_set_hash_column(F.array(*[F.lit(c) for c in features.FEATURES]))
    assert spark.range(1).select(column).first()[0] == "44767b66"


def test_linear_series(spark):
    got = collected(features.rolling_features(frame(spark, np.arange(1.0, 71.0))))
    assert got["lag_1"][1] == 1.0 and got["roc"][5] == 1.0
    assert got["roll_mean_5"][10] == pytest.approx(np.mean([7, 8, 9, 10, 11]))


@pytest.mark.parametrize("n,chunk", [(40, 1024), (700, 512), (2600, 1024), (2600, 777)])
def test_equal_to_pandas_for_any_chunking(spark, n, chunk):
    values = walk(n, n)
    got = collected(features.rolling_features(frame(spark, values), chunk=chunk))
    want = by_pandas(values)
    for name in features.FEATURES:
        assert np.allclose(got[name], want[name], atol=1e-9, rtol=1e-9, equal_nan=True), name


def test_leading_gap_starts_at_the_first_value(spark):
    values = np.concatenate([np.full(7, np.nan), walk(300)])
    got, want = collected(features.rolling_features(frame(spark, values))), by_pandas(values)
    for name in ("ewma_5", "ewma_60", "roll_mean_15", "zscore_60", "lag_2"):
        assert np.allclose(got[name], want[name], equal_nan=True), name


def test_constant_series_has_zero_scores(spark):
    got = collected(features.rolling_features(frame(spark, np.full(100, 3.0))))
    assert (got["zscore_60"].dropna() == 0).all() and (got["roll_std_15"].dropna() == 0).all()


def test_causality(spark):
    values = walk(160)
    spoiled = values.copy()
    spoiled[100:] = 999.0
    a, b = (collected(features.rolling_features(frame(spark, v))) for v in (values, spoiled))
    pd.testing.assert_frame_equal(a[:100], b[:100])


def test_online_is_the_last_row_of_a_buffer(spark):
    values = walk(1300, 5)
    got = collected(features.rolling_features(frame(spark, values), online=True))
    for i in (0, 1, 4, 30, 63, 64, 65, 66, 200, 959, 960, 1023, 1024, 1025, 1100, 1299):
        want = by_pandas(values[max(0, i - 64) : i + 1]).iloc[-1].fillna(0.0)
        assert np.allclose(got.loc[i], want, atol=1e-9), i


def test_partition_count_does_not_matter(spark):
    df = frame(spark, walk(500)).unionByName(frame(spark, walk(300, 9), "t"))
    one, many = (collected(features.rolling_features(df.repartition(n))) for n in (1, 8))
    pd.testing.assert_frame_equal(one, many)


def test_retraining_features(spark):
    values = walk(60)
    df = frame(spark, values).withColumnRenamed("value_scaled", "value")
    got = features.retraining_features(df, chunk=32).orderBy("pos").toPandas()
    x = pd.Series(values)
    std = x.rolling(15, min_periods=1).std().fillna(1e-9)
    assert np.allclose(got["rolling_std"], std)
    assert np.allclose(got["value_diff_2"], x.diff().fillna(0).diff().fillna(0))
    assert np.allclose(got["zscore_15"], (x - x.rolling(15, min_periods=1).mean()) / std)


def test_baseline_stats(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 6.0)], "a double, b double")
    got = [tuple(r) for r in features.baseline_stats(df, ["a", "b"]).orderBy("ord").collect()]
    assert got == [("a", 2.0, pytest.approx(2**0.5), 0), ("b", 4.0, pytest.approx(8**0.5), 1)]
