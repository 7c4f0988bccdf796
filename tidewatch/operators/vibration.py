"""Vibration snapshots: time-domain and spectral features, one row per snapshot."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.detectors import isolation
from tidewatch.operators.scan import row_number
from tidewatch.operators.splits import prefix_split, scale_columns

SAMPLE_RATE = 20000.0
EPS = 1e-9
TIME_FEATURES = ["rms", "peak", "crest_factor", "kurtosis", "skewness", "variance"]
SPECTRAL_FEATURES = ["dominant_freq", "spectral_centroid", "spectral_entropy", "total_power"]
FEATURES = TIME_FEATURES + SPECTRAL_FEATURES
NORMAL_SNAPSHOTS = 400
WAVE_POINTS = 500
SPECTRUM_BINS = 200


def long_form(df: DataFrame, keys: list[str], signal: str = "signal") -> DataFrame:
    """(keys, n, x): one row per sample."""
    return df.select(*keys, F.posexplode(signal).alias("n", "x")).withColumn("x", F.col("x").cast("double"))


def time_features(samples: DataFrame, keys: list[str]) -> DataFrame:
    """From long form. All moments merge, so samples are combined before the shuffle."""
    x = F.col("x")
    out = samples.groupBy(*keys).agg(
        F.sqrt(F.avg(x * x)).alias("rms"),
        F.max(F.abs(x)).alias("peak"),
        (F.kurtosis(x) + 3.0).alias("kurtosis"),
        F.skewness(x).alias("skewness"),
        F.var_pop(x).alias("variance"),
    )
    return out.withColumn("crest_factor", F.col("peak") / (F.col("rms") + F.lit(EPS))).select(*keys, *TIME_FEATURES)


def _power(signals: pd.Series) -> list[np.ndarray]:
    return [np.abs(np.fft.rfft(np.asarray(s, dtype=float))) ** 2 for s in signals]


def power_spectrum(signal: Column) -> Column:
    """ARRAY<DOUBLE> of |FFT|^2 for one snapshot per row."""

    @F.pandas_udf("array<double>")
    def spectrum(signals: pd.Series) -> pd.Series:
        return pd.Series(_power(signals), dtype=object)

    return spectrum(signal)


def spectral_features(signal: Column, sample_rate: float = SAMPLE_RATE) -> Column:
    """Struct of dominant frequency (first maximum, constant part included), centroid,
    entropy in bits, total power."""

    @F.pandas_udf("dominant_freq double, spectral_centroid double, spectral_entropy double, total_power double")
    def describe(signals: pd.Series) -> pd.DataFrame:
        rows = []
        for signal_, power in zip(signals, _power(signals)):
            freq = np.fft.rfftfreq(len(signal_), 1.0 / sample_rate)
            total = power.sum() + EPS
            share = power / total
            share = share[share > 0]
            rows.append((freq[power.argmax()], (freq * power).sum() / total, -(share * np.log2(share)).sum(), total))
        return pd.DataFrame(rows, columns=SPECTRAL_FEATURES)

    return describe(signal)


def snapshot_features(df: DataFrame, keys: list[str], signal: str = "signal", sample_rate: float = SAMPLE_RATE) -> DataFrame:
    """The ten features per snapshot; an empty signal gives no row.

    One row holds one snapshot (about 20 thousand samples). Both feature groups are
    computed from it without a join: sums over the array stay in the JVM.
    """
    x = F.transform(F.col(signal), lambda v: v.cast("double"))
    rows = df.where(F.size(signal) > 0).select(*keys, x.alias("_x"))
    n = F.size("_x").cast("double")
    total = lambda f: F.aggregate("_x", F.lit(0.0), lambda acc, v: acc + f(v))
    rows = rows.withColumn("_mean", total(lambda v: v) / n)
    centred = lambda p: total(lambda v: F.pow(v - F.col("_mean"), F.lit(p))) / n
    rows = rows.withColumns(
        {
            "rms": F.sqrt(total(lambda v: v * v) / n),
            "peak": F.array_max(F.transform("_x", lambda v: F.abs(v))),
            "variance": centred(2.0),
            "_m3": centred(3.0),
            "_m4": centred(4.0),
            "_f": spectral_features(F.col("_x"), sample_rate),
        }
    )
    spread = F.nullif(F.col("variance"), F.lit(0.0))
    rows = rows.withColumns(
        {
            "crest_factor": F.col("peak") / (F.col("rms") + F.lit(EPS)),
            "kurtosis": F.col("_m4") / (spread * spread),
            "skewness": F.col("_m3") / F.pow(spread, F.lit(1.5)),
        }
    )
    return rows.select(*keys, *TIME_FEATURES, *[F.col(f"_f.{c}").alias(c) for c in SPECTRAL_FEATURES])


def index_snapshots(df: DataFrame, order: str) -> DataFrame:
    """file_index: 0-based chronological number, counted without a single task."""
    return row_number(df, [], order, [], "file_index")


def strided(df: DataFrame, total: int, wanted: int) -> DataFrame:
    """Every max(1, total // wanted)-th snapshot, renumbered."""
    step = max(1, total // wanted)
    return df.where(F.pmod(F.col("file_index"), F.lit(step)) == 0).withColumn(
        "file_index", F.floor(F.col("file_index") / step).cast("bigint")
    )


def thin_waveform(signal: Column, points: int = WAVE_POINTS) -> Column:
    """Every max(1, n // points)-th sample."""
    n = F.size(signal)
    step = F.greatest(F.lit(1), F.floor(n / points).cast("int"))
    return F.transform(F.sequence(F.lit(0), n - 1, step), lambda i: F.get(signal, i))


def spectrum_head(power: Column, n_samples: Column, sample_rate: float = SAMPLE_RATE, bins: int = SPECTRUM_BINS) -> Column:
    """ARRAY<STRUCT<frequency, magnitude>> of the first bins."""
    return F.transform(
        F.slice(power, 1, bins),
        lambda p, i: F.struct((i * F.lit(sample_rate) / n_samples).alias("frequency"), F.sqrt(p).alias("magnitude")),
    )


def dataset_status(df: DataFrame, key: str, model_loaded: bool = False) -> DataFrame:
    n = F.countDistinct(key)
    return df.agg((n > 0).alias("dataset_available"), n.alias("total_snapshots"), F.lit(model_loaded).alias("model_loaded"))


def fit_degradation(features: DataFrame, order: str = "file_index", normal: int = NORMAL_SNAPSHOTS, seed: int = 42):
    """(scaled rows with is_normal, forest fitted on the first `normal` snapshots)."""
    marked = prefix_split(features, order, normal)
    scaled = scale_columns(marked, FEATURES, F.col("is_normal") == 1)
    model = isolation.fit(
        scaled.where("is_normal = 1"), FEATURES, [order], trees=100, seed=seed, contamination=0.01
    )
    return scaled, model


def score_snapshots(scaled: DataFrame, model: isolation.ForestModel | None) -> DataFrame:
    """anomaly_score = -decision, anomalous above 0; without a model 0 / False."""
    if model is None:
        return scaled.withColumns({"anomaly_score": F.lit(0.0), "is_anomaly": F.lit(False)})
    scored = model.transform(scaled, "_score").withColumn("anomaly_score", -model.decision("_score")).drop("_score")
    return scored.withColumn("is_anomaly", F.col("anomaly_score") > 0)


def score_range(scored: DataFrame) -> DataFrame:
    """Lowest and highest decision value of the snapshots after the normal ones."""
    rest = scored.where("is_normal = 0")
    return rest.agg(
        F.count("*").alias("test_samples"),
        F.min(-F.col("anomaly_score")).alias("min_score"),
        F.max(-F.col("anomaly_score")).alias("max_score"),
    )
