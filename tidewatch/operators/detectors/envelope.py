"""Robust covariance (minimum covariance determinant, Rousseeuw and Van Driessen 1999).

A concentration step is two distributed passes: moments of the kept rows, and
the distance quantile that decides which rows to keep next.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.detectors.base import as_vector, key_hash, matrix, mean_and_cov
from tidewatch.operators.scan import exact_quantiles

SUPPORT_FRACTIONS = (None, 0.95, 0.90, 0.85)
CONDITION = 1e12


def chi2_quantile(p: float, d: int) -> float:
    """By bisection on the regularised lower gamma function (power series)."""

    def cdf(x: float) -> float:
        a, half = d / 2.0, x / 2.0
        term = total = 1.0 / a
        k = a
        while term > total * 1e-15:
            k += 1.0
            term *= half / k
            total += term
        return total * math.exp(-half + a * math.log(half) - math.lgamma(a)) if x > 0 else 0.0

    low, high = 0.0, 10.0 * d + 100.0
    for _ in range(200):
        mid = (low + high) / 2.0
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return (low + high) / 2.0


def distance(vector: Column, mean: np.ndarray, precision: np.ndarray) -> Column:
    """Squared Mahalanobis distance."""

    @F.pandas_udf("double")
    def squared(vectors: pd.Series) -> pd.Series:
        centred = matrix(vectors) - mean if len(vectors) else np.zeros((0, len(mean)))
        return pd.Series(np.einsum("ij,jk,ik->i", centred, precision, centred, optimize=True))

    return squared(vector)


@dataclass
class EnvelopeModel:
    features: list[str] | str
    mean: np.ndarray
    covariance: np.ndarray
    support_fraction: float | None
    offset: float | None = None

    def transform(self, df: DataFrame, name: str = "score") -> DataFrame:
        precision = np.linalg.inv(self.covariance)
        return df.withColumn(name, distance(as_vector(self.features), self.mean, precision))


def usable(cov: np.ndarray) -> bool:
    return bool(np.all(np.isfinite(cov))) and np.linalg.cond(cov) < CONDITION


def plain(df: DataFrame, features: list[str] | str) -> EnvelopeModel:
    """Mean and covariance of all rows, no trimming."""
    _, mean, cov = mean_and_cov(df.select(as_vector(features).alias("x")))
    return EnvelopeModel(features, mean, cov, 1.0)


def quantile_of(column: Column, rows: DataFrame, p: float) -> float:
    values = rows.select(F.lit("all").alias("k"), column.alias("d"))
    return exact_quantiles(values, ["k"], "d", [p]).first()["quantile"]


def rough_quantile(column: Column, rows: DataFrame, p: float) -> float:
    """Rank error 1e-4: enough to choose the rows of a concentration step, and it needs
    no shuffle of the rows."""
    return rows.select(column.alias("d")).agg(F.percentile_approx("d", float(p), 10000).alias("q")).first()["q"]


def concentrate(rows: DataFrame, mean: np.ndarray, cov: np.ndarray, share: float, steps: int):
    """Repeat: keep the `share` of rows nearest to the centre, take their moments."""
    for _ in range(steps):
        if not usable(cov):
            return None
        d = distance(F.col("x"), mean, np.linalg.inv(cov))
        limit = rough_quantile(d, rows, share)
        before = np.linalg.slogdet(cov)[1]
        _, mean, cov = mean_and_cov(rows.withColumn("d", d).where(F.col("d") <= limit))
        if not usable(cov):
            return None
        if abs(np.linalg.slogdet(cov)[1] - before) < 1e-6:
            break
    return mean, cov


def fit(
    df: DataFrame,
    features: list[str] | str,
    keys: list[str],
    contamination: float = 0.02,
    steps: int = 4,
    subset: int = 500,
    seed: int = 42,
) -> EnvelopeModel | None:
    """None when the covariance stays singular for every support fraction.

    Two starts (all rows, and a hash sample); the smaller determinant wins.
    """
    rows = df.select(*keys, as_vector(features).alias("x")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n, mean, cov = mean_and_cov(rows)
        d = len(mean)
        part = rows.where(key_hash(keys, seed) < min(1.0, subset / n))
        starts = [(mean, cov), mean_and_cov(part)[1:]]
        for support in SUPPORT_FRACTIONS:
            share = (n + d + 1) / (2.0 * n) if support is None else support
            found = [f for f in (concentrate(rows, m, c, share, steps) for m, c in starts) if f is not None]
            if not found:
                continue
            mean, cov = min(found, key=lambda f: np.linalg.slogdet(f[1])[1])
            # consistency for normal data, then one reweighting of the inliers
            dist = distance(F.col("x"), mean, np.linalg.inv(cov))
            cov = cov * (rough_quantile(dist, rows, 0.5) / chi2_quantile(0.5, d))
            if not usable(cov):
                continue
            kept = rows.withColumn("d", distance(F.col("x"), mean, np.linalg.inv(cov)))
            _, mean, cov = mean_and_cov(kept.where(F.col("d") < chi2_quantile(0.975, d)))
            if not usable(cov):
                continue
            model = EnvelopeModel(features, mean, cov, support)
            model.offset = quantile_of(distance(F.col("x"), mean, np.linalg.inv(cov)), rows, 1.0 - contamination)
            return model
        return None
    finally:
        rows.unpersist()
