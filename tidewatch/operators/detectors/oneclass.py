"""One-class SVM (Schölkopf et al. 2001) on random Fourier features (Rahimi, Recht 2007).

The RBF kernel becomes a fixed random map, so training is distributed
subgradient descent: one aggregate per step, the model is one weight vector.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.detectors.base import as_vector, matrix, mean_and_cov
from tidewatch.operators.scan import exact_quantiles

NU_GRID = (0.01, 0.03, 0.05, 0.1)


@dataclass
class OneClassModel:
    features: list[str] | str
    omega: np.ndarray
    phase: np.ndarray
    weight: np.ndarray
    rho: float
    nu: float

    def transform(self, df: DataFrame, name: str = "score") -> DataFrame:
        project = projection(self.omega, self.phase, self.weight)
        return df.withColumn(name, F.lit(self.rho) - project(as_vector(self.features)))


def fourier(x: np.ndarray, omega: np.ndarray, phase: np.ndarray) -> np.ndarray:
    return np.sqrt(2.0 / len(phase)) * np.cos(x @ omega + phase)


def projection(omega: np.ndarray, phase: np.ndarray, weight: np.ndarray):
    @F.pandas_udf("double")
    def project(vectors: pd.Series) -> pd.Series:
        x = matrix(vectors)
        return pd.Series(fourier(x, omega, phase) @ weight if len(x) else np.zeros(0))

    return project


def gradient(rows: DataFrame, omega: np.ndarray, phase: np.ndarray, weight: np.ndarray, rho: float):
    """(sum of phi over rows below the margin, their number): one row per task, summed."""

    def partial(batches):
        total = np.zeros(len(phase) + 1)
        for batch in batches:
            if len(batch):
                phi = fourier(matrix(batch["x"]), omega, phase)
                below = phi @ weight < rho
                total += np.append(phi[below].sum(0), below.sum())
        yield pd.DataFrame({"g": [total]})

    summed = (
        rows.select("x")
        .mapInPandas(partial, "g array<double>")
        .select(F.posexplode("g").alias("i", "v"))
        .groupBy("i")
        .agg(F.sum("v").alias("v"))
        .orderBy("i")
        .collect()
    )
    flat = np.array([row["v"] for row in summed])
    return flat[:-1], flat[-1]


def fit(
    df: DataFrame,
    features: list[str] | str,
    nu: float = 0.1,
    gamma: float | None = None,
    width: int = 512,
    steps: int = 12,
    seed: int = 42,
) -> OneClassModel:
    """gamma defaults to 1 / (d * variance). The offset is the exact nu-quantile of the
    training projections, so a share nu of the training rows lies outside."""
    rows = df.select(as_vector(features).alias("x")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n, mean, cov = mean_and_cov(rows)
        d = len(mean)
        if gamma is None:
            overall = np.trace(cov) / d + np.var(mean)
            gamma = 1.0 / (d * overall) if overall > 0 else 1.0
        rng = np.random.default_rng(seed)
        omega = rng.normal(scale=np.sqrt(2.0 * gamma), size=(d, width))
        phase = rng.uniform(0, 2 * np.pi, size=width)
        # start at the mean of the mapped rows, the solution for nu = 1
        weight = gradient(rows, omega, phase, np.zeros(width), 1.0)[0] / n
        rho = float(weight @ weight)
        averaged, weights = np.zeros(width), 0.0
        for step in range(steps):
            below, count = gradient(rows, omega, phase, weight, rho)
            rate = 1.0 / (step + 2.0)
            weight = weight - rate * (weight - below / (nu * n))
            rho = rho - rate * (count / (nu * n) - 1.0) * 0.5
            averaged += (step + 1.0) * weight
            weights += step + 1.0
        weight = averaged / weights
        projected = rows.select(F.lit("all").alias("k"), projection(omega, phase, weight)(F.col("x")).alias("p"))
        rho = exact_quantiles(projected, ["k"], "p", [nu]).first()["quantile"]
        return OneClassModel(features, omega, phase, weight, rho, nu)
    finally:
        rows.unpersist()
