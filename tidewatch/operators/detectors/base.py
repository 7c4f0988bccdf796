"""What all detectors share.

A detector is fitted on a DataFrame and gives a model with
`transform(df) -> df + score`; higher is always more anomalous.
"""

from __future__ import annotations

from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Model(Protocol):
    def transform(self, df: DataFrame, name: str = "score") -> DataFrame: ...


def as_vector(features: list[str] | str) -> Column:
    """One ARRAY<DOUBLE> column from feature columns, or the given array column."""
    if isinstance(features, str):
        return F.transform(F.col(features), lambda v: v.cast("double"))
    return F.array(*[F.col(c).cast("double") for c in features])


def matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()) if len(vectors) else np.zeros((0, 1))


def key_hash(keys: list[str], seed: int, *salt: Column) -> Column:
    """A repeatable uniform number in [0, 1) per row."""
    space = float(1 << 52)
    return F.pmod(F.xxhash64(*[F.col(k) for k in keys], F.lit(seed), *salt), F.lit(1 << 52)) / F.lit(space)


def moments(df: DataFrame, vector: str = "x", weight: str | None = None) -> tuple[float, np.ndarray, np.ndarray]:
    """(n, sum x, sum x x^T) over all rows.

    Each task reduces its Arrow batches to one d*d row; those are summed by
    position, so the driver receives d*d + d + 1 numbers, never rows.
    """

    def partial(batches):
        total = None
        for batch in batches:
            if not len(batch):
                continue
            x = matrix(batch["x"])
            x = np.hstack([np.ones((len(x), 1)), x])
            part = x.T @ x
            total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"m": [total.ravel()]})

    sums = (
        df.select(F.col(vector).alias("x"))
        .mapInPandas(partial, "m array<double>")
        .select(F.posexplode("m").alias("i", "v"))
        .groupBy("i")
        .agg(F.sum("v").alias("v"))
        .orderBy("i")
        .collect()
    )
    flat = np.array([row["v"] for row in sums])
    size = int(round(len(flat) ** 0.5))
    full = flat.reshape(size, size)
    return full[0, 0], full[0, 1:], full[1:, 1:]


def mean_and_cov(df: DataFrame, vector: str = "x") -> tuple[float, np.ndarray, np.ndarray]:
    """Count, mean and population covariance. Products are summed around the mean of a first
    pass, so that a large offset of the data does not cancel them."""
    n, total, _ = moments(df, vector)
    centre = total / n
    middle = F.array(*[F.lit(float(c)) for c in centre])
    shifted = df.withColumn("_centred", F.zip_with(F.col(vector), middle, lambda x, c: x - c))
    n, total, cross = moments(shifted, "_centred")
    rest = total / n
    return n, centre + rest, cross / n - np.outer(rest, rest)
