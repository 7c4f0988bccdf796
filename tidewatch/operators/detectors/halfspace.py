"""Half-space trees (Tan, Ting, Liu 2011).

The trees do not depend on the data, so they are drawn once and travel with the
tasks. Only masses are learned: how many rows of the reference window pass each
node. A model keeps the last complete window; the prequential form scores every
window with the masses of the window before it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.detectors.base import as_vector, matrix

TREES, HEIGHT, WINDOW = 50, 10, 250
PADDING = 0.15
SIZE_LIMIT = 0.1


@dataclass
class Trees:
    """Complete binary trees in heap order: trees * (2 ** height - 1) inner nodes."""

    feature: np.ndarray
    split: np.ndarray
    height: int

    def paths(self, x: np.ndarray) -> np.ndarray:
        """(rows, trees, height + 1) heap positions from root to leaf."""
        n, trees = len(x), len(self.feature)
        at = np.zeros((n, trees), dtype=np.int64)
        out = np.zeros((n, trees, self.height + 1), dtype=np.int32)
        tree = np.arange(trees)
        rows = np.arange(n)[:, None]
        for depth in range(self.height):
            value = x[rows, self.feature[tree, at]]
            at = 2 * at + 1 + (value >= self.split[tree, at])
            out[:, :, depth + 1] = at
        return out


def draw(features: int, trees: int = TREES, height: int = HEIGHT, seed: int = 42) -> Trees:
    """Random splits in the unit work range, each node within its parent's range."""
    rng = np.random.default_rng(seed)
    inner = 2**height - 1
    feature = np.zeros((trees, inner), dtype=np.int64)
    split = np.zeros((trees, inner))
    low = np.zeros((trees, inner * 2 + 1, features), dtype=np.float32)
    high = np.ones_like(low)
    each = np.arange(trees)
    for node in range(inner):
        on = rng.integers(features, size=trees)
        a, b = low[each, node, on], high[each, node, on]
        at = a + rng.uniform(PADDING, 1 - PADDING, size=trees) * (b - a)
        feature[:, node], split[:, node] = on, at
        for child in (2 * node + 1, 2 * node + 2):
            low[:, child], high[:, child] = low[:, node], high[:, node]
        high[each, 2 * node + 1, on] = at
        low[each, 2 * node + 2, on] = at
    return Trees(feature, split, height)


def masses(trees: Trees, x: np.ndarray) -> np.ndarray:
    size = 2 ** (trees.height + 1) - 1
    paths = trees.paths(x)
    out = np.zeros((len(trees.feature), size), dtype=np.int32)
    for t in range(len(trees.feature)):
        out[t] = np.bincount(paths[:, t].ravel(), minlength=size)
    return out


def scores(trees: Trees, mass: np.ndarray, x: np.ndarray, window: int) -> np.ndarray:
    """1 = never seen, 0 = as crowded as possible; sparse nodes end a path early."""
    paths = trees.paths(x)
    along = mass[np.arange(len(mass))[None, :, None], paths]
    thin = along < SIZE_LIMIT * window
    reached = np.cumsum(thin, axis=2) - thin == 0  # up to and including the first thin node
    weight = 2.0 ** np.arange(trees.height + 1)
    total = (along * weight * reached).sum(axis=(1, 2))
    return 1.0 - total / (len(mass) * window * (2 ** (trees.height + 1) - 1))


@dataclass
class HalfSpaceModel:
    features: list[str] | str
    trees: Trees
    mass: np.ndarray
    window: int

    def transform(self, df: DataFrame, name: str = "score") -> DataFrame:
        trees, mass, window = self.trees, self.mass, self.window

        @F.pandas_udf("double")
        def score(vectors: pd.Series) -> pd.Series:
            x = matrix(vectors)
            parts = [scores(trees, mass, x[i : i + 512], window) for i in range(0, len(x), 512)]
            return pd.Series(np.concatenate(parts) if parts else np.zeros(0))

        return df.withColumn(name, score(as_vector(self.features)))


def fit(
    df: DataFrame,
    features: list[str] | str,
    order: list[str],
    trees: int = TREES,
    height: int = HEIGHT,
    window: int = WINDOW,
    seed: int = 42,
) -> HalfSpaceModel:
    """Learning in order leaves the masses of the last complete window: at most
    2 * window - 1 newest rows are fetched, whatever the size of the table. Before the
    first complete window there are no masses, and every score is 1."""
    total = df.count()
    rest = total % window
    newest = (
        df.select(*order, as_vector(features).alias("x"))
        .orderBy(*[F.col(c).desc() for c in order])
        .limit(rest + window)
        .toPandas()
    )
    x = matrix(newest["x"])
    drawn = draw(x.shape[1], trees, height, seed)
    return HalfSpaceModel(features, drawn, masses(drawn, x[rest:]), window)


def prequential(
    df: DataFrame,
    features: list[str],
    keys: list[str],
    pos: str = "pos",
    trees: int = TREES,
    height: int = HEIGHT,
    window: int = WINDOW,
    seed: int = 42,
) -> DataFrame:
    """Every row scored with the masses of the previous window of its key; the first
    window has none and gets NULL.

    `pos` is a dense row number per key. A window's rows are sent to their own group
    and, as reference, to the next one: groups hold 2 * window rows.
    """
    drawn = draw(len(features), trees, height, seed)
    own = F.floor(F.col(pos) / window).cast("bigint")
    copies = F.explode(
        F.array(F.struct(own.alias("w"), F.lit(0).alias("ref")), F.struct((own + 1).alias("w"), F.lit(1).alias("ref")))
    )
    sent = df.select(*keys, F.col(pos).alias("pos"), as_vector(features).alias("x"), copies.alias("c")).select(
        *keys, "pos", "x", "c.w", "c.ref"
    )
    types = dict(df.dtypes)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        live, old = group[group["ref"] == 0], group[group["ref"] == 1]
        out = live[[*keys, "pos"]].copy()
        if len(old) and len(live):
            out["score"] = scores(drawn, masses(drawn, matrix(old["x"])), matrix(live["x"]), window)
        else:
            out["score"] = np.nan
        return out

    schema = ", ".join([f"{k} {types[k]}" for k in keys] + ["pos bigint", "score double"])
    scored = sent.groupBy(*keys, "w").applyInPandas(run, schema)
    return scored.withColumn("score", F.when(~F.isnan("score"), F.col("score")))
