"""Isolation forest (Liu, Ting, Zhou 2008): trees are built in parallel, one group
of at most a few hundred sampled rows per tree; the model is a small node table."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.detectors.base import as_vector, key_hash, matrix
from tidewatch.operators.scan import exact_quantiles

NODES = "tree int, node int, feature int, split double, left int, path double"


def average_path(n: float) -> float:
    """Mean path length of an unsuccessful search in a binary tree of n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n


def grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    """Nodes (feature, split, left, path). Children are adjacent; a leaf points to itself."""
    nodes: list = [None]
    stack = [(0, np.arange(len(x)), 0)]
    while stack:
        at, rows, depth = stack.pop()
        sub = x[rows]
        low, high = (sub.min(0), sub.max(0)) if len(rows) else (np.zeros(1), np.zeros(1))
        usable = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or not len(usable):
            nodes[at] = (0, math.inf, at, depth + average_path(len(rows)))
            continue
        feature = int(rng.choice(usable))
        split = float(rng.uniform(low[feature], high[feature]))
        left = len(nodes)
        nodes.extend([None, None])
        nodes[at] = (feature, split, left, 0.0)
        above = sub[:, feature] > split
        stack.append((left, rows[~above], depth + 1))
        stack.append((left + 1, rows[above], depth + 1))
    return nodes


@dataclass
class ForestModel:
    """The node table of all trees: at most trees * (2 * sample - 1) nodes."""

    features: list[str] | str
    tables: tuple[np.ndarray, ...]  # roots, feature, split, left, path
    sample: int
    limit: int
    offset: float = -0.5

    def score(self) -> Column:
        roots, feature, split, left, path = self.tables
        scale, limit = average_path(self.sample), self.limit

        def walk(x: np.ndarray) -> np.ndarray:
            x = np.ascontiguousarray(x)
            flat, width = x.ravel(), x.shape[1]
            base = (np.arange(len(x), dtype=np.int64) * width)[:, None]
            at = np.broadcast_to(roots, (len(x), len(roots)))
            for _ in range(limit):
                value = flat.take(base + feature.take(at, mode="clip"), mode="clip")
                at = left.take(at, mode="clip") + (value > split.take(at, mode="clip"))
            return np.exp2(-path.take(at).mean(1) / scale) if scale else np.ones(len(x))

        def in_blocks(x: np.ndarray) -> pd.Series:
            # 128 rows x 200 trees keep the working set in the processor cache
            parts = [walk(x[i : i + 128]) for i in range(0, len(x), 128)]
            return pd.Series(np.concatenate(parts) if parts else np.zeros(0))

        if isinstance(self.features, str):

            @F.pandas_udf("double")
            def by_array(vectors: pd.Series) -> pd.Series:
                return in_blocks(matrix(vectors))

            return by_array(as_vector(self.features))

        @F.pandas_udf("double")
        def by_columns(*columns: pd.Series) -> pd.Series:
            return in_blocks(np.column_stack([c.to_numpy(dtype=float) for c in columns]))

        return by_columns(*[F.col(c) for c in self.features])

    def transform(self, df: DataFrame, name: str = "score") -> DataFrame:
        return df.withColumn(name, self.score())

    def decision(self, score: str = "score") -> Column:
        """Positive = normal, negative = anomalous."""
        return -F.col(score) - F.lit(self.offset)


def fit(
    df: DataFrame,
    features: list[str] | str,
    keys: list[str],
    trees: int = 200,
    sample: int = 256,
    seed: int = 42,
    contamination: float | None = None,
) -> ForestModel:
    """Sampling is by a hash of the row key: repeatable, and a retried task picks the same rows.

    One hash per row cuts the table to a pool of about 2 * trees * sample rows (all rows,
    if there are fewer); only pool rows draw their trees. `sample` bounds what a tree
    sees, every tree group holds about 2 * sample rows.
    """
    rows = df.select(*keys, as_vector(features).alias("x"))
    total = df.count()
    size = min(sample, total)
    pool_size = 2 * trees * sample
    pool = rows.where(key_hash(keys, seed) < min(1.0, pool_size / max(1, total)))
    share = min(1.0, 2.0 * size / min(total, pool_size))
    drawn = F.filter(
        F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: key_hash(keys, seed + 1, t) < F.lit(share)
    )
    picked = pool.withColumn("tree", F.explode(drawn)).withColumn("h", key_hash(keys, seed + 2, F.col("tree")))
    limit = max(1, math.ceil(math.log2(max(size, 2))))

    def build(group: pd.DataFrame) -> pd.DataFrame:
        tree = int(group["tree"].iloc[0])
        chosen = group.sort_values("h", kind="stable").head(size)
        nodes = grow(matrix(chosen["x"]), np.random.default_rng([seed, tree]), limit)
        out = pd.DataFrame(nodes, columns=["feature", "split", "left", "path"])
        return out.assign(tree=tree, node=np.arange(len(out)))[["tree", "node", "feature", "split", "left", "path"]]

    table = picked.select("tree", "h", "x").groupBy("tree").applyInPandas(build, NODES).toPandas()
    model = ForestModel(features, pack(table), size, limit)
    if contamination is not None:
        model.offset = contamination_offset(model.transform(df), contamination)
    return model


def pack(table: pd.DataFrame) -> tuple[np.ndarray, ...]:
    table = table.sort_values(["tree", "node"]).reset_index(drop=True)
    roots = table.index[table["node"] == 0].to_numpy(dtype=np.int64)
    start = table.groupby("tree")["node"].transform("size").groupby(table["tree"]).first().cumsum().shift(fill_value=0)
    left = table["left"].to_numpy(dtype=np.int64) + table["tree"].map(start).to_numpy(dtype=np.int64)
    return (
        roots,
        table["feature"].to_numpy(dtype=np.int64),
        table["split"].to_numpy(),
        left,
        table["path"].to_numpy(),
    )


def contamination_offset(scored: DataFrame, contamination: float, score: str = "score") -> float:
    """The raw (negated) score below which the given share of the training rows lies."""
    raw = scored.select(F.lit("all").alias("k"), (-F.col(score)).alias("raw"))
    return exact_quantiles(raw, ["k"], "raw", [contamination]).first()["quantile"]


def contamination_offsets(scores: DataFrame, keys: list[str], contamination: float) -> DataFrame:
    """The same per key, as a table (keys, offset)."""
    raw = scores.select(*keys, (-F.col("score")).alias("raw"))
    return exact_quantiles(raw, keys, "raw", [contamination]).select(*keys, F.col("quantile").alias("offset"))
