"""A non-linear sequence autoencoder, trained on all rows by averaged workers.

Rows are dealt to workers of at most SHARE rows by a hash of their vector and kept as packed
matrices. In each round every worker goes through its own rows in mini-batches from the same
start, and the weights of all workers are averaged by their rows. Orders, batches and sums
follow from hashes and seeds, so a retried task, and a second fit, give the same model. The
driver receives one set of weights for each GROUP of workers.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.detectors.base import key_hash, matrix, mean_and_cov
from tidewatch.session import materialize

SHARE, BLOCK, GROUP = 1 << 16, 1024, 64
BATCH = 128
FIRST, SECOND, TINY = 0.9, 0.999, 1e-8


def shapes(width: int, hidden: int, code: int) -> list[tuple[int, ...]]:
    """Weights and offsets from the input over a hidden layer to the code, and back."""
    sizes = [width, hidden, code, hidden, width]
    return [shape for a, b in zip(sizes, sizes[1:]) for shape in ((a, b), (b,))]


def unpacked(flat: np.ndarray, layers: list[tuple[int, ...]]) -> list[np.ndarray]:
    cuts = np.cumsum([math.prod(s) for s in layers])[:-1]
    return [part.reshape(shape) for part, shape in zip(np.split(flat, cuts), layers)]


def started(layers: list[tuple[int, ...]], seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return np.concatenate([(rng.normal(0, 1 / np.sqrt(s[0]), s) if len(s) == 2 else np.zeros(s)).ravel() for s in layers])


def rebuilt(x: np.ndarray, parts: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """(the reconstruction, the layers' values); hidden layers are tanh, code and output linear."""
    w1, b1, w2, b2, w3, b3, w4, b4 = parts
    first = np.tanh(x @ w1 + b1)
    code = first @ w2 + b2
    second = np.tanh(code @ w3 + b3)
    return second @ w4 + b4, [first, code, second]


def gradient(x: np.ndarray, parts: list[np.ndarray]) -> np.ndarray:
    """Of the mean squared error over a batch."""
    _, _, w2, _, w3, _, w4, _ = parts
    out, (first, code, second) = rebuilt(x, parts)
    d_out = 2.0 * (out - x) / x.size
    d_second = (d_out @ w4.T) * (1 - second * second)
    d_code = d_second @ w3.T
    d_first = (d_code @ w2.T) * (1 - first * first)
    steps = [(x, d_first), (first, d_code), (code, d_second), (second, d_out)]
    return np.concatenate([g.ravel() for values, d in steps for g in (values.T @ d, d.sum(0))])


def trained(x: np.ndarray, flat: np.ndarray, layers: list[tuple[int, ...]], rate: float, seed: int, passes: int) -> np.ndarray:
    """Some passes over a worker's rows by Adam (Kingma and Ba 2015)."""
    flat, rng = flat.copy(), np.random.default_rng(seed)
    mean, square = np.zeros_like(flat), np.zeros_like(flat)
    batches = (rows for _ in range(passes) for rows in np.array_split(rng.permutation(len(x)), max(1, len(x) // BATCH)))
    for step, rows in enumerate(batches, 1):
        g = gradient(x[rows], unpacked(flat, layers))
        mean = FIRST * mean + (1 - FIRST) * g
        square = SECOND * square + (1 - SECOND) * g * g
        flat -= rate * (mean / (1 - FIRST**step)) / (np.sqrt(square / (1 - SECOND**step)) + TINY)
    return flat


@dataclass
class AutoencoderModel:
    """The score is the mean squared error of a sequence's last step, in standard deviations."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    hidden: int
    code: int
    width: int
    column: str = "sequence"

    def transform(self, df: DataFrame, name: str = "score") -> DataFrame:
        mean, scale, weights, width = self.mean, self.scale, self.weights, self.width
        layers = shapes(len(mean), self.hidden, self.code)

        @F.pandas_udf("double")
        def error(vectors: pd.Series) -> pd.Series:
            parts, out = unpacked(weights, layers), []
            for i in range(0, len(vectors), BLOCK):
                x = (matrix(vectors[i : i + BLOCK]) - mean) / scale
                out.append(((rebuilt(x, parts)[0] - x)[:, -width:] ** 2).mean(1))
            return pd.Series(np.concatenate(out) if out else np.zeros(0))

        return df.withColumn(name, error(F.col(self.column)))


def _packed(df: DataFrame, column: str, mean: np.ndarray, scale: np.ndarray, workers: int) -> DataFrame:
    """(worker, rows) with standardised rows of a worker as matrices, written once."""
    dealt = df.select(F.floor(key_hash(["x"], 5) * workers).cast("int").alias("worker"), "x", F.xxhash64("x").alias("place"))

    def pack(batches):
        for batch in batches:
            worker = batch.column("worker").to_numpy()
            flat = batch.column("x").flatten().to_numpy(zero_copy_only=False)
            x = ((flat.reshape(len(worker), -1) - mean) / scale).astype(np.float32) if len(worker) else np.zeros((0, 1), np.float32)
            for w in np.unique(worker):
                part = x[worker == w]
                blocks = [part[i : i + BLOCK].tobytes() for i in range(0, len(part), BLOCK)]
                yield pa.RecordBatch.from_arrays([pa.array([w] * len(blocks), pa.int32()), pa.array(blocks, pa.binary())], ["worker", "rows"])

    in_order = dealt.repartition(workers, "worker").sortWithinPartitions("worker", "place", "x")
    return materialize(in_order.mapInArrow(pack, "worker int, rows binary"), "autoencoder-rows")


def fit(
    df: DataFrame, width: int, hidden: int = 48, code: int = 16, rounds: int = 6, passes: int = 3, rate: float = 3e-3, seed: int = 42,
    column: str = "sequence",
) -> AutoencoderModel:
    """width = features per step; hidden and code = sizes of the layers; in each round every worker makes `passes`
    over its rows before the weights are averaged."""
    rows = df.select(F.transform(column, lambda v: v.cast("double")).alias("x"))
    n, mean, cov = mean_and_cov(rows)
    scale = np.sqrt(np.maximum(np.diag(cov), 0.0))
    scale[scale == 0] = 1.0
    size, workers = len(mean), max(1, math.ceil(n / SHARE))
    layers = shapes(size, hidden, code)
    packed = _packed(rows, column, mean, scale, workers)
    weights = started(layers, seed)

    for number in range(rounds):  # a job each, over the packed rows
        start, step = weights, rate * 0.5 * (1 + math.cos(math.pi * number / rounds))

        def work(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
            blocks = sorted(part["rows"])  # in an order that no shuffle changes
            x = np.concatenate([np.frombuffer(b, np.float32).reshape(-1, size) for b in blocks]).astype(float)
            made = trained(x, start, layers, step, hash((seed, number, int(key[0]))) & 0x7FFFFFFF, passes)
            return pd.DataFrame({"worker": [key[0]], "n": [float(len(x))], "weights": [made]})

        def average(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values("worker")
            share = part["n"].to_numpy()
            return pd.DataFrame({"group": [key[0]], "n": [share.sum()], "weights": [np.stack(part["weights"]).T @ (share / share.sum())]})

        made = packed.groupBy("worker").applyInPandas(work, "worker int, n double, weights array<double>")
        grouped = made.withColumn("group", F.floor(F.col("worker") / GROUP).cast("int")).groupBy("group")
        sums = grouped.applyInPandas(average, "group int, n double, weights array<double>").orderBy("group").toPandas()
        share = sums["n"].to_numpy()
        weights = np.stack(sums["weights"]).T @ (share / share.sum())
    return AutoencoderModel(mean, scale, weights, hidden, code, width, column)
