"""Half-space trees on the stream: masses as keyed state that change places every window.

Each sensor learns into its latest masses while it scores with its reference masses. When a
window is full, the latest become the reference and learning begins anew. Scores are those of
`halfspace.prequential` over the same rows in order, however they are cut into micro-batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidewatch.operators.detectors import halfspace

STATE = T.StructType(
    [
        T.StructField("seen", T.LongType()),
        T.StructField("reference", T.BinaryType()),
        T.StructField("latest", T.BinaryType()),
    ]
)
OUTPUT = T.StructType(
    [
        T.StructField("sensor_id", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("seq", T.LongType()),
        T.StructField("score", T.DoubleType()),
    ]
)


class TreeMasses(StatefulProcessor):
    """State per sensor: two mass tables of trees x nodes numbers, whatever the length of the stream."""

    def __init__(self, features: list[str], trees: halfspace.Trees, window: int):
        self.features, self.trees, self.window = features, trees, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("masses", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        shape = (len(self.trees.feature), 2 ** (self.trees.height + 1) - 1)
        seen, reference, latest = 0, None, np.zeros(shape, np.int32)
        if self.state.exists():
            seen, old, new = self.state.get()
            reference = np.frombuffer(old, np.int32).reshape(shape) if old else None
            latest = np.frombuffer(new, np.int32).reshape(shape)
        batch = pd.concat(list(rows), ignore_index=True).sort_values(["ts", "seq"], kind="stable")
        x = batch[self.features].to_numpy(dtype=float)
        score, at = np.full(len(x), np.nan), 0
        while at < len(x):
            until = min(len(x), at + self.window - seen % self.window)  # never across the end of a window
            part = x[at:until]
            if reference is not None:
                score[at:until] = halfspace.scores(self.trees, reference, part, self.window)
            latest = latest + halfspace.masses(self.trees, part)
            seen, at = seen + until - at, until
            if seen % self.window == 0:
                reference, latest = latest, np.zeros(shape, np.int32)
        self.state.update((seen, reference.tobytes() if reference is not None else None, latest.astype(np.int32).tobytes()))
        out = batch[["ts", "seq"]].copy()
        out.insert(0, "sensor_id", key[0])
        out["score"] = pd.Series(score, index=out.index).astype(object).where(~np.isnan(score), None)
        yield out

    def close(self) -> None:
        pass


def tree_scores(
    rows: DataFrame,
    features: list[str],
    trees: int = halfspace.TREES,
    height: int = halfspace.HEIGHT,
    window: int = halfspace.WINDOW,
    seed: int = 42,
) -> DataFrame:
    """Rows (sensor_id, ts, seq, features in the unit range) -> OUTPUT; NULL in a sensor's first window."""
    drawn = halfspace.draw(len(features), trees, height, seed)
    return (
        rows.select("sensor_id", "ts", "seq", *features)
        .groupBy("sensor_id")
        .transformWithStateInPandas(
            statefulProcessor=TreeMasses(features, drawn, window), outputStructType=OUTPUT, outputMode="Append", timeMode="None"
        )
    )
