"""Runs of anomalies on the stream: predicted segments and true windows, closed as they end.

A run stays open in state while its rows come, across micro-batches. The first row outside
closes it; if a sensor falls silent inside a run, a timer does once the watermark has passed
the run's last row by `idle`. A closed run leaves with its length, its hits and its latency.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidewatch.operators.evaluate import MINUTES_PER_STEP

SEGMENT, WINDOW = "segment", "window"
RUN = [
    T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()),
    T.StructField("hit", T.IntegerType()),
    T.StructField("first_hit", T.LongType()),
    T.StructField("last_us", T.LongType()),
]
OUTPUT = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("sensor_id", T.StringType()),
        *RUN[:-1],
        T.StructField("latency_min", T.DoubleType()),
        T.StructField("closed_by", T.StringType()),
    ]
)


def advance(run: tuple | None, flag: np.ndarray, other: np.ndarray, pos: np.ndarray, us: np.ndarray) -> tuple[list[tuple], tuple | None]:
    """(closed runs, the open run) after rows in order; a run is (start, length, hit, first_hit, last_us)."""
    closed: list[tuple] = []
    edges = np.flatnonzero(np.diff(flag, prepend=1 - flag[0])).tolist() + [len(flag)]
    for begin, until in zip(edges, edges[1:]):
        if not flag[begin]:
            if run is not None:
                closed.append(run)
                run = None
            continue
        hits = np.flatnonzero(other[begin:until])
        first = int(pos[begin + hits[0]]) if len(hits) else None
        if run is None:
            run = (int(pos[begin]), 0, 0, None, 0)
        start, length, hit, first_hit, _ = run
        run = (start, length + until - begin, max(hit, int(len(hits) > 0)), first if first_hit is None else first_hit, int(us[until - 1]))
    return closed, run


class OpenRuns(StatefulProcessor):
    """State per (model, sensor): at most one open segment and one open window."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = {kind: handle.getValueState(kind, T.StructType(RUN)) for kind in (SEGMENT, WINDOW)}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True).sort_values(["ts", "pos"], kind="stable")
        us = batch["ts"].to_numpy().astype("datetime64[us]").astype("int64")
        pred, label, pos = (batch[c].to_numpy(dtype=np.int64) for c in ("pred", "label", "pos"))
        for kind, flag, other in ((SEGMENT, pred, label), (WINDOW, label, pred)):
            state = self.open[kind]
            run = tuple(state.get()) if state.exists() else None
            closed, run = advance(run, flag, other, pos, us)
            if run is not None:
                state.update(run)
                self.handle.registerTimer(run[4] // 1000 + self.idle_ms)
            elif state.exists():
                state.clear()
            if closed:
                yield self._out(kind, key, closed, "row")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        expired = expiredTimerInfo.getExpiryTimeInMs()
        for kind, state in self.open.items():
            # An older timer of a run that has gone on since says nothing.
            if state.exists() and state.get()[4] // 1000 + self.idle_ms <= expired:
                run = tuple(state.get())
                state.clear()
                yield self._out(kind, key, [run], "timer")

    def _out(self, kind: str, key, runs: list[tuple], closed_by: str) -> pd.DataFrame:
        rows = []
        for start, length, hit, first_hit, _ in runs:
            steps = length if first_hit is None else first_hit - start
            rows.append((kind, key[0], key[1], start, length, hit, first_hit, steps * MINUTES_PER_STEP, closed_by))
        out = pd.DataFrame(rows, columns=OUTPUT.names)
        return out.astype({"first_hit": "Int64"})

    def close(self) -> None:
        pass


def closed_runs(predictions: DataFrame, delay_minutes: int = 60, idle_minutes: int = 30) -> DataFrame:
    """Streaming (model, sensor_id, ts, pos, label, pred), a sensor's rows in order -> OUTPUT rows.

    Segments are runs of pred = 1, and hit tells whether they touch a true anomaly; windows are runs of label = 1
    with their first predicted position; a missed window's latency is its own length."""
    rows = predictions.select("model", "sensor_id", "ts", F.col("pos").cast("bigint").alias("pos"), "label", "pred")
    return (
        rows.withWatermark("ts", f"{delay_minutes} minutes")
        .groupBy("model", "sensor_id")
        .transformWithStateInPandas(
            statefulProcessor=OpenRuns(idle_minutes * 60_000), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime"
        )
    )


def latency_by_model(closed: DataFrame) -> DataFrame:
    """Window metrics of the runs closed so far, as `evaluate.window_metrics` gives them for a finished table."""
    segment, window = F.col("kind") == SEGMENT, F.col("kind") == WINDOW
    rates = closed.groupBy("model").agg(
        F.count_if(window).alias("n_windows"), F.count_if(segment).alias("n_segments"),
        F.avg(F.when(window, F.col("hit"))).alias("recall"), F.avg(F.when(segment, F.col("hit"))).alias("precision"),
        F.avg(F.when(window, F.col("latency_min"))).alias("latency"),
    )
    none = F.col("n_windows") == 0
    precision = F.when(none, 1.0).otherwise(F.coalesce("precision", F.lit(0.0)))
    recall = F.when(none, 1.0).otherwise(F.col("recall"))
    both = precision + recall
    return rates.select(
        "model", precision.alias("window_precision"), recall.alias("window_recall"),
        F.when(both == 0, 0.0).otherwise(2 * precision * recall / both).alias("window_f1"),
        F.coalesce("latency", F.lit(0.0)).alias("detection_latency_min"),
    )
