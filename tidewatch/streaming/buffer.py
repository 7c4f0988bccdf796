"""The online feature buffer: the last 65 readings per sensor as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidewatch.operators.features import BUFFER, EPS, FEATURES, WINDOWS, decay

INPUT = ["sensor_id", "ts", "seq", "value", "value_scaled"]
OUTPUT = T.StructType(
    [
        T.StructField("sensor_id", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("seq", T.LongType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("value_scaled", T.DoubleType()),
        T.StructField("late", T.BooleanType()),
    ]
    + [T.StructField(name, T.DoubleType()) for name in FEATURES]
)
STATE = T.StructType(
    [
        T.StructField("last_us", T.LongType()),
        T.StructField("values", T.ArrayType(T.DoubleType())),
    ]
)


def buffer_features(history: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """Contract features of each fresh value as the newest row of its 65-value buffer.

    Missing features count as 0, as they do for a model that is asked online.
    """
    series = np.concatenate([history, fresh])
    n, first = len(series), len(history)
    shifted = lambda k: np.concatenate([np.full(min(k, n), np.nan), series[: max(n - k, 0)]])
    columns: dict[str, np.ndarray] = {f"lag_{k}": shifted(k) for k in (1, 2, 3)}
    columns["roc"] = series - shifted(1)
    for w in WINDOWS:
        stats = np.full((4, n), np.nan)
        if n >= w:
            view = np.lib.stride_tricks.sliding_window_view(series, w)
            stats[:, w - 1 :] = view.mean(1), view.std(1, ddof=1), view.min(1), view.max(1)
        for name, row in zip(("mean", "std", "min", "max"), stats):
            columns[f"roll_{name}_{w}"] = row
        q = decay(w)
        powers = q ** np.arange(BUFFER)[::-1]  # weight of age 64 .. 0
        weights = (1 - q) * powers
        weights[0] = powers[0]  # the oldest buffered value seeds the mean
        mean = np.empty(n)
        for i in range(first, min(n, BUFFER - 1)):
            part = (1 - q) * powers[BUFFER - 1 - i :]
            part[0] = powers[BUFFER - 1 - i]
            mean[i] = part @ series[: i + 1]
        if n >= BUFFER:
            mean[BUFFER - 1 :] = np.lib.stride_tricks.sliding_window_view(series, BUFFER) @ weights
        columns[f"ewma_{w}"] = mean
        columns[f"zscore_{w}"] = (series - stats[0]) / (stats[1] + EPS)
    table = np.column_stack([columns[name] for name in FEATURES])[first:]
    return np.nan_to_num(table, nan=0.0)


class FeatureBuffer(StatefulProcessor):
    """Sorts a sensor's rows inside the micro-batch, appends them to the buffer and emits
    one feature row each. A row older than the newest buffered one comes too late: it
    is emitted with late = true and does not touch the buffer. A missing value gets
    its row but is not buffered.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("buffer", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True).sort_values(["ts", "seq"], kind="stable")
        last_us, history = -(2**62), np.zeros(0)
        if self.state.exists():
            last_us, values = self.state.get()
            history = np.array(values, dtype=float)
        stamp = batch["ts"].to_numpy().astype("datetime64[us]").astype("int64")
        batch = batch.assign(late=stamp < last_us)
        usable = ~batch["late"].to_numpy() & batch["value_scaled"].notna().to_numpy()
        out = batch[INPUT + ["late"]].copy()
        table = np.full((len(batch), len(FEATURES)), np.nan)
        fresh = batch["value_scaled"].to_numpy(dtype=float)[usable]
        if len(fresh):
            table[usable] = buffer_features(history, fresh)
            history = np.concatenate([history, fresh])[-(BUFFER - 1) :]
            self.state.update((int(stamp[usable].max()), history.tolist()))
        for i, name in enumerate(FEATURES):
            out[name] = table[:, i]
        yield out[[f.name for f in OUTPUT.fields]]

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        ordered = initialState.sort_values("ts").tail(BUFFER - 1)
        stamp = ordered["ts"].to_numpy().astype("datetime64[us]").astype("int64")
        self.state.update((int(stamp.max()), ordered["value_scaled"].to_numpy(dtype=float).tolist()))

    def close(self) -> None:
        pass


def warm_rows(history: DataFrame, order: str = "ts") -> DataFrame:
    """The last 65 rows per sensor of a batch table, to preload the buffers.

    The row_number limit reaches below the shuffle, so a hot sensor stays cheap.
    """
    from tidewatch.operators.drift import live_window

    return live_window(history.select("sensor_id", "ts", "value_scaled"), ["sensor_id"], [F.col(order)], BUFFER)


def online_features(stream: DataFrame, warm: DataFrame | None = None) -> DataFrame:
    """Streaming (or batch) readings with value_scaled -> OUTPUT rows."""
    start = warm.groupBy("sensor_id") if warm is not None else None
    return (
        stream.select(*INPUT)
        .groupBy("sensor_id")
        .transformWithStateInPandas(
            statefulProcessor=FeatureBuffer(),
            outputStructType=OUTPUT,
            outputMode="Append",
            timeMode="None",
            initialState=start,
        )
    )
