"""Drift on the stream: the last 500 feature rows as keyed state, per sensor or over all sensors.

Over all sensors two stateful steps follow each other. The first, by sensor, lets only those
rows pass that are among the sensor's own newest ones; of a micro-batch that is a bounded number
per sensor. The second merges them into one window of the newest rows of all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidewatch.operators.drift import BINS, EPS, FLOOR, LIVE_ROWS, SPAN, Stats, normal_shares

OUTPUT = T.StructType(
    [
        T.StructField("sensor_id", T.StringType()),
        T.StructField("as_of", T.TimestampType()),
        T.StructField("feature", T.StringType()),
        T.StructField("ord", T.IntegerType()),
        T.StructField("n", T.LongType()),
        T.StructField("psi", T.DoubleType()),
        T.StructField("shift", T.DoubleType()),
        T.StructField("status", T.StringType()),
    ]
)
STATE = T.StructType([T.StructField("rows", T.ArrayType(T.DoubleType()))])


def window_drift(window: np.ndarray, stats: Stats) -> list[tuple]:
    """(feature, ord, n, psi, shift, status) of a (rows, features) window."""
    out = []
    expected = np.maximum(normal_shares(), FLOOR)
    for i, (name, mean, std) in enumerate(stats):
        live = window[:, i]
        shift = (live.mean() - mean) / (std + EPS)
        psi = None
        if std > 0:
            low = mean - SPAN * std
            width = (mean + SPAN * std - low) / BINS
            bins = (live[:, None] >= low + width * np.arange(1, BINS)[None, :]).sum(1)
            actual = np.maximum(np.bincount(bins, minlength=BINS) / len(live), FLOOR)
            psi = float(((actual - expected) * np.log(actual / expected)).sum())
        p, s = psi or 0.0, abs(shift)
        status = "critical" if p >= 0.25 or s >= 3 else "warning" if p >= 0.1 or s >= 2 else "stable"
        out.append((name, i, len(live), psi, float(shift), status))
    return out


class DriftWindow(StatefulProcessor):
    """Keeps at most 500 x features numbers per sensor and reports after every micro-batch."""

    def __init__(self, stats: Stats, size: int = LIVE_ROWS):
        self.stats, self.size = stats, size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("window", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = [s[0] for s in self.stats]
        newest = None
        for part in rows:  # only the newest rows of a large batch are kept in memory
            newest = part if newest is None else pd.concat([newest, part])
            newest = newest.sort_values(["ts", "seq"], kind="stable").tail(self.size)
        window = newest[names].to_numpy(dtype=float)
        if self.state.exists():
            old = np.array(self.state.get()[0], dtype=float).reshape(-1, len(names))
            window = np.vstack([old, window])[-self.size :]
        self.state.update((window.ravel().tolist(),))
        out = pd.DataFrame(window_drift(window, self.stats), columns=["feature", "ord", "n", "psi", "shift", "status"])
        out.insert(0, "as_of", newest["ts"].iloc[-1])
        out.insert(0, "sensor_id", key[0])
        yield out

    def close(self) -> None:
        pass


NEWEST = T.StructType([T.StructField("us", T.ArrayType(T.LongType())), T.StructField("seq", T.ArrayType(T.LongType()))])


def _micros(stamps: pd.Series) -> np.ndarray:
    return stamps.to_numpy().astype("datetime64[us]").astype("int64")


class NewestOfSensor(StatefulProcessor):
    """Passes the rows on that are among the sensor's `size` newest so far; keeps their times only."""

    def __init__(self, size: int):
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("newest", NEWEST)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        us, seq = (np.array(x, np.int64) for x in self.state.get()) if self.state.exists() else (np.zeros(0, np.int64),) * 2
        newest = None
        for part in rows:
            newest = part if newest is None else pd.concat([newest, part])
            newest = newest.sort_values(["ts", "seq"], kind="stable").tail(self.size)
        both = np.stack([np.concatenate([us, _micros(newest["ts"])]), np.concatenate([seq, newest["seq"].to_numpy(np.int64)])])
        kept = np.lexsort((both[1], both[0]))[-self.size :]
        self.state.update((both[0, kept].tolist(), both[1, kept].tolist()))
        passed = np.sort(kept[kept >= len(us)] - len(us))
        yield newest.iloc[passed]

    def close(self) -> None:
        pass


class NewestOfAll(StatefulProcessor):
    """One window over all sensors: `size` x features numbers. Reports after every micro-batch."""

    def __init__(self, stats: Stats, size: int):
        self.stats, self.size = stats, size

    def init(self, handle: StatefulProcessorHandle) -> None:
        fields = [T.StructField("us", T.LongType()), T.StructField("sensor_id", T.StringType()), T.StructField("seq", T.LongType())]
        fields.append(T.StructField("x", T.ArrayType(T.DoubleType())))
        self.state = handle.getListState("window", T.StructType(fields))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = [s[0] for s in self.stats]
        window = list(self.state.get()) if self.state.exists() else []
        for part in rows:
            x = part[names].to_numpy(dtype=float).tolist()
            window += zip(_micros(part["ts"]).tolist(), part["sensor_id"], part["seq"].tolist(), x)
            window = sorted(window, key=lambda row: row[:3])[-self.size :]
        self.state.put([tuple(row) for row in window])
        report = window_drift(np.array([row[3] for row in window], dtype=float), self.stats)
        out = pd.DataFrame(report, columns=["feature", "ord", "n", "psi", "shift", "status"])
        out.insert(0, "as_of", pd.Timestamp(window[-1][0], unit="us"))
        out.insert(0, "sensor_id", "all")
        yield out

    def close(self) -> None:
        pass


def drift_of_all(features: DataFrame, stats: Stats, size: int = LIVE_ROWS) -> DataFrame:
    """OUTPUT rows with sensor_id = 'all': drift of the newest `size` rows by (ts, sensor_id)."""
    names = [s[0] for s in stats]
    rows = features.select("sensor_id", "ts", "seq", *names)
    newest = rows.groupBy("sensor_id").transformWithStateInPandas(
        statefulProcessor=NewestOfSensor(size), outputStructType=rows.schema, outputMode="Append", timeMode="None"
    )
    return (
        newest.withColumn("scope", F.lit("all"))
        .groupBy("scope")
        .transformWithStateInPandas(
            statefulProcessor=NewestOfAll(stats, size), outputStructType=OUTPUT, outputMode="Append", timeMode="None"
        )
    )


def drift_stream(features: DataFrame, stats: Stats, size: int = LIVE_ROWS) -> DataFrame:
    names = [s[0] for s in stats]
    return (
        features.select("sensor_id", "ts", "seq", *names)
        .groupBy("sensor_id")
        .transformWithStateInPandas(
            statefulProcessor=DriftWindow(stats, size), outputStructType=OUTPUT, outputMode="Append", timeMode="None"
        )
    )
