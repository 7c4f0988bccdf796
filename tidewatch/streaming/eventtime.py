"""The feature buffer by event time: rows wait in sorted state until the watermark has passed them.

The buffer of `buffer.py` goes by arrival: what a micro-batch brings is sorted and used at once.
Here a reading waits until no earlier one can come any more, so deliveries may be shuffled
within the allowed delay and still give the features of the ordered series. Timers release
sensors that have fallen silent. A reading that comes after its time is passed is not used; it
leaves with late = true, for a side table and its count.

The engine drops rows behind its own watermark without a trace. Its delay is therefore set
GRACE longer than the one rows wait for: it counts what is later than that, and all other late
rows come through here.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidewatch.operators.features import BUFFER, FEATURES
from tidewatch.streaming.buffer import INPUT, OUTPUT, STATE, buffer_features

GRACE_DAYS = 3650
GRACE_MS = GRACE_DAYS * 86_400_000
WAITING = T.StructType(
    [
        T.StructField("us", T.LongType()),
        T.StructField("seq", T.LongType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("value_scaled", T.DoubleType()),
    ]
)
COLUMNS = [f.name for f in WAITING.fields]


def _micros(stamps: pd.Series) -> np.ndarray:
    return stamps.to_numpy().astype("datetime64[us]").astype("int64")


def rows_out(key: str, rows: pd.DataFrame, late: bool, table: np.ndarray | None) -> pd.DataFrame:
    out = pd.DataFrame(
        {
            "sensor_id": key, "ts": pd.to_datetime(rows["us"].to_numpy(), unit="us"), "seq": rows["seq"].to_numpy(),
            "value": rows["value"].to_numpy(dtype=float), "value_scaled": rows["value_scaled"].to_numpy(dtype=float), "late": late,
        }
    )
    table = np.full((len(rows), len(FEATURES)), np.nan) if table is None else table
    return pd.concat([out, pd.DataFrame(table, columns=FEATURES)], axis=1)[[f.name for f in OUTPUT.fields]]


class EventTimeBuffer(StatefulProcessor):
    """State per sensor: the last 64 released values, and the rows that still wait.

    The rows of one sensor that wait are bounded by what it sends within the delay."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.released = handle.getValueState("released", STATE)
        self.waiting = handle.getListState("waiting", WAITING)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        horizon = self._horizon(timerValues)
        fresh = pd.concat(list(rows), ignore_index=True)
        fresh = fresh.assign(us=_micros(fresh["ts"]))[COLUMNS]
        late = fresh["us"].to_numpy() <= horizon
        if late.any():
            yield rows_out(key[0], fresh[late], True, None)
        yield from self._release(key, fresh[~late], horizon)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._release(key, None, self._horizon(timerValues))

    @staticmethod
    def _horizon(timerValues) -> int:
        """Microseconds up to which no row is awaited any more."""
        mark = timerValues.getCurrentWatermarkInMs()
        return (mark + GRACE_MS) * 1000 if mark > 0 else -(2**62)

    def _release(self, key, fresh: pd.DataFrame | None, horizon: int) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame(list(self.waiting.get()) if self.waiting.exists() else [], columns=COLUMNS)
        if fresh is not None and len(fresh):
            held = pd.concat([held, fresh], ignore_index=True) if len(held) else fresh
        held = held.astype({"us": "int64", "seq": "Int64", "value": float, "value_scaled": float}).sort_values(["us", "seq"], kind="stable")
        due = held["us"].to_numpy() <= horizon
        if due.any():
            yield self._features(key, held[due].reset_index(drop=True))
        rest = held[~due]
        if len(rest):
            plain = rest.astype(object).where(rest.notna(), None)
            self.waiting.put([tuple(r) for r in plain.itertuples(index=False, name=None)])
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(int(rest["us"].iloc[0]) // 1000 - GRACE_MS + 1)
        elif self.waiting.exists():
            self.waiting.clear()

    def _features(self, key, due: pd.DataFrame) -> pd.DataFrame:
        """Features of released rows in order; a missing value gets its row but is not buffered."""
        history, last = np.zeros(0), -(2**62)
        if self.released.exists():
            last, values = self.released.get()
            history = np.array(values, dtype=float)
        usable = due["value_scaled"].notna().to_numpy()
        table = np.full((len(due), len(FEATURES)), np.nan)
        fresh = due["value_scaled"].to_numpy(dtype=float)[usable]
        if len(fresh):
            table[usable] = buffer_features(history, fresh)
            history = np.concatenate([history, fresh])[-(BUFFER - 1) :]
            self.released.update((max(int(last), int(due["us"].iloc[-1])), history.tolist()))
        return rows_out(key[0], due, False, table)

    def close(self) -> None:
        pass


def ordered_features(stream: DataFrame, delay_minutes: int = 60) -> DataFrame:
    """Streaming readings with value_scaled, shuffled within the delay -> OUTPUT rows in order of time."""
    waits = f"{delay_minutes + GRACE_DAYS * 1440} minutes"
    return (
        stream.select(*INPUT)
        .withWatermark("ts", waits)
        .groupBy("sensor_id")
        .transformWithStateInPandas(
            statefulProcessor=EventTimeBuffer(), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime"
        )
    )


def on_time(rows: DataFrame) -> DataFrame:
    return rows.where(~F.col("late"))


def late_rows(rows: DataFrame) -> DataFrame:
    """The side table: sensor_id, ts, seq, value of what came after its time."""
    return rows.where("late").select("sensor_id", "ts", "seq", "value")
