"""Causal rolling features on the grid.

Work is grouped by (sensor_id, chunk) with CHUNK rows plus a halo: the last
HALO rows of a chunk are copied into the next one, so bounded frames see all
they need and no task ever holds a whole sensor. The exponentially weighted
mean has an unbounded memory; its value before the halo is carried as one row
per chunk.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewatch.operators.clean import CHUNK, floor_div

WINDOWS = (5, 15, 60)
BUFFER = 65
HALO = BUFFER - 1
EPS = 1e-9


def feature_names(windows: tuple[int, ...] = WINDOWS) -> list[str]:
    """The feature contract: this order is what every model sees."""
    per_window = ("roll_mean", "roll_std", "roll_min", "roll_max", "ewma", "zscore")
    return ["lag_1", "lag_2", "lag_3", "roc"] + [f"{f}_{w}" for w in windows for f in per_window]


FEATURES = feature_names()


def feature_set_hash(names: list[str]) -> str:
    """md5 of the JSON list of sorted names, 8 characters."""
    return hashlib.md5(json.dumps(sorted(names)).encode()).hexdigest()[:8]


def feature_set_hash_column(names: Column) -> Column:
    """The same hash for an ARRAY<STRING> column (JSON with ', ' between items)."""
    quoted = F.transform(F.array_sort(names), lambda n: F.concat(F.lit('"'), n, F.lit('"')))
    return F.substring(F.md5(F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))), 1, 8)


def decay(window: int) -> float:
    return 1.0 - 2.0 / (window + 1.0)


def with_series_start(df: DataFrame, value: str) -> DataFrame:
    """first_pos: the first slot with a value; one row per sensor joined back."""
    if "first_pos" in df.columns:
        return df
    start = df.where(F.col(value).isNotNull()).groupBy("sensor_id").agg(F.min("pos").alias("first_pos"))
    return df.join(start, "sensor_id", "left")


def ewma_carry(df: DataFrame, value: str, windows: tuple[int, ...], chunk: int, halo: int) -> DataFrame:
    """(sensor_id, chunk, y_w...): the full-history mean just before the chunk's halo.

    With chunk = 1024 the weight of anything older than the two previous chunks
    is below 1e-28, so two summary rows give the value to double precision.
    """
    x = F.col(value)
    at = F.col("_idx") % chunk
    cut = chunk - halo - 1  # offset of the last row before the next chunk's halo
    sums = []
    for w in windows:
        q = decay(w)
        sums.append((F.sum(F.when(at <= cut, x * F.pow(F.lit(q), cut - at))) * (1 - q)).alias(f"_near_{w}"))
        sums.append((F.sum(x * F.pow(F.lit(q), chunk - 1 - at)) * (1 - q)).alias(f"_end_{w}"))
    per_chunk = (
        df.where(F.col("_idx") >= 0)
        .groupBy("sensor_id", "_home")
        .agg(*sums, F.max(F.when(F.col("_idx") == 0, x)).alias("_seed"))
    )
    across = W.partitionBy("sensor_id").orderBy("_home")  # one row per chunk
    moved = []
    for w in windows:
        q = decay(w)
        # the seed row weighs 1 instead of 1 - q: its missing part decays like the rest
        end = F.col(f"_end_{w}") + F.coalesce(F.col("_seed"), F.lit(0.0)) * F.pow(F.lit(q), F.lit(chunk))
        before = F.coalesce(F.lag(end).over(across), F.col("_seed"), F.lit(0.0))
        moved.append((F.col(f"_near_{w}") + before * F.pow(F.lit(q), F.lit(chunk - halo))).alias(f"_y_{w}"))
    later = per_chunk.select("sensor_id", (F.col("_home") + 1).alias("_chunk"), *moved)
    first = per_chunk.where(F.col("_seed").isNotNull()).select(
        "sensor_id", F.col("_home").alias("_chunk"), *[F.col("_seed").alias(f"_y_{w}") for w in windows]
    )
    return later.unionByName(first)


def _prepared(df: DataFrame, value: str, chunk: int, halo: int) -> tuple[DataFrame, DataFrame]:
    placed = with_series_start(df, value).withColumn("_idx", F.col("pos") - F.col("first_pos"))
    placed = placed.withColumn("_home", floor_div(F.coalesce(F.col("_idx"), F.lit(-1)), chunk))
    copies = F.when(
        (F.col("_idx") >= 0) & (F.col("_idx") % chunk >= chunk - halo), F.array(F.col("_home"), F.col("_home") + 1)
    ).otherwise(F.array(F.col("_home")))
    # By both: rows that come dealt by sensor alone would satisfy the windows as well, and keep a hot sensor in one task.
    return placed, placed.withColumn("_chunk", F.explode(copies)).repartition("sensor_id", "_chunk")


def rolling_features(
    df: DataFrame,
    value: str = "value_scaled",
    windows: tuple[int, ...] = WINDOWS,
    online: bool = False,
    chunk: int = CHUNK,
) -> DataFrame:
    """All contract features per row.

    online=False: mean over the whole history, NULL while a window is not full.
    online=True: what a buffer of the last 65 readings gives — the mean is
    re-seeded at the oldest buffered reading and missing features count as 0.
    """
    if max(windows) > HALO or not CHUNK // 2 <= chunk <= CHUNK:
        # below, two chunks no longer hold the whole memory of the slow mean; above, its powers overflow
        raise ValueError(f"windows must be at most {HALO} and the chunk between {CHUNK // 2} and {CHUNK}")
    keep = list(df.columns)
    placed, haloed = _prepared(df, value, chunk, HALO)
    x = F.col(value)
    by_idx = W.partitionBy("sensor_id", "_chunk").orderBy("pos")
    cols: dict[str, Column] = {f"lag_{k}": F.lag(x, k).over(by_idx) for k in (1, 2, 3)}
    cols["roc"] = x - F.lag(x, 1).over(by_idx)
    # offset inside the chunk; the carried value sits just before offset 0
    start = F.greatest(F.col("_chunk") * chunk - HALO, F.lit(0))
    offset = F.col("_idx") - start
    running = by_idx.rowsBetween(W.unboundedPreceding, 0)
    for w in windows:
        cols[f"_sum_{w}"] = F.sum(F.when(F.col("_idx") >= 0, x * F.pow(F.lit(decay(w)), -offset))).over(running)
    frames, later = _frames(windows)
    for w in frames:
        for name, column in _direct(x, by_idx, w).items():
            cols[name] = column
    if online:
        cols["_old"] = F.lag(x, HALO).over(by_idx)
        cols["_first"] = F.first(F.when(F.col("_idx") >= 0, x), ignorenulls=True).over(running)
    out = haloed.select("*", *[c.alias(n) for n, c in cols.items()])
    for small, w in later:
        out = out.select("*", *[c.alias(n) for n, c in _nested(by_idx, small, w).items()])
    out = out.withColumns({f"roll_std_{w}": F.sqrt(F.col(f"_m2_{w}") / F.lit(w - 1.0)) for w in windows})
    if online:
        out = out.withColumns({f"_old_{w}": F.lag(f"_sum_{w}", HALO).over(by_idx) for w in windows})
        out = out.withColumns({f"ewma_{w}": _buffered_mean(w, offset) for w in windows})
    else:
        carry = ewma_carry(placed, value, windows, chunk, HALO)
        out = out.join(carry, ["sensor_id", "_chunk"], "left")
        out = out.withColumns({f"ewma_{w}": _history_mean(w, offset) for w in windows})
    out = out.where(F.col("_chunk") == F.col("_home"))
    out = out.withColumns(
        {f"zscore_{w}": (x - F.col(f"roll_mean_{w}")) / (F.col(f"roll_std_{w}") + F.lit(EPS)) for w in windows}
    )
    names = feature_names(windows)
    out = out.select(*keep, *names)
    return out.na.fill(0.0, subset=names) if online else out


def _frames(windows: tuple[int, ...]) -> tuple[list[int], list[tuple[int, int]]]:
    """Which windows need a row frame, and which are a few shifted copies of a smaller one.

    A frame costs its length per row; 60 = 4 x 15 and 15 = 3 x 5 cost a few lags.
    """
    direct, nested = [], []
    for i, w in enumerate(sorted(windows)):
        parts = [s for s in sorted(windows)[:i] if w % s == 0]
        if parts:
            nested.append((parts[-1], w))
        else:
            direct.append(w)
    return direct, nested


def _direct(x: Column, by_idx, w: int) -> dict[str, Column]:
    frame = by_idx.rowsBetween(-(w - 1), 0)
    full = F.col("_idx") >= w - 1  # the grid has no holes after its first value
    return {
        f"roll_mean_{w}": F.when(full, F.avg(x).over(frame)),
        f"roll_min_{w}": F.when(full, F.min(x).over(frame)),
        f"roll_max_{w}": F.when(full, F.max(x).over(frame)),
        f"_m2_{w}": F.when(full, F.var_pop(x).over(frame) * F.lit(float(w))),
    }


def _nested(by_idx, small: int, w: int) -> dict[str, Column]:
    """Window w from its w / small disjoint parts. Squared deviations are combined around
    the joint mean, which loses no precision, unlike differences of running sums."""
    shifted = lambda name: [F.col(f"{name}_{small}")] + [
        F.lag(f"{name}_{small}", k * small).over(by_idx) for k in range(1, w // small)
    ]
    full = F.col("_idx") >= w - 1
    means = shifted("roll_mean")
    mean = sum(means[1:], means[0]) / F.lit(float(len(means)))
    spread = sum(shifted("_m2"), F.lit(0.0)) + F.lit(float(small)) * sum(
        ((m - mean) * (m - mean) for m in means), F.lit(0.0)
    )
    return {
        f"roll_mean_{w}": F.when(full, mean),
        f"roll_min_{w}": F.when(full, F.least(*shifted("roll_min"))),
        f"roll_max_{w}": F.when(full, F.greatest(*shifted("roll_max"))),
        f"_m2_{w}": F.when(full, spread),
    }


def _history_mean(w: int, offset: Column) -> Column:
    q = decay(w)
    local = F.col(f"_sum_{w}") * F.pow(F.lit(q), offset) * (1 - q)
    return F.when(F.col("_idx") >= 0, local + F.col(f"_y_{w}") * F.pow(F.lit(q), offset + 1))


def _buffered_mean(w: int, offset: Column) -> Column:
    """The last 64 weighted readings plus the oldest buffered one as the seed.

    Until the buffer is full the seed is the very first reading of the sensor.
    """
    q = decay(w)
    recent = F.col(f"_sum_{w}") - F.coalesce(F.col(f"_old_{w}"), F.lit(0.0))
    local = recent * F.pow(F.lit(q), offset) * (1 - q)
    full = F.col("_old") * F.pow(F.lit(q), F.lit(HALO))
    seed = F.when(F.col("_idx") >= HALO, full).otherwise(F.col("_first") * F.pow(F.lit(q), F.col("_idx") + 1))
    return F.when(F.col("_idx") >= 0, local + seed)


def baseline_stats(df: DataFrame, features: list[str] | None = None) -> DataFrame:
    """(feature, mean, std, ord): one wide aggregate, then unpivoted. Sample deviation."""
    names = features or FEATURES
    wide = df.agg(
        *[F.avg(c).alias(f"m_{c}") for c in names], *[F.stddev_samp(c).alias(f"s_{c}") for c in names]
    )
    rows = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("feature"),
                    F.col(f"m_{c}").alias("mean"),
                    F.col(f"s_{c}").alias("std"),
                    F.lit(i).alias("ord"),
                )
                for i, c in enumerate(names)
            ]
        )
    )
    return wide.select(rows.alias("r")).select("r.*")


def retraining_features(df: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """rolling(15) with partial frames, z-score without epsilon, two differences.

    Input: sensor_id, pos (0-based, dense per sensor), value.
    """
    src = df.withColumn("_home", floor_div(F.col("pos"), chunk))
    copies = F.when(F.col("pos") % chunk >= chunk - 16, F.array(F.col("_home"), F.col("_home") + 1)).otherwise(
        F.array(F.col("_home"))
    )
    haloed = src.withColumn("_chunk", F.explode(copies))
    w = W.partitionBy("sensor_id", "_chunk").orderBy("pos")
    frame = w.rowsBetween(-14, 0)
    x = F.col("value")
    first = x - F.lag(x, 1).over(w)
    out = haloed.select(
        "*",
        F.avg(x).over(frame).alias("rolling_mean"),
        F.coalesce(F.stddev_samp(x).over(frame), F.lit(EPS)).alias("rolling_std"),
        F.coalesce(first, F.lit(0.0)).alias("value_diff_1"),
    )
    out = out.withColumn(
        "value_diff_2", F.coalesce(F.col("value_diff_1") - F.lag("value_diff_1", 1).over(w), F.lit(0.0))
    ).where(F.col("_chunk") == F.col("_home"))
    z = (x - F.col("rolling_mean")) / F.nullif(F.col("rolling_std"), F.lit(0.0))
    return out.withColumn("zscore_15", z).drop("_home", "_chunk")
