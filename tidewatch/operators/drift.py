"""Distribution drift against a baseline: histogram, PSI, mean shift, status.

Features are unpivoted inside the scan and counted with map-side combine, so
what is shuffled is one partial row per (group, feature) and task.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewatch.operators.clean import floor_div

BINS = 10
SPAN = 3.0
FLOOR = 1e-6
EPS = 1e-9
LIVE_ROWS = 500
MIN_ROWS = 50
HISTORY = 100
Stats = list[tuple[str, float, float]]


def normal_shares(bins: int = BINS, span: float = SPAN) -> list[float]:
    """Share of a normal law per bin of mean ± 3 sigma; the tails belong to the outer bins."""
    cdf = [0.5 * (1 + math.erf((-span + 2 * span * i / bins) / math.sqrt(2))) for i in range(bins + 1)]
    cdf[0], cdf[-1] = 0.0, 1.0
    return [b - a for a, b in zip(cdf, cdf[1:])]


def psi_terms(expected: Column, actual: Column) -> Column:
    e, a = F.greatest(expected, F.lit(FLOOR)), F.greatest(actual, F.lit(FLOOR))
    return (a - e) * F.log(a / e)


def psi(expected: list[Column], actual: list[Column]) -> Column:
    """Population stability index of two share lists; both are floored."""
    total = F.lit(0.0)
    for e, a in zip(expected, actual):
        total = total + psi_terms(e, a)
    return total


def mean_shift(mean: Column, std: Column, live: Column) -> Column:
    return (live - mean) / (std + F.lit(EPS))


def classify(psi_value: Column, shift: Column) -> Column:
    p, s = F.coalesce(psi_value, F.lit(0.0)), F.abs(shift)
    return (
        F.when((p >= 0.25) | (s >= 3.0), "critical").when((p >= 0.1) | (s >= 2.0), "warning").otherwise("stable")
    )


def of_stats(stats: Stats, place: int) -> Column:
    """Field `place` (0 feature, 1 mean, 2 std) of the baseline entry `ord`."""
    return F.get(F.array(*[F.lit(s[place]) for s in stats]), F.col("ord"))


def unpivot(df: DataFrame, keys: list[str], stats: Stats) -> DataFrame:
    """(keys, ord, value, bin); missing values are left out.

    `stats` is the baseline table of a model, one entry per contract feature; `ord` is
    the place in it. The bin is worked out after the explode from looked-up edges: 22
    copies of the comparison would make a method too large for the JIT compiler.
    """
    values = F.array(*[F.col(name) for name, _, _ in stats])
    long = df.select(*keys, F.posexplode(values).alias("ord", "value")).where(F.col("value").isNotNull())
    mean, std = of_stats(stats, 1), of_stats(stats, 2)
    low = mean - F.lit(SPAN) * std
    edged = long.withColumns({"_low": low, "_width": (mean + F.lit(SPAN) * std - low) / F.lit(float(BINS))})
    above = [(F.col("value") >= F.col("_low") + F.lit(float(k)) * F.col("_width")).cast("int") for k in range(1, BINS)]
    return edged.withColumn("bin", sum(above, F.lit(0))).drop("_low", "_width")


def bin_counts(df: DataFrame, keys: list[str], stats: Stats) -> DataFrame:
    """(keys, ord, bin, n, total): at most ten rows per group and feature leave a task."""
    return unpivot(df, keys, stats).groupBy(*keys, "ord", "bin").agg(
        F.count("*").alias("n"), F.sum("value").alias("total")
    )


def histogram(df: DataFrame, keys: list[str], stats: Stats) -> DataFrame:
    """(keys, feature, bin, n); bins 0..9, rows beyond ± 3 sigma in the outer bins."""
    return bin_counts(df, keys, stats).select(*keys, of_stats(stats, 0).alias("feature"), "bin", "n")


def feature_drift(df: DataFrame, keys: list[str], stats: Stats) -> DataFrame:
    """(keys, feature, ord, n, psi, shift, status)."""
    counted = (
        bin_counts(df, keys, stats)
        .groupBy(*keys, "ord")
        .agg(
            F.sum("n").alias("n"),
            F.sum("total").alias("total"),
            *[F.sum(F.when(F.col("bin") == b, F.col("n")).otherwise(0)).alias(f"b{b}") for b in range(BINS)],
        )
    )
    mean, std = of_stats(stats, 1), of_stats(stats, 2)
    shares = [F.col(f"b{b}") / F.col("n") for b in range(BINS)]
    index = psi([F.lit(e) for e in normal_shares()], shares)
    # without spread there are no bins: the shift alone decides
    out = counted.withColumns(
        {
            "feature": of_stats(stats, 0),
            "psi": F.when(std > 0, index),
            "shift": mean_shift(mean, std, F.col("total") / F.col("n")),
        }
    )
    return out.select(*keys, "feature", "ord", "n", "psi", "shift", classify(F.col("psi"), F.col("shift")).alias("status"))


def roll_up(per_feature: DataFrame, keys: list[str]) -> DataFrame:
    """Worst status, highest PSI, largest signed shift, affected features in contract order."""
    level = F.when(F.col("status") == "critical", 2).when(F.col("status") == "warning", 1).otherwise(0)
    hit = F.when(F.col("status") != "stable", F.struct("ord", "feature"))
    rolled = per_feature.groupBy(*keys).agg(
        F.max(level).alias("level"),
        F.greatest(F.max("psi"), F.lit(0.0)).alias("psi"),
        F.max_by("shift", F.struct(F.abs(F.col("shift")), -F.col("ord"))).alias("mean_shift_sigma"),
        F.array_sort(F.collect_list(hit)).alias("hits"),  # at most one entry per contract feature
        F.max("n").alias("n_rows"),
    )
    return _reported(rolled, keys)


def _reported(rolled: DataFrame, keys: list[str]) -> DataFrame:
    """The report of (keys, level, psi, mean_shift_sigma, hits, n_rows)."""
    waiting = F.col("n_rows") < MIN_ROWS
    worst = F.element_at(F.array(F.lit("stable"), F.lit("warning"), F.lit("critical")), F.col("level") + 1)
    advice = F.element_at(
        F.array(F.lit("No action"), F.lit("Monitor"), F.lit("Retraining recommended")), F.col("level") + 1
    )
    none = F.array().cast("array<string>")
    return rolled.select(
        *keys,
        "n_rows",
        F.when(waiting, "stable").otherwise(worst).alias("status"),
        F.when(waiting, 0.0).otherwise(F.col("psi")).alias("psi"),
        F.when(waiting, 0.0).otherwise(F.coalesce("mean_shift_sigma", F.lit(0.0))).alias("mean_shift_sigma"),
        F.when(waiting, none).otherwise(F.transform("hits", lambda h: h["feature"])).alias("affected_features"),
        F.when(waiting, "Waiting for more data").otherwise(advice).alias("recommendation"),
    )


def live_window(df: DataFrame, keys: list[str], order: list[Column], size: int = LIVE_ROWS) -> DataFrame:
    """The newest `size` rows per key. row_number <= size is pushed below the shuffle
    (window group limit), so a hot key sends `size` rows per task at most."""
    if not keys:
        return df.orderBy(*[c.desc() for c in order]).limit(size)
    w = W.partitionBy(*keys).orderBy(*[c.desc() for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= size).drop("_rn")


def check(df: DataFrame, keys: list[str], stats: Stats, order: list[Column]) -> DataFrame:
    """Drift of the live window per key; keys=[] checks all sensors together."""
    own = keys or ["scope"]
    if not stats:
        src = df.select(*keys).distinct() if keys else df.select(F.lit("all").alias("scope")).limit(1)
        return src.withColumns({"status": F.lit("stable"), "recommendation": F.lit("No baseline stats available")})
    live = live_window(df, keys, order)
    if not keys:
        live = live.withColumn("scope", F.lit("all"))
    return roll_up(feature_drift(live, own, stats), own)


def over_time(df: DataFrame, stats: Stats, width: str = "1 day") -> DataFrame:
    """The same check for every time window of the whole history, per sensor."""
    keyed = df.withColumn("window_start", F.window("ts", width)["start"])
    return feature_drift(keyed, ["window_start", "sensor_id"], stats)


#: Rows of a group whose live windows are worked out together; each group also holds the window before it.
STRETCH = 2048


def at_every_reading(df: DataFrame, stats: Stats, size: int = LIVE_ROWS, stretch: int = STRETCH) -> DataFrame:
    """The report (sensor_id, pos, ...) that a check after each reading would give: over the newest `size` rows up to it.

    Input: sensor_id, pos (dense per sensor) and the features. Groups are stretches of a sensor's rows with the `size` - 1
    rows before them as a halo, so a hot sensor is many groups. In a group bins are counted once, as prefix sums; a
    window's histogram is the difference of two of them."""
    names = [s[0] for s in stats]
    mean, std = (np.array([s[i] if s[i] is not None else np.nan for s in stats], float) for i in (1, 2))
    expected = np.maximum(normal_shares(), FLOOR)
    home = floor_div(F.col("pos"), stretch)
    last = floor_div(F.col("pos") + (size - 1), stretch)
    kind = dict(df.dtypes)["sensor_id"]
    sent = df.select("sensor_id", "pos", F.array(*[F.col(c).cast("double") for c in names]).alias("x"), F.explode(F.sequence(home, last)).alias("stretch"))

    def windows(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pos", kind="stable")
        pos, x = group["pos"].to_numpy(), np.stack([np.asarray(v, float) for v in group["x"]])
        own = np.flatnonzero(pos // stretch == key[1])
        if not len(own):  # only the halo of a stretch that has not begun
            kinds = {"sensor_id": object, "pos": int, "n_rows": int, "level": int, "psi": float, "mean_shift_sigma": float, "hits": object}
            return pd.DataFrame({c: pd.Series(dtype=t) for c, t in kinds.items()})
        there = ~np.isnan(x)
        low = mean - SPAN * std
        width = (mean + SPAN * std - low) / BINS
        bins = (x[:, :, None] >= low[:, None] + width[:, None] * np.arange(1, BINS)).sum(2)
        counts = np.zeros((len(x) + 1, len(names), BINS), np.int64)
        np.cumsum((bins[:, :, None] == np.arange(BINS)) & there[:, :, None], axis=0, out=counts[1:])
        sums = np.zeros((len(x) + 1, len(names)))
        np.cumsum(np.where(there, x - mean, 0.0), axis=0, out=sums[1:])  # around the mean: nothing large is taken off again
        before = np.searchsorted(pos, pos[own] - size + 1)
        inside = counts[own + 1] - counts[before]
        n = inside.sum(2)
        with np.errstate(divide="ignore", invalid="ignore"):
            actual = np.maximum(inside / n[:, :, None], FLOOR)
            index = np.where((std > 0) & (n > 0), ((actual - expected) * np.log(actual / expected)).sum(2), np.nan)
            shift = (sums[own + 1] - sums[before]) / n / (std + EPS)
        p, far = np.nan_to_num(index), np.nan_to_num(np.abs(shift))
        level = np.where((p >= 0.25) | (far >= 3.0), 2, np.where((p >= 0.1) | (far >= 2.0), 1, 0))
        place = far.argmax(1)
        return pd.DataFrame(
            {
                "sensor_id": group["sensor_id"].to_numpy()[own],
                "pos": pos[own],
                "n_rows": n.max(1),
                "level": level.max(1),
                "psi": np.maximum(p.max(1), 0.0),
                "mean_shift_sigma": shift[np.arange(len(own)), place],
                "hits": [np.flatnonzero(row).astype(np.int32) for row in level],
            }
        )

    schema = f"sensor_id {kind}, pos bigint, n_rows bigint, level int, psi double, mean_shift_sigma double, hits array<int>"
    rolled = sent.groupBy("sensor_id", "stretch").applyInPandas(windows, schema)
    named = F.array(*[F.lit(name) for name in names])
    rolled = rolled.withColumn("hits", F.transform("hits", lambda i: F.struct(i.alias("ord"), F.get(named, i).alias("feature"))))
    return _reported(rolled.where("n_rows > 0"), ["sensor_id", "pos"])


def append_history(history: DataFrame, new: DataFrame, ties: list[str] | None = None, keep: int = HISTORY) -> DataFrame:
    """The newest `keep` status rows."""
    both = history.unionByName(new)
    return both.orderBy(F.col("timestamp").desc(), *[F.col(c).desc() for c in ties or []]).limit(keep)


def latest_status(history: DataFrame, ties: list[str] | None = None) -> DataFrame:
    """The newest status row; a quiet default row when there is no history."""
    order = F.struct("timestamp", *(ties or []))
    newest = history.agg(F.max_by(F.struct("timestamp", "status", "psi"), order).alias("s"))
    return newest.select(
        F.col("s.timestamp").alias("timestamp"),
        F.coalesce("s.status", F.lit("stable")).alias("status"),
        F.coalesce("s.psi", F.lit(0.0)).alias("psi"),
    )
