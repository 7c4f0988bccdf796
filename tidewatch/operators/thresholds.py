"""Threshold selection on a validation split.

A sweep over m thresholds is one pass: each row falls between two thresholds,
counts per gap (at most m + 1 rows per model) are summed from the far end. The
search is as deep as the grid is wide, so a grid may have any number of points.
Rows are never crossed with thresholds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewatch.operators.scan import count_below, exact_quantiles

LINEAR_POINTS = 100
K_GRID = (1.0, 6.0, 51)
LOWER_PERCENTILES = (0.1, 10.0, 50, 1.0)  # first, last, points, fallback
UPPER_PERCENTILES = (80.0, 99.9, 100, 95.0)


def linspace(start, stop, points: int) -> Column:
    """points equally spaced values; the last one is exactly `stop`."""
    start, stop = (F.lit(v) if isinstance(v, (int, float)) else v for v in (start, stop))
    step = (stop - start) / F.lit(float(points - 1))
    inner = F.transform(F.sequence(F.lit(0), F.lit(points - 2)), lambda i: i * step + start)
    return F.concat(inner, F.array(stop))


def linear_grid(scores: DataFrame, keys: list[str], points: int = LINEAR_POINTS) -> DataFrame:
    """Per key, `points` thresholds from the lowest to the highest score."""
    return (
        scores.groupBy(*keys)
        .agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
        .select(*keys, linspace(F.col("lo"), F.col("hi"), points).alias("grid"))
    )


def fixed_grid(scores: DataFrame, keys: list[str], start: float, stop: float, points: int) -> DataFrame:
    return scores.select(*keys).distinct().withColumn("grid", linspace(start, stop, points))


def percentile_grid(scores: DataFrame, keys: list[str], first: float, last: float, points: int, fallback: float):
    """Thresholds at equally spaced percentiles, plus the fallback percentile."""
    step = (last - first) / (points - 1)
    percents = [first + i * step for i in range(points - 1)] + [last]
    probs = [p / 100.0 for p in percents] + [fallback / 100.0]
    ordered = [F.lit(p) for p in probs]
    found = exact_quantiles(scores, keys, "score", probs)
    by_prob = F.map_from_entries(F.collect_list(F.struct("prob", "quantile")))  # one entry per probability
    return (
        found.dropDuplicates([*keys, "prob"])
        .groupBy(*keys)
        .agg(by_prob.alias("at"))
        .select(
            *keys,
            F.transform(F.array(*ordered[:-1]), lambda p: F.element_at("at", p)).alias("grid"),
            F.element_at("at", ordered[-1]).alias("fallback"),
        )
    )


def sweep(scores: DataFrame, keys: list[str], grid: DataFrame, below: bool = False) -> DataFrame:
    """(keys, k, threshold, tp, predicted, positives, precision, recall, f1).

    A row is predicted anomalous when score > threshold (below=True: score < threshold).
    """
    oriented = grid.withColumn("search", F.reverse(F.transform("grid", lambda t: -t)) if below else F.col("grid"))
    value = -F.col("score") if below else F.col("score")
    placed = scores.join(oriented.select(*keys, "search"), keys).withColumn(
        "gap", count_below(F.col("search"), value)
    )
    counts = placed.groupBy(*keys, "gap").agg(F.sum("label").alias("pos"), F.count("*").alias("n"))
    totals = counts.groupBy(*keys).agg(F.sum("pos").alias("positives"))
    points = oriented.select(*keys, F.posexplode("search").alias("j", "searched"), F.size("grid").alias("m"))
    beyond = W.partitionBy(*keys).orderBy(F.col("j").desc()).rowsBetween(W.unboundedPreceding, 0)
    table = (
        points.withColumn("gap", F.col("j") + 1)
        .join(counts, [*keys, "gap"], "left")
        .withColumn("tp", F.coalesce(F.sum("pos").over(beyond), F.lit(0)))
        .withColumn("predicted", F.coalesce(F.sum("n").over(beyond), F.lit(0)))
        .join(totals, keys)
    )
    k = F.col("m") - 1 - F.col("j") if below else F.col("j")
    threshold = -F.col("searched") if below else F.col("searched")
    safe = lambda num, den: F.when(den == 0, 0.0).otherwise(num / den)
    return table.select(
        *keys,
        k.alias("k"),
        threshold.alias("threshold"),
        "tp",
        "predicted",
        "positives",
        safe(F.col("tp"), F.col("predicted")).alias("precision"),
        safe(F.col("tp"), F.col("positives")).alias("recall"),
        safe(2 * F.col("tp"), F.col("positives") + F.col("predicted")).alias("f1"),
    )


def best(swept: DataFrame, keys: list[str]) -> DataFrame:
    """The first threshold with the highest F1."""
    row = F.struct("k", "threshold", "precision", "recall", "f1")
    return swept.groupBy(*keys).agg(F.max_by(row, F.struct("f1", -F.col("k"))).alias("b")).select(*keys, "b.*")


def best_linear(scores: DataFrame, keys: list[str], points: int = LINEAR_POINTS) -> DataFrame:
    return best(sweep(scores, keys, linear_grid(scores, keys, points)), keys)


def best_of_fixed(scores: DataFrame, keys: list[str], start: float = K_GRID[0], stop: float = K_GRID[1], points: int = K_GRID[2]) -> DataFrame:
    return best(sweep(scores, keys, fixed_grid(scores, keys, start, stop, points)), keys)


def best_percentile(scores: DataFrame, keys: list[str], below: bool = False) -> DataFrame:
    """Percentile grids count only when F1 > 0; otherwise the fallback percentile holds."""
    grid = percentile_grid(scores, keys, *(LOWER_PERCENTILES if below else UPPER_PERCENTILES))
    found = best(sweep(scores, keys, grid.drop("fallback"), below), keys)
    useful = F.col("f1") > 0
    return found.join(grid.select(*keys, "fallback"), keys).select(
        *keys,
        F.when(useful, F.col("threshold")).otherwise(F.col("fallback")).alias("threshold"),
        *[F.when(useful, F.col(c)).otherwise(0.0).alias(c) for c in ("precision", "recall", "f1")],
    )


def midpoint(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Halfway between the mean scores of the two classes."""
    good, bad = (F.avg(F.when(F.col("label") == v, F.col("score"))) for v in (0, 1))
    return scores.groupBy(*keys).agg(
        good.alias("good_mean"), bad.alias("defect_mean"), ((good + bad) / 2.0).alias("threshold")
    )
