"""Decisions on scored rows: rule, severity, explanation, recommendation, vote."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-9
NORMAL = "Normal operation"
MISSING = "Missing value injected"
NO_MODEL = "Model or features not loaded"


def zscore_rule(column: str = "zscore_15", k: float = 3.0) -> Column:
    return F.when(F.abs(F.col(column)) > k, 1).otherwise(0)


def severity(score: Column, threshold: Column) -> Column:
    over = score - threshold
    return (
        F.when(~F.coalesce(score > threshold, F.lit(False)), "none")
        .when(over < 1.0, "low")
        .when(over < 3.0, "medium")
        .otherwise("high")
    )


def recommendation(feature: Column, reason: Column) -> Column:
    """Maintenance hint by name of the leading feature."""
    return (
        F.when(feature.contains("value") | reason.contains("Z-score"), "inspect cooling / thermal sensors")
        .when(
            feature.contains("rate") | feature.contains("diff"),
            "check for sudden mechanical shocks or sensor dropouts",
        )
        .when(feature.contains("RMS") | feature.contains("kurtosis"), "inspect bearing for degradation")
        .otherwise("monitor system")
    )


def top_deviation(stats: list[tuple[str, float, float]]) -> Column:
    """Struct (deviation, place) of the feature farthest from its baseline.

    `stats` is the baseline table of a model: a few dozen (feature, mean, std). A baseline of
    one row has no std, which counts as none; a feature without a mean never deviates.
    Ties go to the feature that comes first in the contract.
    """
    entries = [
        F.struct(
            (F.abs(F.col(name) - F.lit(mean).cast("double")) / F.lit((std or 0.0) + EPS)).alias("deviation"),
            F.lit(-i).alias("place"),
        )
        for i, (name, mean, std) in enumerate(stats)
    ]
    return F.array_max(F.array(*entries))


def explain(df: DataFrame, stats: list[tuple[str, float, float]]) -> DataFrame:
    """Adds feature, deviation, reason (text with the recommendation)."""
    if not stats:
        return df.withColumns(
            {
                "feature": F.lit(None).cast("string"),
                "deviation": F.lit(None).cast("double"),
                "reason": F.lit("No explanation available (feature stats missing)."),
            }
        )
    names, means, _ = zip(*stats)
    top = df.withColumn("_top", top_deviation(stats))
    place = -F.col("_top.place")
    # one lookup by place instead of carrying name, value and mean through 22 structs
    top = top.withColumns(
        {
            "feature": F.get(F.array(*[F.lit(n) for n in names]), place),
            "deviation": F.col("_top.deviation"),
            "_value": F.get(F.array(*[F.col(n) for n in names]), place),
            "_mean": F.get(F.array(*[F.lit(m).cast("double") for m in means]), place),
        }
    )
    text = F.format_string(
        "'%s' is %.1f std devs from baseline (%.3f vs normal %.3f).",
        F.col("feature"),
        F.col("deviation"),
        F.col("_value"),
        F.col("_mean"),
    )
    hint = recommendation(F.col("feature"), text)
    return top.withColumn("reason", F.concat(text, F.lit(" Rec: "), hint, F.lit("."))).drop("_top", "_value", "_mean")


def decide(df: DataFrame, threshold: Column, model: Column, explanation: Column) -> DataFrame:
    """Prediction rows from a `score` column; the fallback rules come first.

    No value: score 0, not anomalous. No score (no model or features): the same
    with another reason.
    """
    missing, unscored = F.col("value").isNull(), F.col("score").isNull()
    usable = ~missing & ~unscored
    anomalous = usable & (F.col("score") > threshold)
    return df.withColumns(
        {
            "anomaly_score": F.when(usable, F.col("score")).otherwise(0.0),
            "is_anomaly": anomalous,
            "severity": F.when(usable, severity(F.col("score"), threshold)).otherwise("none"),
            "reason": F.when(missing, MISSING).when(unscored, NO_MODEL).when(anomalous, explanation).otherwise(NORMAL),
            "model": F.when(usable, model).otherwise("none"),
        }
    ).drop("score")


def ensemble_vote(df: DataFrame, models: dict[str, tuple[str, float]]) -> DataFrame:
    """models: name -> (score column, threshold). A model that gives no score casts no
    vote but still counts; half of the votes are enough."""
    total = len(models)
    flags = {name: F.coalesce(F.col(c) > F.lit(t), F.lit(False)) for name, (c, t) in models.items()}
    votes = sum((flag.cast("int") for flag in flags.values()), F.lit(0))
    share = F.col("votes") / F.lit(total)
    details = F.map_from_entries(
        F.filter(
            F.array(
                *[
                    F.struct(
                        F.lit(name),
                        F.when(
                            F.col(c).isNotNull(),
                            F.struct(F.col(c).alias("score"), F.lit(t).alias("threshold"), flags[name].alias("is_anomaly")),
                        ),
                    )
                    for name, (c, t) in models.items()
                ]
            ),
            lambda e: e["col2"].isNotNull(),
        )
    )
    return df.withColumn("votes", votes).withColumns(
        {
            "total_models": F.lit(total),
            "ensemble_confidence": share,
            "is_anomaly": F.col("votes") >= F.lit(total / 2.0),
            "message": F.format_string(
                "%d of %d agree → anomaly, %.0f%%", F.col("votes"), F.lit(total), share * 100
            ),
            "model_details": details,
        }
    )
