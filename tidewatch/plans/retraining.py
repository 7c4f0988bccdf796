"""Retraining as one Spark job: extract, features, fit, evaluate, promote."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewatch.operators import evaluate, features, registry, splits, thresholds
from tidewatch.operators.clean import drop_incomplete
from tidewatch.operators.detectors import envelope, isolation, store
from tidewatch.operators.detectors.base import Model
from tidewatch.session import materialize

BASELINE_MODEL = registry.BASELINE


def training_rows(readings: DataFrame, size: int = 10000) -> DataFrame:
    """The newest readings with contract features and a three-way split per sensor.

    The extract is `size` rows whatever the table holds, so windows over it are small.
    """
    newest = splits.retraining_extract(readings, size).where(F.col("value").isNotNull())
    own = W.partitionBy("sensor_id")
    rows = newest.select("id", "sensor_id", "ts", "value", "label").withColumns(
        {
            "pos": (F.row_number().over(own.orderBy("id")) - 1).cast("bigint"),
            "n_rows": F.count("*").over(own),
            "first_pos": F.lit(0).cast("bigint"),
        }
    )
    split = splits.chronological_split(rows)
    scaled = splits.apply_scaler(split, splits.fit_scaler(splits.normal_rows(split)))
    return drop_incomplete(features.rolling_features(scaled), features.FEATURES)


def fit_candidates(rows: DataFrame, trees: int = 200) -> dict[str, Model]:
    """The candidates that could be fitted, by name."""
    train = splits.normal_rows(rows)
    forest = isolation.fit(train, features.FEATURES, ["id"], trees=trees)
    models = {"isolation_forest": forest, "elliptic_envelope": envelope.fit(train, features.FEATURES, ["id"])}
    return {name: model for name, model in models.items() if model is not None}


def score_candidates(rows: DataFrame, models: dict[str, Model]) -> DataFrame:
    """Long scores (model, ...) of every candidate and the baseline on validation and test rows."""
    held = rows.where(F.col("split") != "train")
    columns = ["sensor_id", "pos", "split", "label"]
    long = held.select(F.lit(BASELINE_MODEL).alias("model"), *columns, F.abs("zscore_15").alias("score"))
    for name, model in models.items():
        long = long.unionByName(model.transform(held).select(F.lit(name).alias("model"), *columns, "score"))
    return long


def retrain(
    readings: DataFrame, models: DataFrame, size: int = 10000, trees: int = 200, root: str | None = None
) -> tuple[DataFrame, DataFrame, dict[str, str]]:
    """(ranked evaluation, next registry version, artifacts by model name).

    Thresholds come from the validation rows, ranks from the test rows; the best
    model that may serve (not the baseline) becomes the production model. With a
    `root` the fitted models are written below it and the registry names their paths.
    """
    spark = readings.sparkSession
    rows = materialize(training_rows(readings, size), "retrain-rows")
    fitted = fit_candidates(rows, trees)
    scores = materialize(score_candidates(rows, fitted), "retrain-scores")
    limits = thresholds.best_linear(scores.where("split = 'val'"), ["model"]).select("model", "threshold")
    test = scores.where("split = 'test'").join(limits, "model")
    preds = test.withColumn("pred", (F.col("score") > F.col("threshold")).cast("int"))
    ranked = evaluate.rank_models(evaluate.evaluation(preds)).join(limits, "model")
    ranked = materialize(ranked, "retrain-ranked")
    best = ranked.where(F.col("model") != BASELINE_MODEL).orderBy("rank").select("model").first()
    artifacts = {name: store.save(model, spark, f"{root}/{name}") for name, model in fitted.items()} if root else {}
    for name, path in artifacts.items():
        models = models.withColumn(
            "artifact_path", F.when(F.col("name") == name, F.lit(path)).otherwise(F.col("artifact_path"))
        )
    return ranked, registry.set_production(models, best["model"]) if best else models, artifacts
