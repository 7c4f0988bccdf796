"""Typed schemas of the engine's tables."""

from __future__ import annotations

from pyspark.sql import types as T

STEP_SECONDS = 300

RAW_SERIES = T.StructType(
    [
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("value", T.DoubleType()),
    ]
)

READING_REQUEST = T.StructType(
    [
        T.StructField("ts", T.TimestampType()),
        T.StructField("sensor_id", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("seq", T.LongType()),
    ]
)

READINGS = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("ts", T.TimestampType()),
        T.StructField("sensor_id", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("anomaly_score", T.DoubleType()),
        T.StructField("is_anomaly", T.BooleanType()),
        T.StructField("severity", T.StringType()),
        T.StructField("reason", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("inference_ms", T.DoubleType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)

ALERTS = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("reading_id", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("sensor_id", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("reason", T.StringType()),
        T.StructField("acknowledged", T.BooleanType()),
        T.StructField("status", T.StringType()),
        T.StructField("operator_note", T.StringType()),
        T.StructField("resolved_at", T.TimestampType()),
        T.StructField("feedback", T.StringType()),
    ]
)

MODEL_RUNS = T.StructType(
    [T.StructField("id", T.LongType(), False), T.StructField("model", T.StringType())]
    + [T.StructField("trained_at", T.TimestampType())]
    + [
        T.StructField(name, T.DoubleType())
        for name in ("precision", "recall", "f1", "pr_auc", "roc_auc", "threshold")
    ]
    + [T.StructField("notes", T.StringType())]
)

ASSETS = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("name", T.StringType()),
        T.StructField("modality", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("last_anomaly_at", T.TimestampType()),
    ]
)

REGISTRY = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("modality", T.StringType()),
        T.StructField("artifact_path", T.StringType()),
        T.StructField("threshold_path", T.StringType()),
        T.StructField("threshold", T.DoubleType()),
        T.StructField("feature_set_hash", T.StringType()),
        T.StructField("test_metrics", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("is_production", T.BooleanType()),
        T.StructField("notes", T.StringType()),
        T.StructField("registered_at", T.TimestampType()),
    ]
)

DRIFT_HISTORY = T.StructType(
    [
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("status", T.StringType()),
        T.StructField("psi", T.DoubleType()),
    ]
)

TABLES = {
    "readings": READINGS,
    "alerts": ALERTS,
    "model_runs": MODEL_RUNS,
    "assets": ASSETS,
    "registry": REGISTRY,
    "drift_history": DRIFT_HISTORY,
}
