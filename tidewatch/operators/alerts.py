"""Alerts and operational views over the readings and alerts tables."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewatch.operators.clean import floor_div
from tidewatch.operators.scan import row_number

STATUSES = ("new", "investigating", "resolved", "false_alarm")
CLOSING = ("resolved", "false_alarm")
CONTEXT = 30
CENTRE = 5
BUCKET = 64
# fixed values: rank of a severity in the alert table
SEVERITY_RANK = {"critical": 4, "high": 3, "medium": 2, "low": 1, "none": 0}


def derive_alerts(readings: DataFrame) -> DataFrame:
    """One alert per anomalous reading. Ids are 1.. in reading order (distributed count)."""
    hits = readings.where("is_anomaly").select(
        F.col("id").alias("reading_id"),
        "ts",
        "sensor_id",
        "severity",
        F.col("anomaly_score").alias("score"),
        "reason",
    )
    numbered = row_number(hits, [], "reading_id", [], "id")
    return numbered.select(
        (F.col("id") + 1).alias("id"),
        *hits.columns,
        F.lit(False).alias("acknowledged"),
        F.lit("new").alias("status"),
        F.lit(None).cast("string").alias("operator_note"),
        F.lit(None).cast("timestamp").alias("resolved_at"),
        F.lit(None).cast("string").alias("feedback"),
    )


def list_alerts(alerts: DataFrame, acknowledged: bool | None = None, limit: int = 50) -> DataFrame:
    rows = alerts if acknowledged is None else alerts.where(F.col("acknowledged") == F.lit(acknowledged))
    return rows.orderBy(F.col("ts").desc(), F.col("id").desc()).limit(limit)


def acknowledge(alerts: DataFrame, acks: DataFrame) -> DataFrame:
    """acks: (alert_id). A new version of the table; unknown ids change nothing."""
    done = acks.select(F.col("alert_id").alias("id"), F.lit(True).alias("_ack")).distinct()
    return (
        alerts.join(done, "id", "left")
        .withColumn("acknowledged", F.coalesce("_ack", "acknowledged"))
        .select(*alerts.columns)
    )


def rejected_updates(updates: DataFrame) -> DataFrame:
    """Updates with a status outside the list."""
    return updates.where(~F.col("status").isin(*STATUSES) | F.col("status").isNull())


def apply_status(alerts: DataFrame, updates: DataFrame) -> DataFrame:
    """updates: (alert_id, status, note, at, seq). The last status wins, the last
    non-empty note wins, the last closing update sets resolved_at."""
    closing = F.col("status").isin(*CLOSING)
    last = (
        updates.where(F.col("status").isin(*STATUSES))
        .groupBy(F.col("alert_id").alias("id"))
        .agg(
            F.max_by("status", "seq").alias("_status"),
            F.max_by("note", F.when(F.col("note").isNotNull(), F.col("seq"))).alias("_note"),
            F.max_by("at", F.when(closing, F.col("seq"))).alias("_at"),
        )
    )
    return (
        alerts.join(last, "id", "left")
        .withColumns(
            {
                "status": F.coalesce("_status", "status"),
                "operator_note": F.coalesce("_note", "operator_note"),
                "resolved_at": F.coalesce("_at", "resolved_at"),
            }
        )
        .select(*alerts.columns)
    )


def apply_feedback(alerts: DataFrame, feedback: DataFrame) -> DataFrame:
    """feedback: (alert_id, feedback, seq); the last one wins."""
    last = feedback.groupBy(F.col("alert_id").alias("id")).agg(F.max_by("feedback", "seq").alias("_feedback"))
    return (
        alerts.join(last, "id", "left")
        .withColumn("feedback", F.coalesce("_feedback", "feedback"))
        .select(*alerts.columns)
    )


def _around(centres: DataFrame, rows: DataFrame, key: list[str], pos: str, context: int, lowest: int) -> DataFrame:
    """rows with centre - context <= pos <= centre + context, as an equi-join on pos buckets.

    centres: (alert_id, *key, centre). At most 2 + 2*context/BUCKET buckets per alert.
    """
    lo = F.greatest(F.col("centre") - context, F.lit(lowest))
    hi = F.col("centre") + context
    wide = centres.withColumns({"_lo": lo, "_hi": hi}).withColumn(
        "_bucket", F.explode(F.sequence(floor_div(F.col("_lo"), BUCKET), floor_div(F.col("_hi"), BUCKET)))
    )
    bucketed = rows.withColumn("_bucket", floor_div(F.col(pos), BUCKET))
    joined = wide.join(bucketed, [*key, "_bucket"])
    return joined.where(F.col(pos).between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi", "_bucket")


def replay(alerts: DataFrame, readings: DataFrame, context: int = CONTEXT) -> DataFrame:
    """The readings whose id lies around the alert's reading, whatever their sensor."""
    centres = alerts.select(F.col("id").alias("alert_id"), F.col("reading_id").alias("centre"))
    return _around(centres, readings, [], "id", context, 1)


def replay_by_sensor(alerts: DataFrame, readings: DataFrame, context: int = CONTEXT) -> DataFrame:
    """The same around the alert's position in its own sensor's series."""
    timed = readings.withColumn("_us", F.unix_micros("ts"))
    placed = row_number(timed, ["sensor_id"], "_us", ["id"], "pos").drop("_us")
    centres = alerts.select(F.col("id").alias("alert_id"), "reading_id").join(
        placed.select(F.col("id").alias("reading_id"), "sensor_id", F.col("pos").alias("centre")), "reading_id"
    )
    return _around(centres.drop("reading_id"), placed, ["sensor_id"], "pos", context, 0)


def incident(alerts: DataFrame, readings: DataFrame) -> DataFrame:
    """Alert header with defaults and the centre rows of its replay.

    A replay holds 61 rows at most, so the window per alert is small.
    """
    context = replay(alerts, readings)
    w = W.partitionBy("alert_id")
    centred = (
        context.withColumns(
            {
                "place": F.row_number().over(w.orderBy("id")) - 1,
                "half": floor_div(F.count("*").over(w), 2),
            }
        )
        .where(F.col("place").between(F.col("half") - CENTRE, F.col("half") + CENTRE))
        .select("alert_id", "place", F.col("id").alias("reading_id"), "ts", "value", "anomaly_score", "is_anomaly")
    )
    header = alerts.select(
        F.col("id").alias("alert_id"),
        F.col("sensor_id").alias("alert_sensor"),
        "severity",
        "score",
        "status",
        F.coalesce("feedback", F.lit("N/A")).alias("feedback"),
        F.coalesce("operator_note", F.lit("N/A")).alias("operator_note"),
    )
    return header.join(centred, "alert_id")


def kpis(readings: DataFrame, runs: DataFrame) -> DataFrame:
    """Totals, anomaly rate, mean latency, and the metrics of the latest model run."""
    n, hits = F.count("*"), F.count_if(F.coalesce("is_anomaly", F.lit(False)))
    totals = readings.agg(
        n.alias("total_readings"),
        hits.alias("total_anomalies"),
        F.bround(hits / F.greatest(n, F.lit(1)) * 100, 2).alias("anomaly_rate"),
        F.bround(F.coalesce(F.avg("inference_ms"), F.lit(0.0)), 3).alias("avg_inference_latency_ms"),
    )
    four = ("precision", "recall", "f1", "pr_auc", "roc_auc")
    newest = runs.agg(F.max_by(F.struct("model", *four, "threshold"), "id").alias("run"))
    return totals.withColumn("run", newest.scalar()).select(
        "total_readings",
        "total_anomalies",
        "anomaly_rate",
        "avg_inference_latency_ms",
        F.col("run.model").alias("latest_model"),
        *[F.bround(f"run.{c}", 4).alias(f"latest_{c}") for c in four],
        F.bround("run.threshold", 6).alias("latest_threshold"),
    )


def stream_rate(readings: DataFrame, now: datetime.datetime | str, seconds: int = 60) -> DataFrame:
    """Readings in the last `seconds` before `now`; a plain range filter on ts."""
    end = F.lit(now).cast("timestamp")
    start = end - F.expr(f"INTERVAL {int(seconds)} SECONDS")
    return readings.where((F.col("ts") >= start) & (F.col("ts") <= end)).agg(F.count("*").alias("stream_rate"))


def latest_readings(readings: DataFrame, limit: int = 60) -> DataFrame:
    """The newest readings in ascending order (top-N, then a sort of N rows)."""
    return readings.orderBy(F.col("ts").desc(), F.col("id").desc()).limit(limit).orderBy("ts", "id")


def data_summary(rows: DataFrame, n_features: int) -> DataFrame:
    n, hits = F.count("*"), F.count_if(F.col("label") == 1)
    return rows.agg(
        n.alias("total_rows"),
        *[F.count_if(F.col("split") == s).alias(f"{s}_rows") for s in ("train", "val", "test")],
        (n - hits).alias("normal"),
        hits.alias("anomaly"),
        F.bround(hits / F.greatest(n, F.lit(1)) * 100, 2).alias("anomaly_rate_pct"),
        F.lit(n_features).alias("feature_count"),
    )


def system_status(readings: DataFrame, threshold: float, now: str, seconds: int = 60) -> DataFrame:
    end = F.lit(now).cast("timestamp")
    start = end - F.expr(f"INTERVAL {int(seconds)} SECONDS")
    return readings.agg(
        F.count("*").alias("total_readings"),
        F.count_if(F.col("ts").between(start, end)).alias("stream_rate"),
        F.bround(F.coalesce(F.avg("inference_ms"), F.lit(0.0)), 3).alias("avg_inference_ms"),
    ).withColumn("threshold", F.lit(round(threshold, 6)))


def asset_list(assets: DataFrame) -> DataFrame:
    return assets.select("id", "name", "modality", "status", "last_anomaly_at").orderBy("id")


def asset_summary(assets: DataFrame, registry: DataFrame, readings: DataFrame, alerts: DataFrame) -> DataFrame:
    """Counts over four tables: independent aggregates, read as scalars."""
    modality = F.coalesce("modality", F.lit("time_series"))
    count = lambda df: df.agg(F.count("*")).scalar()
    models = registry.agg(F.countDistinct(modality).alias("active_modalities"), F.count("*").alias("total_models"))
    return models.select(
        count(assets).alias("total_assets"),
        "active_modalities",
        "total_models",
        count(readings).alias("total_readings_processed"),
        count(alerts).alias("total_anomalies_detected"),
    )


def severity_rank(column: Column) -> Column:
    rank = F.lit(0)
    for name, value in SEVERITY_RANK.items():
        rank = F.when(column == name, value).otherwise(rank)
    return rank


def alert_table(
    alerts: DataFrame,
    severity: str | None = None,
    only_open: bool = True,
    sort: str = "ts",
    ascending: bool = False,
    fetch: int = 200,
) -> DataFrame:
    """Filter and sort of the alert view: ts, severity or score, either direction.

    The view works on the newest `fetch` alerts, as the list operator returns them.
    """
    rows = list_alerts(alerts, limit=fetch).withColumn("severity_rank", severity_rank(F.col("severity")))
    if severity is not None:
        rows = rows.where(F.col("severity") == severity)
    if only_open:
        rows = rows.where(~F.col("acknowledged"))
    key = F.col({"ts": "ts", "severity": "severity_rank", "score": "score"}[sort])
    return rows.orderBy(key.asc() if ascending else key.desc(), "id")


def live_view(readings: DataFrame, size: int = 120) -> DataFrame:
    """Anomaly count and mean score of the newest readings."""
    newest = readings.orderBy(F.col("ts").desc(), F.col("id").desc()).limit(size)
    return newest.agg(
        F.count("*").alias("n"),
        F.count_if("is_anomaly").alias("anomalies"),
        F.avg("anomaly_score").alias("mean_score"),
    )


def clear_alerts(alerts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(empty next version, number of rows that went away)."""
    return alerts.where(F.lit(False)), alerts.agg(F.count("*").alias("deleted"))


def trend(snapshots: DataFrame, size: int = 100) -> DataFrame:
    """The newest snapshots as (index, score, rms) in ascending order."""
    newest = snapshots.select("file_index", "score", "rms").orderBy(F.col("file_index").desc()).limit(size)
    return newest.orderBy("file_index")
