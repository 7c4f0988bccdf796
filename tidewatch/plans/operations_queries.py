"""Registered queries: drift, alerts, operational views, registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import alerts, drift, features, registry, scoring, splits
from tidewatch.plans.base import fragment, labelled, r, rsql, with_ctes
from tidewatch.plans.evaluation_queries import feature_store, stats_list
from tidewatch.plans.store import stored
from tidewatch.sources.series import event_readings, table

QUERIES, ORACLES = {}, {}
LIMIT = 2.0
NOW = "2024-01-30 12:00:00"


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


# ---- drift ------------------------------------------------------------------

fragment(
    "stats",
    "SELECT * FROM ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, avg({c}) AS mean, stddev_samp({c}) AS std, {i} AS ord FROM features "
        "WHERE split = 'train' AND label = 0 AND roll_mean_60 IS NOT NULL"
        for i, c in enumerate(features.FEATURES)
    )
    + ")",
    "features",
)
fragment(
    "long_features",
    " UNION ALL ".join(f"SELECT sensor_id, pos, ts, '{c}' AS feature, {c} AS v FROM features" for c in features.FEATURES),
    "features",
)
fragment(
    "binned",
    """SELECT *, CASE WHEN v IS NULL THEN NULL ELSE least(9, greatest(0, CAST(floor((v - (mean - 3 * std)) / (0.6::DOUBLE * std)) AS INT))) END AS bin
       FROM long_features JOIN stats USING (feature) WHERE v IS NOT NULL""",
    "long_features",
    "stats",
)
EXPECTED = ", ".join(f"({i}, {e!r}::DOUBLE)" for i, e in enumerate(drift.normal_shares()))
fragment("expected", f"SELECT * FROM (VALUES {EXPECTED}) t(bin, share)")


def drift_sql(name: str, source: str, keys: str) -> None:
    fragment(
        name,
        f"""SELECT {keys}, feature, ord, n, psi, shift,
                   CASE WHEN psi >= 0.25 OR abs(shift) >= 3 THEN 'critical' WHEN psi >= 0.1 OR abs(shift) >= 2 THEN 'warning' ELSE 'stable' END AS status
            FROM (SELECT {keys}, feature, any_value(ord) AS ord, any_value(n) AS n, any_value(shift) AS shift,
                         sum((greatest(a, 1e-6) - greatest(share, 1e-6)) * ln(greatest(a, 1e-6) / greatest(share, 1e-6))) AS psi
                  FROM (SELECT t.*, e.share, coalesce(c.m, 0) / t.n::DOUBLE AS a
                        FROM (SELECT {keys}, feature, any_value(ord) AS ord, count(*) AS n,
                                     (avg(v) - any_value(mean)) / (any_value(std) + 1e-9) AS shift FROM {source} GROUP BY {keys}, feature) t
                        CROSS JOIN expected e
                        LEFT JOIN (SELECT {keys}, feature, bin, count(*) AS m FROM {source} GROUP BY {keys}, feature, bin) c
                          USING ({keys}, feature, bin)) GROUP BY {keys}, feature)""",
        source,
        "expected",
    )


fragment(
    "live_binned",
    "SELECT * FROM binned QUALIFY row_number() OVER (PARTITION BY sensor_id, feature ORDER BY pos DESC) <= 500",
    "binned",
)
fragment("daily_binned", "SELECT *, time_bucket(INTERVAL 1 DAY, ts) AS window_start FROM binned", "binned")
drift_sql("live_drift", "live_binned", "sensor_id")
drift_sql("daily_drift", "daily_binned", "window_start, sensor_id")
ROLL_UP = """SELECT {keys}, max(n) AS n_rows,
       CASE WHEN max(n) < 50 THEN 'stable' ELSE CASE max(CASE status WHEN 'critical' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END)
            WHEN 2 THEN 'critical' WHEN 1 THEN 'warning' ELSE 'stable' END END AS status,
       round(CASE WHEN max(n) < 50 THEN 0 ELSE greatest(max(psi), 0) END, 6) + 0.0::DOUBLE AS psi,
       round(CASE WHEN max(n) < 50 THEN 0 ELSE arg_max(shift, abs(shift)) END, 6) + 0.0::DOUBLE AS mean_shift_sigma,
       CASE WHEN max(n) < 50 THEN '' ELSE coalesce(string_agg(feature, ',' ORDER BY ord) FILTER (status <> 'stable'), '') END AS affected_features,
       CASE WHEN max(n) < 50 THEN 'Waiting for more data' ELSE CASE max(CASE status WHEN 'critical' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END)
            WHEN 2 THEN 'Retraining recommended' WHEN 1 THEN 'Monitor' ELSE 'No action' END END AS recommendation
       FROM {source} GROUP BY {keys}"""


def flat_status(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(
        *keys,
        "n_rows",
        "status",
        r("psi").alias("psi"),
        r("mean_shift_sigma").alias("mean_shift_sigma"),
        F.array_join("affected_features", ",").alias("affected_features"),
        "recommendation",
    )


@query(
    "drift_histogram",
    with_ctes(["binned"], "SELECT sensor_id, feature, bin, count(*) AS n FROM binned GROUP BY 1, 2, 3"),
)
def drift_histogram(spark, sf):
    return drift.histogram(feature_store(spark, sf), ["sensor_id"], stats_list(spark, sf))


@query(
    "drift_features_live",
    with_ctes(["live_drift"], f"SELECT sensor_id, feature, n, {rsql('psi', 'psi')}, {rsql('shift', 'shift')}, status FROM live_drift"),
)
def drift_live(spark, sf):
    live = drift.live_window(feature_store(spark, sf), ["sensor_id"], [F.col("pos")])
    out = drift.feature_drift(live, ["sensor_id"], stats_list(spark, sf))
    return out.select("sensor_id", "feature", "n", r("psi").alias("psi"), r("shift").alias("shift"), "status")


@query("drift_check", with_ctes(["live_drift"], ROLL_UP.format(keys="sensor_id", source="live_drift")))
def drift_check(spark, sf):
    out = drift.check(feature_store(spark, sf), ["sensor_id"], stats_list(spark, sf), [F.col("pos")])
    return flat_status(out, ["sensor_id"])


_psi = " + ".join(
    f"(greatest(b{k} / n::DOUBLE, 1e-6) - greatest({e!r}::DOUBLE, 1e-6)) * ln(greatest(b{k} / n::DOUBLE, 1e-6) / greatest({e!r}::DOUBLE, 1e-6))"
    for k, e in enumerate(drift.normal_shares())
)
fragment(
    "moving_drift",
    f"""SELECT sensor_id, pos, feature, ord, n, psi, shift,
               CASE WHEN psi >= 0.25 OR abs(shift) >= 3 THEN 'critical' WHEN psi >= 0.1 OR abs(shift) >= 2 THEN 'warning' ELSE 'stable' END AS status
        FROM (SELECT *, {_psi} AS psi FROM (
          SELECT sensor_id, pos, feature, ord, count(*) OVER w AS n, (avg(v - mean) OVER w) / (std + 1e-9) AS shift,
                 {", ".join(f"sum(CASE WHEN bin = {k} THEN 1 ELSE 0 END) OVER w AS b{k}" for k in range(drift.BINS))}
          FROM binned WINDOW w AS (PARTITION BY sensor_id, feature ORDER BY pos RANGE BETWEEN 499 PRECEDING AND CURRENT ROW)))""",
    "binned",
)


@query("drift_at_every_reading", with_ctes(["moving_drift"], ROLL_UP.format(keys="sensor_id, pos", source="moving_drift")))
def drift_moving(spark, sf):
    """What a check after every reading would have said, per sensor."""
    rows = feature_store(spark, sf).where("pos >= 0")
    return flat_status(drift.at_every_reading(rows, stats_list(spark, sf)), ["sensor_id", "pos"])


fragment(
    "all_binned",
    """SELECT 'all' AS scope, * FROM binned
       QUALIFY row_number() OVER (PARTITION BY feature ORDER BY ts DESC, sensor_id DESC) <= 500""",
    "binned",
)
drift_sql("all_drift", "all_binned", "scope")


@query("drift_check_all_sensors", with_ctes(["all_drift"], ROLL_UP.format(keys="scope", source="all_drift")))
def drift_all(spark, sf):
    order = [F.col("ts"), F.col("sensor_id")]
    return flat_status(drift.check(feature_store(spark, sf), [], stats_list(spark, sf), order), ["scope"])


@query(
    "drift_over_time",
    with_ctes(
        ["daily_drift"],
        f"SELECT window_start, sensor_id, feature, n, {rsql('psi', 'psi')}, {rsql('shift', 'shift')}, status FROM daily_drift",
    ),
)
def drift_daily(spark, sf):
    out = drift.over_time(feature_store(spark, sf), stats_list(spark, sf))
    return out.select("window_start", "sensor_id", "feature", "n", r("psi").alias("psi"), r("shift").alias("shift"), "status")


fragment("daily_status", ROLL_UP.format(keys="window_start, sensor_id", source="daily_drift"), "daily_drift")


def daily_status(spark: SparkSession, sf: str) -> DataFrame:
    keys = ["window_start", "sensor_id"]
    return drift.roll_up(drift.over_time(feature_store(spark, sf), stats_list(spark, sf)), keys)


@query(
    "drift_history",
    with_ctes(
        ["daily_status"],
        """SELECT window_start AS timestamp, sensor_id, status, psi FROM daily_status
           ORDER BY window_start DESC, sensor_id DESC LIMIT 100""",
    ),
)
def drift_history(spark, sf):
    rows = daily_status(spark, sf).select(
        F.col("window_start").alias("timestamp"), "sensor_id", "status", r("psi").alias("psi")
    )
    return drift.append_history(rows.where(F.lit(False)), rows, ["sensor_id"])


@query(
    "drift_latest_status",
    with_ctes(
        ["daily_status"],
        "SELECT window_start AS timestamp, status, psi FROM daily_status ORDER BY window_start DESC, sensor_id DESC LIMIT 1",
    ),
)
def drift_latest(spark, sf):
    rows = daily_status(spark, sf).select(F.col("window_start").alias("timestamp"), "sensor_id", "status", "psi")
    return drift.latest_status(rows, ["sensor_id"]).withColumn("psi", r("psi"))


# ---- readings and alerts ------------------------------------------------------


def scored_readings(spark: SparkSession, sf: str) -> DataFrame:
    """Every event as a stored reading, scored by its distance from the sensor's mean."""
    latency = F.get_json_object("props", "$.k").cast("double") / 10.0
    rows = event_readings(spark, sf, extra=(latency.alias("inference_ms"),))
    moments = rows.groupBy("sensor_id").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    scored = rows.join(moments, "sensor_id").withColumn(
        # a constant sensor has no spread: no score, which the fallback rules handle
        "score", F.round(F.abs(F.col("value") - F.col("mean")) / F.nullif(F.col("std"), F.lit(0.0)), 6)
    )
    decided = scoring.decide(scored, F.lit(LIMIT), F.lit("zscore"), F.lit("far from the mean"))
    return decided.select(
        (F.col("seq") + 1).alias("id"), "ts", "sensor_id", "value", "anomaly_score", "is_anomaly", "severity",
        "reason", "model", "inference_ms", F.col("ts").alias("created_at"),
    )


def readings_table(spark: SparkSession, sf: str) -> DataFrame:
    return stored(spark, sf, "readings", lambda: scored_readings(spark, sf))


def alerts_table(spark: SparkSession, sf: str) -> DataFrame:
    return stored(spark, sf, "alerts", lambda: alerts.derive_alerts(readings_table(spark, sf)))


fragment(
    "stored_readings",
    """SELECT event_id + 1 AS id, ts, event_type AS sensor_id, value, score AS anomaly_score, score > 2.0 AS is_anomaly,
              CASE WHEN NOT score > 2.0 THEN 'none' WHEN score - 2.0 < 1 THEN 'low' WHEN score - 2.0 < 3 THEN 'medium' ELSE 'high' END AS severity,
              CASE WHEN score > 2.0 THEN 'far from the mean' ELSE 'Normal operation' END AS reason, 'zscore' AS model,
              CAST(json_extract_string(props, '$.k') AS DOUBLE) / 10.0::DOUBLE AS inference_ms, ts AS created_at
       FROM (SELECT *, round(abs(value - avg(value) OVER s) / stddev_pop(value) OVER s, 6) AS score FROM events
             WINDOW s AS (PARTITION BY event_type))""",
)
fragment(
    "stored_alerts",
    """SELECT row_number() OVER (ORDER BY id) AS id, id AS reading_id, ts, sensor_id, severity, anomaly_score AS score, reason,
              false AS acknowledged, 'new' AS status, NULL::VARCHAR AS operator_note, NULL::TIMESTAMP AS resolved_at, NULL::VARCHAR AS feedback
       FROM stored_readings WHERE is_anomaly""",
    "stored_readings",
)


def updates_log(spark: SparkSession, sf: str) -> DataFrame:
    """Operator actions derived from the events: which alert, which status, when."""
    k = F.get_json_object("props", "$.k").cast("int")
    status = F.element_at(F.array(*[F.lit(s) for s in (*alerts.STATUSES, "paused")]), k % 5 + 1)
    return table(spark, sf, "events").select(
        (F.col("user_id") + 1).alias("alert_id"),
        status.alias("status"),
        F.when(k % 3 == 0, F.concat(F.lit("note "), k.cast("string"))).alias("note"),
        F.element_at(F.array(F.lit("true_anomaly"), F.lit("false_alarm"), F.lit("unsure")), k % 3 + 1).alias("feedback"),
        F.col("ts").cast("timestamp").alias("at"),
        F.col("event_id").alias("seq"),
    )


fragment(
    "updates",
    """SELECT user_id + 1 AS alert_id, CASE k % 5 WHEN 0 THEN 'new' WHEN 1 THEN 'investigating' WHEN 2 THEN 'resolved'
              WHEN 3 THEN 'false_alarm' ELSE 'paused' END AS status, CASE WHEN k % 3 = 0 THEN 'note ' || k END AS note,
              CASE k % 3 WHEN 0 THEN 'true_anomaly' WHEN 1 THEN 'false_alarm' ELSE 'unsure' END AS feedback, ts AS happened, event_id AS seq
       FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)""",
)
ALERT_COLUMNS = "id, reading_id, ts, sensor_id, severity, score, reason, acknowledged, status, operator_note, resolved_at, feedback"


@query(
    "readings_table",
    with_ctes(["stored_readings"], "SELECT * FROM stored_readings"),
)
def readings(spark, sf):
    return readings_table(spark, sf)


@query("derive_alerts", with_ctes(["stored_alerts"], f"SELECT {ALERT_COLUMNS} FROM stored_alerts"))
def derived(spark, sf):
    return alerts_table(spark, sf)


@query("list_alerts", with_ctes(["stored_alerts"], f"SELECT {ALERT_COLUMNS} FROM stored_alerts ORDER BY ts DESC, id DESC LIMIT 50"))
def listed(spark, sf):
    return alerts.list_alerts(alerts_table(spark, sf), acknowledged=False)


@query(
    "acknowledge_alerts",
    with_ctes(["stored_alerts", "updates"], "SELECT id, id IN (SELECT alert_id FROM updates WHERE status = 'resolved') AS acknowledged FROM stored_alerts"),
)
def acknowledged(spark, sf):
    done = updates_log(spark, sf).where(F.col("status") == "resolved")
    return alerts.acknowledge(alerts_table(spark, sf), done).select("id", "acknowledged")


@query(
    "update_alert_status",
    with_ctes(
        ["stored_alerts", "updates"],
        """SELECT a.id, coalesce(u.status, a.status) AS status, u.note AS operator_note, u.closed AS resolved_at
           FROM stored_alerts a LEFT JOIN (
             SELECT alert_id, arg_max(status, seq) AS status, arg_max(note, seq) FILTER (note IS NOT NULL) AS note,
                    arg_max(happened, seq) FILTER (status IN ('resolved', 'false_alarm')) AS closed
             FROM updates WHERE status <> 'paused' GROUP BY 1) u ON u.alert_id = a.id""",
    ),
)
def status_updated(spark, sf):
    out = alerts.apply_status(alerts_table(spark, sf), updates_log(spark, sf))
    return out.select("id", "status", "operator_note", "resolved_at")


@query("rejected_updates", with_ctes(["updates"], "SELECT alert_id, status, seq FROM updates WHERE status = 'paused'"))
def rejected(spark, sf):
    return alerts.rejected_updates(updates_log(spark, sf)).select("alert_id", "status", "seq")


@query(
    "alert_feedback",
    with_ctes(
        ["stored_alerts", "updates"],
        """SELECT a.id, u.feedback FROM stored_alerts a
           LEFT JOIN (SELECT alert_id, arg_max(feedback, seq) AS feedback FROM updates GROUP BY 1) u ON u.alert_id = a.id""",
    ),
)
def feedback(spark, sf):
    return alerts.apply_feedback(alerts_table(spark, sf), updates_log(spark, sf)).select("id", "feedback")


@query(
    "replay_alerts",
    with_ctes(
        ["stored_alerts"],
        """SELECT a.id AS alert_id, r.id, r.ts, r.sensor_id, r.value, r.anomaly_score
           FROM stored_alerts a JOIN stored_readings r ON r.id BETWEEN greatest(1, a.reading_id - 30) AND a.reading_id + 30""",
    ),
)
def replayed(spark, sf):
    out = alerts.replay(alerts_table(spark, sf), readings_table(spark, sf))
    return out.select("alert_id", "id", "ts", "sensor_id", "value", "anomaly_score")


@query(
    "replay_alerts_by_sensor",
    with_ctes(
        ["stored_alerts"],
        """, placed AS (SELECT *, row_number() OVER (PARTITION BY sensor_id ORDER BY ts, id) - 1 AS pos FROM stored_readings)
        SELECT a.id AS alert_id, r.id, r.sensor_id, r.pos FROM stored_alerts a JOIN placed c ON c.id = a.reading_id
        JOIN placed r ON r.sensor_id = c.sensor_id AND r.pos BETWEEN c.pos - 30 AND c.pos + 30""",
    ),
)
def replayed_by_sensor(spark, sf):
    out = alerts.replay_by_sensor(alerts_table(spark, sf), readings_table(spark, sf))
    return out.select("alert_id", "id", "sensor_id", "pos")


@query(
    "incident_report",
    with_ctes(
        ["stored_alerts"],
        """SELECT a.id AS alert_id, a.sensor_id AS alert_sensor, a.severity, a.score, a.status, 'N/A' AS feedback, 'N/A' AS operator_note,
                  c.place, c.id AS reading_id, c.ts, c.value, c.anomaly_score, c.is_anomaly
           FROM stored_alerts a JOIN (
             SELECT a.id AS alert_id, r.*, row_number() OVER (PARTITION BY a.id ORDER BY r.id) - 1 AS place,
                    count(*) OVER (PARTITION BY a.id) // 2 AS half
             FROM stored_alerts a JOIN stored_readings r ON r.id BETWEEN greatest(1, a.reading_id - 30) AND a.reading_id + 30) c
           ON c.alert_id = a.id AND c.place BETWEEN c.half - 5 AND c.half + 5""",
    ),
)
def incidents(spark, sf):
    return alerts.incident(alerts_table(spark, sf), readings_table(spark, sf))


def model_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as training runs: one run per order, metrics from its total."""
    share = (F.col("o_totalprice") % 1000) / 1000.0
    names = ("precision", "recall", "f1", "pr_auc", "roc_auc", "threshold")
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderpriority").alias("model"),
        F.col("o_orderdate").cast("timestamp").alias("trained_at"),
        *[F.round(share / (i + 1), 6).alias(n) for i, n in enumerate(names)],
    )


@query(
    "kpis",
    with_ctes(
        ["stored_readings"],
        """, run AS (SELECT o_orderpriority AS model, (o_totalprice % 1000) / 1000.0::DOUBLE AS s FROM orders ORDER BY o_orderkey DESC LIMIT 1)
        SELECT count(*) AS total_readings, count(*) FILTER (is_anomaly) AS total_anomalies,
               round(count(*) FILTER (is_anomaly) / count(*)::DOUBLE * 100, 2) AS anomaly_rate,
               round(avg(inference_ms), 3) AS avg_inference_latency_ms, any_value(model_) AS latest_model,
               any_value(round(round(s, 6), 4)) AS latest_precision, any_value(round(round(s / 2, 6), 4)) AS latest_recall,
               any_value(round(round(s / 3, 6), 4)) AS latest_f1, any_value(round(round(s / 4, 6), 4)) AS latest_pr_auc,
               any_value(round(round(s / 5, 6), 4)) AS latest_roc_auc, any_value(round(s / 6, 6)) AS latest_threshold
        FROM stored_readings CROSS JOIN (SELECT model AS model_, s FROM run)""",
    ),
)
def kpi_row(spark, sf):
    return alerts.kpis(readings_table(spark, sf), model_runs(spark, sf))


@query("stream_rate", f"SELECT count(*) AS stream_rate FROM events WHERE ts BETWEEN TIMESTAMP '{NOW}' - INTERVAL 1 DAY AND TIMESTAMP '{NOW}'")
def rate(spark, sf):
    return alerts.stream_rate(readings_table(spark, sf), NOW, 86400)


@query(
    "latest_readings",
    with_ctes(["stored_readings"], "SELECT * FROM (SELECT id, ts, sensor_id, value, anomaly_score FROM stored_readings ORDER BY ts DESC, id DESC LIMIT 60) ORDER BY ts, id"),
)
def latest(spark, sf):
    return alerts.latest_readings(readings_table(spark, sf)).select("id", "ts", "sensor_id", "value", "anomaly_score")


@query(
    "data_summary",
    with_ctes(
        ["labelled"],
        """SELECT count(*) AS total_rows, count(*) FILTER (split = 'train') AS train_rows, count(*) FILTER (split = 'val') AS val_rows,
                  count(*) FILTER (split = 'test') AS test_rows, count(*) FILTER (label = 0) AS normal, count(*) FILTER (label = 1) AS anomaly,
                  round(count(*) FILTER (label = 1) / count(*)::DOUBLE * 100, 2) AS anomaly_rate_pct, 22 AS feature_count FROM labelled""",
    ),
)
def summary(spark, sf):
    return alerts.data_summary(labelled(spark, sf), len(features.FEATURES))


@query(
    "system_status",
    with_ctes(
        ["stored_readings"],
        f"""SELECT count(*) AS total_readings, count(*) FILTER (ts BETWEEN TIMESTAMP '{NOW}' - INTERVAL 1 DAY AND TIMESTAMP '{NOW}') AS stream_rate,
                  round(avg(inference_ms), 3) AS avg_inference_ms, 2.0::DOUBLE AS threshold FROM stored_readings""",
    ),
)
def status(spark, sf):
    return alerts.system_status(readings_table(spark, sf), LIMIT, NOW, 86400)


MODALITIES = ("time_series", "vibration", "image")


def asset_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as assets, placed in their nation; every fourth has no modality on record."""
    which = F.col("s_nationkey") % 4
    nation = table(spark, sf, "nation").select("n_nationkey", "n_name")
    return (
        table(spark, sf, "supplier")
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("s_name").alias("id"),
            F.concat_ws(" ", "n_name", "s_name").alias("name"),
            F.element_at(F.array(*[F.lit(m) for m in MODALITIES], F.lit(None).cast("string")), which + 1).alias("modality"),
            F.when(F.col("s_acctbal") < 0, "inactive").otherwise("active").alias("status"),
            F.lit(None).cast("timestamp").alias("last_anomaly_at"),
        )
    )


fragment(
    "assets",
    """SELECT s_name AS id, n_name || ' ' || s_name AS name, CASE s_nationkey % 4 WHEN 0 THEN 'time_series' WHEN 1 THEN 'vibration'
              WHEN 2 THEN 'image' END AS modality, CASE WHEN s_acctbal < 0 THEN 'inactive' ELSE 'active' END AS status,
              NULL::TIMESTAMP AS last_anomaly_at FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
)


@query("asset_list", with_ctes(["assets"], "SELECT * FROM assets ORDER BY id"))
def assets_listed(spark, sf):
    return alerts.asset_list(asset_rows(spark, sf))


# ---- registry -------------------------------------------------------------------


def registrations(spark: SparkSession, sf: str) -> DataFrame:
    """Events as registrations of fifty models: many versions of each name."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf, "events").select(
        F.concat_ws("_", "event_type", (k % 10).cast("string")).alias("name"),
        F.element_at(F.array(*[F.lit(m) for m in MODALITIES], F.lit(None).cast("string")), k % 4 + 1).alias("modality"),
        F.when(k % 7 > 0, F.concat(F.lit("models/"), F.col("event_type"), F.lit(".bin"))).alias("artifact_path"),
        F.col("value").alias("threshold"),
        F.when(k % 2 == 0, F.create_map(F.lit("threshold"), F.col("value") / 2)).alias("metrics"),
        (F.col("event_id") % 3 == 0).alias("is_production"),
        F.col("ts").cast("timestamp").alias("registered_at"),
        F.col("event_id").alias("seq"),
    )


def registry_table(spark: SparkSession, sf: str) -> DataFrame:
    rows = registrations(spark, sf)
    return registry.upsert(rows.where(F.lit(False)), rows)


fragment(
    "registry",
    """SELECT name, modality, artifact_path, threshold, metrics_threshold, is_production, registered_at, seq FROM (
         SELECT event_type || '_' || (k % 10) AS name, CASE k % 4 WHEN 0 THEN 'time_series' WHEN 1 THEN 'vibration' WHEN 2 THEN 'image' END AS modality,
                CASE WHEN k % 7 > 0 THEN 'models/' || event_type || '.bin' END AS artifact_path, value AS threshold,
                CASE WHEN k % 2 = 0 THEN value / 2 END AS metrics_threshold, event_id % 3 = 0 AS is_production, ts AS registered_at, event_id AS seq
         FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events))
       QUALIFY row_number() OVER (PARTITION BY name ORDER BY registered_at DESC, seq DESC) = 1""",
)
REGISTRY_COLUMNS = "name, modality, artifact_path, threshold, is_production, registered_at"


@query("registry_upsert", with_ctes(["registry"], f"SELECT {REGISTRY_COLUMNS} FROM registry"))
def registered(spark, sf):
    return registry_table(spark, sf).select(*REGISTRY_COLUMNS.split(", "))


@query("registry_get", with_ctes(["registry"], f"SELECT {REGISTRY_COLUMNS} FROM registry WHERE name = 'click_3'"))
def registry_entry(spark, sf):
    return registry.get(registry_table(spark, sf), "click_3").select(*REGISTRY_COLUMNS.split(", "))


@query("registry_set_production", with_ctes(["registry"], "SELECT name, name = 'click_3' AS is_production FROM registry"))
def produced(spark, sf):
    return registry.set_production(registry_table(spark, sf), "click_3").select("name", "is_production")


@query("registry_set_unknown", with_ctes(["registry"], "SELECT name, is_production FROM registry"))
def produced_unknown(spark, sf):
    return registry.set_production(registry_table(spark, sf), "no such model").select("name", "is_production")


@query(
    "select_model",
    with_ctes(
        ["registry"],
        """SELECT name, CASE WHEN artifact_path IS NOT NULL THEN coalesce(metrics_threshold, threshold) END AS threshold,
                  CASE WHEN artifact_path IS NULL THEN 'refused: no artifact' ELSE 'ok' END AS outcome FROM registry""",
    ),
)
def selected(spark, sf):
    return registry.select_model(registry_table(spark, sf))


@query(
    "append_experiments",
    """WITH e AS (SELECT o_orderkey, o_orderpriority AS model, o_orderdate AS created_at, o_orderstatus FROM orders)
       SELECT model, created_at, row_number() OVER (ORDER BY o_orderkey) AS id FROM e WHERE o_orderstatus = 'F'
       UNION ALL
       SELECT model, created_at, row_number() OVER (ORDER BY created_at, o_orderkey) + (SELECT count(*) FROM e WHERE o_orderstatus = 'F') AS id
       FROM e WHERE o_orderstatus <> 'F'""",
)
def experiments(spark, sf):
    """Finished orders are the existing log, the others are appended in time order."""
    from tidewatch.operators.scan import row_number

    rows = table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_orderpriority").alias("model"), F.col("o_orderdate").cast("timestamp").alias("created_at"), "o_orderstatus"
    )
    done = F.col("o_orderstatus") == "F"
    old = row_number(rows.where(done), [], "o_orderkey", [], "id").withColumn("id", F.col("id") + 1)
    return registry.append_experiments(old, rows.where(~done), ties=("o_orderkey",)).select("model", "created_at", "id")


@query(
    "asset_summary",
    with_ctes(
        ["assets", "registry", "stored_alerts"],
        """SELECT (SELECT count(*) FROM assets) AS total_assets, (SELECT count(DISTINCT coalesce(modality, 'time_series')) FROM registry) AS active_modalities,
                  (SELECT count(*) FROM registry) AS total_models, (SELECT count(*) FROM stored_readings) AS total_readings_processed,
                  (SELECT count(*) FROM stored_alerts) AS total_anomalies_detected""",
    ),
)
def assets_summed(spark, sf):
    return alerts.asset_summary(
        asset_rows(spark, sf), registry_table(spark, sf), readings_table(spark, sf), alerts_table(spark, sf)
    )


@query(
    "alert_table_by_severity",
    with_ctes(
        ["stored_alerts"],
        """SELECT id, ts, severity, CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END AS severity_rank, score
           FROM (SELECT * FROM stored_alerts ORDER BY ts DESC, id DESC LIMIT 200) ORDER BY severity_rank DESC, id""",
    ),
)
def alerts_by_severity(spark, sf):
    out = alerts.alert_table(alerts_table(spark, sf), sort="severity")
    return out.select("id", "ts", "severity", "severity_rank", "score")


@query(
    "alert_table_medium_by_score",
    with_ctes(
        ["stored_alerts"],
        """SELECT id, severity, score FROM (SELECT * FROM stored_alerts ORDER BY ts DESC, id DESC LIMIT 200)
           WHERE severity = 'medium' ORDER BY score, id""",
    ),
)
def alerts_by_score(spark, sf):
    out = alerts.alert_table(alerts_table(spark, sf), severity="medium", sort="score", ascending=True)
    return out.select("id", "severity", "score")


@query(
    "live_view",
    with_ctes(
        ["stored_readings"],
        """SELECT count(*) AS n, count(*) FILTER (is_anomaly) AS anomalies, round(avg(anomaly_score), 6) + 0.0::DOUBLE AS mean_score
           FROM (SELECT * FROM stored_readings ORDER BY ts DESC, id DESC LIMIT 120)""",
    ),
)
def live(spark, sf):
    return alerts.live_view(readings_table(spark, sf)).withColumn("mean_score", r("mean_score"))


@query("clear_alerts", with_ctes(["stored_alerts"], "SELECT count(*) AS deleted FROM stored_alerts"))
def cleared(spark, sf):
    return alerts.clear_alerts(alerts_table(spark, sf))[1]


@query(
    "retraining_extract",
    with_ctes(
        ["stored_readings"],
        """SELECT id, pos, label, CASE WHEN pos > 8000 THEN 'test' ELSE 'train' END AS split,
                  CASE WHEN pos < floor(n * 0.70::DOUBLE) THEN 'train' WHEN pos < floor(n * 0.85::DOUBLE) THEN 'val' ELSE 'test' END AS split3
           FROM (SELECT id, is_anomaly::INT AS label, row_number() OVER (ORDER BY id) - 1 AS pos, count(*) OVER () AS n
                 FROM (SELECT * FROM stored_readings ORDER BY id DESC LIMIT 10000))""",
    ),
)
def extract(spark, sf):
    return splits.retraining_extract(readings_table(spark, sf)).select("id", "pos", "label", "split", "split3")


@query(
    "replay_start",
    with_ctes(
        ["labelled"],
        """, w AS (SELECT sensor_id, min(pos) AS s, row_number() OVER (PARTITION BY sensor_id ORDER BY min(pos)) AS nth
               FROM (SELECT *, pos - row_number() OVER (PARTITION BY sensor_id ORDER BY pos) AS g FROM labelled WHERE label = 1) GROUP BY sensor_id, g)
        SELECT l.sensor_id, l.pos, l.ts FROM labelled l JOIN w ON w.sensor_id = l.sensor_id AND w.nth = 2 AND l.pos >= greatest(0, w.s - 50)""",
    ),
)
def replay_slice(spark, sf):
    """The stream from 50 rows before the second anomaly run of each sensor."""
    from tidewatch.operators.faults import replay_from_anomaly

    return replay_from_anomaly(labelled(spark, sf), nth=2).select("sensor_id", "pos", "ts")


