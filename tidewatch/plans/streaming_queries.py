"""Registered streaming queries: each runs over the whole table in micro-batches and
must equal its batch twin."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.operators import drift as drift_rules
from tidewatch.operators import features, splits
from tidewatch.operators.detectors import halfspace, isolation, store
from tidewatch.operators.thresholds import best_linear
from tidewatch.plans.base import DEPENDS, FRAGMENTS, fragment, labelled, r, rsql, scaled, with_ctes
from tidewatch.plans.detector_queries import ROW, complete
from tidewatch.plans.evaluation_queries import feature_store, predicted, stats_list
from tidewatch.plans.operations_queries import ROLL_UP, alerts_table, drift_sql, flat_status, readings_table
from tidewatch.plans.series_queries import FEATURE_SQL
from tidewatch.plans.store import stored
from tidewatch.session import pin, scratch_path
from tidewatch.streaming import buffer, chunked, drift, eventtime, replay, runs, scoring, serving, sources, trees

QUERIES, ORACLES = {}, {}
# fixed value: the event history arrives in two deliveries, cut here
DELIVERY_CUT = "2024-01-16 00:00:00"
STREAM_SCHEMA = T.StructType(
    [
        T.StructField("sensor_id", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("seq", T.LongType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("value_scaled", T.DoubleType()),
    ]
)


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def grid_rows(spark: SparkSession, sf: str) -> DataFrame:
    return scaled(spark, sf).select("sensor_id", "ts", F.col("pos").alias("seq"), "value", "value_scaled")


def deliver(rows: DataFrame, path: str, cut: str = DELIVERY_CUT):
    """Append the rows to `path` in two deliveries; yields after each."""
    cut = F.lit(cut).cast("timestamp")
    for inside in (F.col("ts") < cut, F.col("ts") >= cut):
        rows.where(inside).write.mode("append").parquet(path)
        yield


def run_deliveries(spark: SparkSession, rows: DataFrame, build, sink, cut: str = DELIVERY_CUT) -> None:
    """One streaming query, stopped and restarted from its checkpoint between deliveries."""
    sources.use_rocksdb(spark)
    inbox, checkpoint = scratch_path(spark, "inbox"), scratch_path(spark, "stream")
    for _ in deliver(rows, inbox, cut):
        stream = sources.reading_stream(spark, inbox, rows.schema)
        scoring.run_available(build(stream), checkpoint, sink)


@query(
    "stream_online_features",
    with_ctes(["online_features"], f"SELECT sensor_id, pos, false AS late, {FEATURE_SQL} FROM online_features"),
)
def stream_features(spark, sf):
    """Equal to the batch online features, although the state crosses a restart."""
    out = scratch_path(spark, "stream-features")
    run_deliveries(spark, grid_rows(spark, sf), buffer.online_features, out)
    rows = spark.read.schema(buffer.OUTPUT).parquet(out)
    return rows.select("sensor_id", F.col("seq").alias("pos"), "late", *[r(c).alias(c) for c in features.FEATURES])


@query(
    "stream_warm_start",
    with_ctes(
        ["online_features", "labelled"],
        f"""SELECT sensor_id, pos, {FEATURE_SQL} FROM online_features o
            SEMI JOIN (SELECT sensor_id, pos FROM labelled WHERE split = 'test') t USING (sensor_id, pos)""",
    ),
)
def stream_warm(spark, sf):
    """Only the test rows are streamed; buffers are preloaded with the rows before them."""
    sources.use_rocksdb(spark)
    rows = scaled(spark, sf)
    inbox, out = scratch_path(spark, "inbox"), scratch_path(spark, "warm-features")
    test = rows.where("split = 'test'").select("sensor_id", "ts", F.col("pos").alias("seq"), "value", "value_scaled")
    test.write.parquet(inbox)
    warm = buffer.warm_rows(rows.where("split <> 'test'"))
    stream = sources.reading_stream(spark, inbox, test.schema)
    scoring.run_available(buffer.online_features(stream, warm), scratch_path(spark, "warm"), out)
    done = spark.read.schema(buffer.OUTPUT).parquet(out)
    return done.select("sensor_id", F.col("seq").alias("pos"), *[r(c).alias(c) for c in features.FEATURES])


fragment(
    "online_long",
    " UNION ALL ".join(f"SELECT sensor_id, pos, '{c}' AS feature, {c} AS v FROM online_features" for c in features.FEATURES),
    "online_features",
)
fragment(
    "online_binned",
    """SELECT *, least(9, greatest(0, CAST(floor((v - (mean - 3 * std)) / (0.6::DOUBLE * std)) AS INT))) AS bin
       FROM online_long JOIN stats USING (feature) QUALIFY row_number() OVER (PARTITION BY sensor_id, feature ORDER BY pos DESC) <= 500""",
    "online_long",
    "stats",
)
drift_sql("online_drift", "online_binned", "sensor_id")


@query(
    "stream_drift",
    with_ctes(["online_drift"], f"SELECT sensor_id, feature, n, {rsql('psi', 'psi')}, {rsql('shift', 'shift')}, status FROM online_drift"),
)
def stream_drift(spark, sf):
    """The last report per sensor after all deliveries."""
    stats = stats_list(spark, sf)
    out = scratch_path(spark, "stream-drift")
    online = features.rolling_features(scaled(spark, sf), online=True)
    rows = online.select("sensor_id", "ts", F.col("pos").alias("seq"), *features.FEATURES)
    run_deliveries(spark, rows, lambda s: drift.drift_stream(s, stats), out)
    reports = spark.read.schema(drift.OUTPUT).parquet(out)
    last = reports.groupBy("sensor_id", "feature").agg(F.max_by(F.struct("n", "psi", "shift", "status"), "as_of").alias("d"))
    return last.select("sensor_id", "feature", "d.n", r("d.psi").alias("psi"), r("d.shift").alias("shift"), "d.status")


@query("stream_scoring")
def stream_scored(spark, sf):
    """Readings to stored predictions and alerts; returns the alerts joined to their reading."""
    train = splits.normal_rows(complete(spark, sf))
    model = isolation.fit(train, features.FEATURES, ROW)
    val = model.transform(complete(spark, sf).where("split = 'val'")).withColumn("model", F.lit("isolation_forest"))
    threshold = best_linear(val, ["model"]).first()["threshold"]
    rows = labelled(spark, sf)
    scaler = splits.fit_scaler(splits.burn_in(rows))
    readings = rows.select("sensor_id", "ts", F.col("pos").alias("seq"), "value")
    root = scratch_path(spark, "stream-tables")
    stats = stats_list(spark, sf)
    run_deliveries(
        spark,
        readings,
        lambda s: scoring.score_stream(s, scaler, model, threshold, "isolation_forest", stats),
        scoring.table_sink(root),
    )
    stored = scoring.read_sink(spark, root, "readings").select("sensor_id", "id", "anomaly_score", "late")
    alerts = scoring.read_sink(spark, root, "alerts").drop("id").withColumnRenamed("reading_id", "id")
    stored = stored.drop("sensor_id")
    return alerts.join(stored, "id").select("sensor_id", "id", "ts", "severity", "score", "anomaly_score", "reason", "status")


class RollingRule:
    """The z rule as a model."""

    def transform(self, df: DataFrame, name: str = "score") -> DataFrame:
        return df.withColumn(name, F.round(F.abs("zscore_15"), 6))


@query(
    "stream_alert_rows",
    with_ctes(
        ["online_features"],
        """SELECT sensor_id, ts, CASE WHEN z - 2.5 < 1 THEN 'low' WHEN z - 2.5 < 3 THEN 'medium' ELSE 'high' END AS severity,
                  z + 0.0::DOUBLE AS score, false AS acknowledged, 'new' AS status, 1 AS alerts_of_reading
           FROM (SELECT sensor_id, ts, round(abs(zscore_15), 6) AS z FROM online_features) WHERE z > 2.5""",
    ),
)
def stream_alert_rows(spark, sf):
    """Alerts of the z rule as the sink stores them, over two deliveries and a restart."""
    rows = labelled(spark, sf)
    scaler = splits.fit_scaler(splits.burn_in(rows))
    readings = rows.select("sensor_id", "ts", F.col("pos").alias("seq"), "value")
    root = scratch_path(spark, "stream-alerts")
    run_deliveries(
        spark,
        readings,
        lambda s: scoring.score_stream(s, scaler, RollingRule(), 2.5, "rolling_zscore", []),
        scoring.table_sink(root),
    )
    alerts = scoring.read_sink(spark, root, "alerts")
    per_reading = alerts.groupBy("reading_id").agg(F.count("*").cast("int").alias("alerts_of_reading"))
    columns = ["sensor_id", "ts", "severity", "score", "acknowledged", "status", "alerts_of_reading"]
    return alerts.join(per_reading, "reading_id").select(*columns)


def event_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The event file itself as a stream source."""
    schema = pin(spark).read.parquet(f"{sf}/events.parquet").schema
    raw = sources.reading_stream(spark, sf, schema, glob="events.parquet")
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def kpi_sql(width: str) -> str:
    return f"""SELECT time_bucket(INTERVAL {width}, ts) AS window_start, count(*) AS n, count(*) FILTER (value > 150) AS anomalies,
                      round(avg(value), 6) + 0.0::DOUBLE AS mean_value FROM events GROUP BY 1"""


def drained_kpis(spark: SparkSession, sf: str, width: str, slide: str | None = None) -> DataFrame:
    """Complete mode: every window is rewritten by its batch, the last batch holds all."""
    out = scratch_path(spark, "kpis")
    stats = scoring.running_kpis(event_stream(spark, sf), width, slide, hit=F.col("value") > 150)

    def replace(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    scoring.run_available(stats, scratch_path(spark, "kpi-stream"), replace, "complete")
    return spark.read.parquet(out).withColumn("mean_value", r("mean_value"))


@query(
    "stream_kpis_append",
    f"""SELECT * FROM ({kpi_sql("1 HOUR")}) WHERE window_start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTES""",
)
def kpis_append(spark, sf):
    """Append mode: a window is written once, when the watermark has passed it, and then leaves the state."""
    out = scratch_path(spark, "kpis")
    stats = scoring.running_kpis(event_stream(spark, sf), "1 hour", hit=F.col("value") > 150)
    scoring.run_available(stats, scratch_path(spark, "kpi-stream"), out)
    return spark.read.schema(stats.schema).parquet(out).withColumn("mean_value", r("mean_value"))


def appended_kpis(spark: SparkSession, sf: str, width: str, slide: str | None = None) -> DataFrame:
    """Append mode: windows leave the state, and are written, once the watermark has passed them."""
    out = scratch_path(spark, "kpis")
    stats = scoring.running_kpis(event_stream(spark, sf), width, slide, hit=F.col("value") > 150)
    scoring.run_available(stats, scratch_path(spark, "kpi-stream"), out)
    return spark.read.schema(stats.schema).parquet(out).withColumn("mean_value", r("mean_value"))


CLOSED_WINDOWS = "window_start + INTERVAL {width} <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTES"


@query("stream_kpis_minute_append", f"SELECT * FROM ({kpi_sql('1 MINUTE')}) WHERE {CLOSED_WINDOWS.format(width='1 MINUTE')}")
def kpis_minute_append(spark, sf):
    return appended_kpis(spark, sf, "1 minute")


SLIDING_SQL = """SELECT w AS window_start, count(*) AS n, count(*) FILTER (value > 150) AS anomalies, round(avg(value), 6) + 0.0::DOUBLE AS mean_value
       FROM (SELECT value, unnest([time_bucket(INTERVAL 30 MINUTES, ts), time_bucket(INTERVAL 30 MINUTES, ts) - INTERVAL 30 MINUTES]) AS w FROM events)
       GROUP BY 1"""


@query("stream_kpis_sliding_append", f"SELECT * FROM ({SLIDING_SQL}) WHERE {CLOSED_WINDOWS.format(width='1 HOUR')}")
def kpis_sliding_append(spark, sf):
    return appended_kpis(spark, sf, "1 hour", "30 minutes")


@query("stream_kpis_minute", kpi_sql("1 MINUTE"))
def kpis_minute(spark, sf):
    return drained_kpis(spark, sf, "1 minute")


@query(
    "stream_kpis_sliding",
    """SELECT w AS window_start, count(*) AS n, count(*) FILTER (value > 150) AS anomalies, round(avg(value), 6) + 0.0::DOUBLE AS mean_value
       FROM (SELECT value, unnest([time_bucket(INTERVAL 30 MINUTES, ts), time_bucket(INTERVAL 30 MINUTES, ts) - INTERVAL 30 MINUTES]) AS w FROM events)
       GROUP BY 1""",
)
def kpis_sliding(spark, sf):
    return drained_kpis(spark, sf, "1 hour", "30 minutes")


@query(
    "stream_alerts",
    """SELECT event_id AS id, event_type AS sensor_id, value FROM events WHERE value > 150""",
)
def stream_alerts(spark, sf):
    """Stateless filter from source to sink with an idempotent batch directory."""
    out = scratch_path(spark, "alert-stream")
    rows = event_stream(spark, sf).where(F.col("value") > 150)
    picked = rows.select(F.col("event_id").alias("id"), F.col("event_type").alias("sensor_id"), "value")
    scoring.run_available(picked, scratch_path(spark, "alert-check"), out)
    return spark.read.schema(picked.schema).parquet(out)


# ---- event time ------------------------------------------------------------------

# fixed values: days of a delivery, the most slots a reading is under way, and how many deliveries a late one waits
DELIVERY_DAYS, SHUFFLE, LATE_BY = 5, 11, 2
DELIVERY_SQL = f"""CAST(floor(epoch(ts + (pos * 37 % {SHUFFLE}) * INTERVAL 5 MINUTES) / {DELIVERY_DAYS * 86400}) AS BIGINT)
                   + CASE WHEN pos % 97 = 13 THEN {LATE_BY} ELSE 0 END"""
fragment("delivered", f"SELECT *, {DELIVERY_SQL} AS delivery FROM scaled", "scaled")
fragment(
    "horizons",
    """SELECT delivery, lag(newest) OVER (ORDER BY delivery) AS horizon
       FROM (SELECT delivery, max(max(ts)) OVER (ORDER BY delivery) - INTERVAL 1 HOUR AS newest FROM delivered GROUP BY delivery)""",
    "delivered",
)
fragment("judged", "SELECT d.*, coalesce(ts <= horizon, false) AS late FROM delivered d JOIN horizons USING (delivery)", "horizons")
fragment(
    "in_time",
    """SELECT sensor_id, ts, x, pos AS slot, row_number() OVER (PARTITION BY sensor_id ORDER BY pos) - 1 AS pos
       FROM judged WHERE NOT late AND ts <= (SELECT max(ts) - INTERVAL 1 HOUR FROM delivered)""",
    "judged",
)
_CHAIN = ["rolled", "zscores", *(f"buffered_{w}" for w in features.WINDOWS), "online_features"]
for _name in _CHAIN:  # the online features over the readings that were in time
    _sql = re.sub(r"\b(" + "|".join(_CHAIN) + r")\b", r"timely_\1", re.sub(r"\bscaled\b", "in_time", FRAGMENTS[_name]))
    fragment(f"timely_{_name}", _sql, *[{"scaled": "in_time"}.get(d, f"timely_{d}") for d in DEPENDS[_name]])


def event_time_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The event history in deliveries of some days, shuffled within 55 minutes; a few readings come days late."""

    def build() -> DataFrame:
        sources.use_rocksdb(spark)
        inbox, checkpoint, out = (scratch_path(spark, name) for name in ("inbox", "stream", "ordered-features"))
        under_way = F.expr(f"make_interval(0, 0, 0, 0, 0, 5 * int(seq * 37 % {SHUFFLE}))")
        days = F.floor(F.unix_seconds(F.col("ts") + under_way) / (DELIVERY_DAYS * 86400))
        delivery = days + F.when(F.col("seq") % 97 == 13, LATE_BY).otherwise(0)
        rows = grid_rows(spark, sf).withColumn("delivery", delivery)
        numbers = sorted(row[0] for row in rows.select("delivery").distinct().collect())  # a few
        for number in numbers:
            rows.where(F.col("delivery") == number).select(*STREAM_SCHEMA.names).write.mode("append").parquet(inbox)
            stream = sources.reading_stream(spark, inbox, STREAM_SCHEMA)
            scoring.run_available(eventtime.ordered_features(stream, 60), checkpoint, out)
        return spark.read.schema(buffer.OUTPUT).parquet(out)

    return stored(spark, sf, "event-time-features", build)


@query(
    "stream_event_time_features",
    with_ctes(["timely_online_features"], f"SELECT sensor_id, ts, {FEATURE_SQL} FROM timely_online_features"),
)
def event_time_features(spark, sf):
    """Shuffled deliveries give the features of the ordered series of readings that were in time."""
    rows = eventtime.on_time(event_time_rows(spark, sf))
    return rows.select("sensor_id", "ts", *[r(c).alias(c) for c in features.FEATURES])


@query("stream_late_rows", with_ctes(["judged"], f"SELECT sensor_id, ts, pos AS seq, {rsql('value', 'value')} FROM judged WHERE late"))
def late_readings(spark, sf):
    """The side table of readings that came after their time."""
    return eventtime.late_rows(event_time_rows(spark, sf)).withColumn("value", r("value"))


@query(
    "stream_chunked_features",
    with_ctes(["online_features"], f"SELECT sensor_id, pos, false AS late, {FEATURE_SQL} FROM online_features"),
)
def chunked_features(spark, sf):
    """The online features again, by sensor and chunk of a micro-batch."""
    sink = chunked.ChunkedFeatures(spark, scratch_path(spark, "chunked"))
    run_deliveries(spark, grid_rows(spark, sf), lambda s: s, sink)
    rows = chunked.read_features(spark, sink.root)
    return rows.select("sensor_id", F.col("seq").alias("pos"), "late", *[r(c).alias(c) for c in features.FEATURES])


# ---- detectors, drift and runs as state ----------------------------------------------


@query("stream_half_space_trees")
def streamed_trees(spark, sf):
    """Scores of `half_space_trees_prequential`, with the masses as state over two deliveries."""
    rows = feature_store(spark, sf).where(F.col("pos") >= 0).withColumn("seq", F.col("pos"))
    unit = rows.withColumns({c: F.least(F.greatest((F.col(c) + 3) / 6, F.lit(0.0)), F.lit(1.0)) for c in features.FEATURES})
    unit = unit.na.fill(0.0, features.FEATURES).select("sensor_id", "ts", "seq", *features.FEATURES)
    out = scratch_path(spark, "tree-scores")
    run_deliveries(spark, unit, lambda s: trees.tree_scores(s, features.FEATURES), out)
    return spark.read.schema(trees.OUTPUT).parquet(out).select("sensor_id", F.col("seq").alias("pos"), "score")


@query("stream_drift_all_sensors", with_ctes(["all_drift"], ROLL_UP.format(keys="scope", source="all_drift")))
def stream_drift_of_all(spark, sf):
    """The last report over all sensors after all deliveries."""
    stats = stats_list(spark, sf)
    out = scratch_path(spark, "stream-drift-all")
    rows = complete(spark, sf).select("sensor_id", "ts", F.col("pos").alias("seq"), *features.FEATURES)
    run_deliveries(spark, rows, lambda s: drift.drift_of_all(s, stats), out)
    reports = spark.read.schema(drift.OUTPUT).parquet(out)
    last = reports.groupBy("feature", "ord").agg(F.max_by(F.struct("n", "psi", "shift", "status"), "as_of").alias("d"))
    last = last.select(F.lit("all").alias("scope"), "feature", "ord", "d.*")
    return flat_status(drift_rules.roll_up(last, ["scope"]), ["scope"])


# A run is closed by a row behind it, or by the watermark: an hour behind the newest reading, half an hour after the run.
CLOSED = """EXISTS (SELECT 1 FROM preds p WHERE p.model = c.model AND p.sensor_id = c.sensor_id AND p.pos > c.last_pos)
            OR last_ts + INTERVAL 90 MINUTES <= (SELECT max(ts) FROM preds)"""
fragment(
    "closed_runs",
    f"""SELECT kind, model, sensor_id, start, length, hit, first_hit,
               5.0::DOUBLE * coalesce(first_hit - start, length) AS latency_min FROM (
          SELECT 'window' AS kind, model, sensor_id, min(pos) AS start, count(*) AS length, max(pred) AS hit,
                 min(CASE WHEN pred = 1 THEN pos END) AS first_hit, max(pos) AS last_pos, max(ts) AS last_ts
          FROM label_runs WHERE label = 1 GROUP BY model, sensor_id, island
          UNION ALL
          SELECT 'segment', model, sensor_id, min(pos), count(*), max(label), min(CASE WHEN label = 1 THEN pos END), max(pos), max(ts)
          FROM pred_runs WHERE pred = 1 GROUP BY model, sensor_id, island) c WHERE {CLOSED}""",
    "preds",
    "label_runs",
    "pred_runs",
)


def streamed_runs(spark: SparkSession, sf: str) -> DataFrame:
    def build() -> DataFrame:
        out = scratch_path(spark, "closed-runs")
        rows = predicted(spark, sf).select("model", "sensor_id", "ts", "pos", "label", "pred")
        run_deliveries(spark, rows, runs.closed_runs, out, "2024-01-28 03:00:00")
        return spark.read.schema(runs.OUTPUT).parquet(out)

    return stored(spark, sf, "closed-runs", build)


@query("stream_closed_runs", with_ctes(["closed_runs"], "SELECT * FROM closed_runs"))
def closed_runs(spark, sf):
    """Predicted segments and true windows as they end on the stream, over two deliveries."""
    return streamed_runs(spark, sf).drop("closed_by")


@query(
    "stream_window_metrics",
    with_ctes(
        ["closed_runs"],
        f"""SELECT model, {rsql("precision", "window_precision")}, {rsql("recall", "window_recall")},
                   {rsql("CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END", "window_f1")},
                   {rsql("latency", "detection_latency_min")}
            FROM (SELECT model, avg(hit::DOUBLE) FILTER (kind = 'window') AS recall, avg(hit::DOUBLE) FILTER (kind = 'segment') AS precision,
                         avg(latency_min) FILTER (kind = 'window') AS latency FROM closed_runs GROUP BY 1)""",
    ),
)
def stream_window_metrics(spark, sf):
    out = runs.latency_by_model(streamed_runs(spark, sf))
    return out.select("model", *[r(c).alias(c) for c in ("window_precision", "window_recall", "window_f1", "detection_latency_min")])


@query(
    "stream_replay",
    with_ctes(
        ["stored_alerts"],
        """SELECT a.id AS alert_id, r.id, r.ts, r.sensor_id, r.value, r.anomaly_score
           FROM stored_alerts a JOIN stored_readings r ON r.id BETWEEN greatest(1, a.reading_id - 30) AND a.reading_id + 30""",
    ),
)
def streamed_replay(spark, sf):
    """Context of every alert from two streams, each in two deliveries."""
    sources.use_rocksdb(spark)
    inboxes = {name: scratch_path(spark, f"inbox-{name}") for name in ("alerts", "readings")}
    alerts = alerts_table(spark, sf).select("id", "reading_id", "ts")
    readings = readings_table(spark, sf).select("id", "ts", "sensor_id", "value", "anomaly_score")
    checkpoint, out = scratch_path(spark, "replay-stream"), scratch_path(spark, "replay")
    for _ in zip(deliver(alerts, inboxes["alerts"]), deliver(readings, inboxes["readings"])):
        streams = [sources.reading_stream(spark, inboxes[n], d.schema) for n, d in (("alerts", alerts), ("readings", readings))]
        joined = replay.replay_stream(*streams)
        scoring.run_available(joined, checkpoint, out)
    return spark.read.schema(joined.schema).parquet(out)


@query(
    "stream_model_exchange",
    with_ctes(
        ["features"],
        f"""SELECT CASE WHEN ts < TIMESTAMP '{DELIVERY_CUT}' THEN 'half_space_trees' ELSE 'isolation_forest' END AS model,
                   CASE WHEN ts < TIMESTAMP '{DELIVERY_CUT}' THEN 2 ELSE 3 END AS registry_version,
                   CASE WHEN ts < TIMESTAMP '{DELIVERY_CUT}' THEN 0.9::DOUBLE ELSE 0.6::DOUBLE END AS threshold,
                   sensor_id, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts
            FROM features WHERE roll_mean_60 IS NOT NULL GROUP BY 1, 2, 3, 4""",
    ),
)
def model_exchange(spark, sf):
    """Who scored which readings, when another model is promoted between two deliveries."""
    sources.use_rocksdb(spark)
    train = splits.normal_rows(complete(spark, sf))
    root, models = scratch_path(spark, "models"), scratch_path(spark, "registry")
    fitted = {
        "half_space_trees": halfspace.fit(train, features.FEATURES, ["ts", "sensor_id"]),
        "isolation_forest": isolation.fit(train, features.FEATURES, ROW, trees=50),
    }
    paths = {name: store.save(model, spark, f"{root}/{name}") for name, model in fitted.items()}
    entries = [("half_space_trees", paths["half_space_trees"], 0.9), ("isolation_forest", paths["isolation_forest"], 0.5)]
    table = spark.createDataFrame(entries, "name string, artifact_path string, threshold double").withColumns(
        {
            "metrics": F.when(F.col("name") == "isolation_forest", F.create_map(F.lit("threshold"), F.lit(0.6))),
            "is_production": F.lit(False),
        }
    )
    serving.publish(table, models)
    serving.promote(spark, models, "half_space_trees")
    rows = complete(spark, sf).select("sensor_id", "ts", F.col("pos").alias("seq"), *features.FEATURES)
    inbox, checkpoint, out = (scratch_path(spark, name) for name in ("inbox", "serving", "served"))
    server = serving.ModelServer(models, out)
    for _ in deliver(rows, inbox):
        scoring.run_available(sources.reading_stream(spark, inbox, rows.schema), checkpoint, server)
        serving.promote(spark, models, "isolation_forest")
    keys = ["model", "registry_version", "threshold", "sensor_id"]
    done = serving.read_predictions(spark, out)
    return done.groupBy(*keys).agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
