"""Registered queries: cleaning, labels, splits, scaling, features."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import clean, features, scan, splits
from tidewatch.plans.base import (
    EVENT_WINDOWS,
    feature_table,
    grid,
    labelled,
    r,
    rsql,
    scaled,
    slots,
    stored_grid,
    with_ctes,
)
from tidewatch.sources.series import event_readings, normalise_value_column, order_readings, table

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query(
    "series_scan",
    "SELECT event_type AS sensor_id, ts, value, event_id AS seq FROM events",
)
def series_scan(spark, sf):
    return event_readings(spark, sf)


@query(
    "normalise_value_column",
    "SELECT o_orderdate AS ts, o_orderpriority AS sensor_id, o_totalprice AS value FROM orders",
)
def normalised(spark, sf):
    src = table(spark, sf, "orders").select(
        F.col("o_orderdate").cast("timestamp").alias("ts"), F.col("o_orderpriority").alias("sensor_id"), "o_totalprice"
    )
    return normalise_value_column(src)


@query(
    "drop_duplicate_timestamps",
    """SELECT o_orderpriority AS sensor_id, o_orderdate AS ts, o_totalprice AS value, o_orderkey AS seq FROM orders
       QUALIFY row_number() OVER (PARTITION BY o_orderpriority, o_orderdate ORDER BY o_orderkey DESC) = 1""",
)
def dedup(spark, sf):
    return clean.drop_duplicate_timestamps(order_readings(spark, sf))


@query("bucket_to_grid", with_ctes(["slots"], "SELECT sensor_id, ts, value, seq FROM slots"))
def bucketed(spark, sf):
    return slots(spark, sf)


@query(
    "regrid",
    with_ctes(
        ["readings"],
        """, second AS (SELECT sensor_id, CAST(floor(epoch(ts)) AS BIGINT) AS s, ts, value, seq FROM readings),
        ranked AS (SELECT *, min(s) OVER (PARTITION BY sensor_id) AS lo, max(s) OVER (PARTITION BY sensor_id) AS hi FROM second)
        SELECT sensor_id, ts, value, (s - lo) // 60 AS pos, (hi - lo) // 60 + 1 AS n_rows FROM ranked WHERE (s - lo) % 60 = 0""",
    ),
)
def regridded(spark, sf):
    """Off-grid rows are dropped: of the raw events only those on the 60 s grid stay."""
    return clean.regrid(event_readings(spark, sf), 60).select("sensor_id", "ts", "value", "pos", "n_rows")


@query(
    "fill_gaps",
    with_ctes(["grid"], f"SELECT sensor_id, pos, ts, imputed, {rsql('value', 'value')} FROM grid"),
)
def filled(spark, sf):
    return grid(spark, sf).select("sensor_id", "pos", "ts", "imputed", r("value").alias("value"))


@query(
    "gap_blocks",
    with_ctes(
        ["grid"],
        """SELECT sensor_id, block_start, count(*) AS block_size FROM grid
           WHERE block_start IS NOT NULL GROUP BY 1, 2""",
    ),
)
def blocks(spark, sf):
    return clean.gap_blocks(stored_grid(spark, sf))


@query(
    "daily_orders_clean",
    """WITH d AS (SELECT o_orderpriority AS sensor_id, o_orderdate AS ts, o_totalprice AS value FROM orders
                  QUALIFY row_number() OVER (PARTITION BY o_orderpriority, o_orderdate ORDER BY o_orderkey DESC) = 1),
       b AS (SELECT sensor_id, min(ts) AS lo, max(ts) AS hi FROM d GROUP BY 1),
       c AS (SELECT sensor_id, unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS ts FROM b),
       g AS (SELECT c.sensor_id, c.ts, d.value AS raw, epoch(c.ts) / 86400 AS day,
                    last_value(d.value IGNORE NULLS) OVER back AS v0, first_value(d.value IGNORE NULLS) OVER ahead AS v1,
                    last_value(CASE WHEN d.value IS NOT NULL THEN epoch(c.ts) / 86400 END IGNORE NULLS) OVER back AS d0,
                    first_value(CASE WHEN d.value IS NOT NULL THEN epoch(c.ts) / 86400 END IGNORE NULLS) OVER ahead AS d1
             FROM c LEFT JOIN d USING (sensor_id, ts)
             WINDOW back AS (PARTITION BY c.sensor_id ORDER BY c.ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                    ahead AS (PARTITION BY c.sensor_id ORDER BY c.ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
       SELECT sensor_id, ts, CASE WHEN raw IS NULL THEN 1 ELSE 0 END AS imputed,
              round(CASE WHEN raw IS NOT NULL THEN raw WHEN d1 - d0 - 1 <= 3 THEN v0
                         ELSE v0 + (v1 - v0) * (day - d0) / (d1 - d0) END, 6) + 0.0::DOUBLE AS value
       FROM g""",
)
def daily_orders(spark, sf):
    """A dense daily series read without bucketing: its timestamps are grid times."""
    out = clean.clean_series(order_readings(spark, sf), 86400)
    return out.select("sensor_id", "ts", r("value").alias("value"), "imputed")


@query(
    "label_windows",
    with_ctes(["labelled"], "SELECT sensor_id, label, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM labelled GROUP BY 1, 2"),
)
def label_counts(spark, sf):
    return labelled(spark, sf).groupBy("sensor_id", "label").agg(
        F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )


@query(
    "label_from_table",
    with_ctes(
        ["grid"],
        """, known AS (SELECT event_type AS sensor_id, time_bucket(INTERVAL 1 DAY, ts) AS day, min(ts) AS s, max(ts) AS e
                      FROM events WHERE value > 250 GROUP BY 1, 2)
        SELECT g.sensor_id, g.pos, g.ts,
               CASE WHEN EXISTS (SELECT 1 FROM known k WHERE k.sensor_id = g.sensor_id AND g.ts BETWEEN k.s AND k.e)
                    THEN 1 ELSE 0 END AS label
        FROM grid g""",
    ),
)
def labels_joined(spark, sf):
    """Interval join: labels come from a table derived from the events themselves."""
    known = (
        event_readings(spark, sf)
        .where(F.col("value") > 250)
        .groupBy("sensor_id", F.to_date("ts").alias("day"))
        .agg(F.min("ts").alias("start"), F.max("ts").alias("end"))
        .drop("day")
    )
    rows = stored_grid(spark, sf).select("sensor_id", "pos", "ts")
    return splits.label_from_table(rows, known)


@query(
    "chronological_split",
    with_ctes(["labelled"], "SELECT sensor_id, pos, ts, split FROM labelled"),
)
def split_rows(spark, sf):
    return labelled(spark, sf).select("sensor_id", "pos", "ts", "split")


@query(
    "split_off_grid",
    """WITH n AS (SELECT event_type AS sensor_id, event_id AS seq,
                   row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS pos,
                   count(*) OVER (PARTITION BY event_type) AS n_rows FROM events)
       SELECT sensor_id, seq, pos, CASE WHEN pos < floor(n_rows * 0.70::DOUBLE) THEN 'train'
              WHEN pos < floor(n_rows * 0.85::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM n""",
)
def split_raw(spark, sf):
    return splits.split_off_grid(event_readings(spark, sf)).select("sensor_id", "seq", "pos", "split")


@query(
    "burn_in",
    with_ctes(
        ["labelled"],
        """SELECT sensor_id, pos, label FROM labelled
           WHERE label = 0 AND pos < floor(floor(n_rows * 0.70::DOUBLE) * 0.15::DOUBLE)""",
    ),
)
def burn_in_rows(spark, sf):
    return splits.burn_in(labelled(spark, sf)).select("sensor_id", "pos", "label")


@query(
    "fit_scaler",
    with_ctes(["scaler"], f"SELECT sensor_id, {rsql('mean', 'mean')}, {rsql('scale', 'scale')} FROM scaler"),
)
def scaler(spark, sf):
    fitted = splits.fit_scaler(splits.burn_in(labelled(spark, sf)))
    return fitted.select("sensor_id", r("mean").alias("mean"), r("scale").alias("scale"))


@query(
    "apply_scaler",
    with_ctes(["scaled"], f"SELECT sensor_id, pos, {rsql('x', 'value_scaled')} FROM scaled"),
)
def scaled_rows(spark, sf):
    return scaled(spark, sf).select("sensor_id", "pos", r("value_scaled").alias("value_scaled"))


UNFITTED = "purchase"


@query(
    "scale_unknown_sensor",
    with_ctes(
        ["labelled", "scaler"],
        f"""SELECT l.sensor_id, l.pos, {rsql("CASE WHEN s.sensor_id IS NULL THEN l.value ELSE (l.value - s.mean) / s.scale END", "value_scaled")}
            FROM labelled l LEFT JOIN (SELECT * FROM scaler WHERE sensor_id <> '{UNFITTED}') s USING (sensor_id)""",
    ),
)
def scaled_without_one(spark, sf):
    """One sensor has no fitted scaler: its rows stay, with their raw values."""
    rows = labelled(spark, sf)
    fitted = splits.fit_scaler(splits.burn_in(rows)).where(F.col("sensor_id") != UNFITTED)
    return splits.apply_scaler(rows, fitted).select("sensor_id", "pos", r("value_scaled").alias("value_scaled"))


@query(
    "rows_of_unknown_sensors",
    f"""SELECT event_type AS sensor_id, count(*) AS n FROM events WHERE event_type = '{UNFITTED}' GROUP BY 1""",
)
def unknown_rows(spark, sf):
    rows = event_readings(spark, sf)
    return splits.unknown_to(splits.fit_scaler(rows).where(F.col("sensor_id") != UNFITTED), rows)


@query(
    "row_number_null_key",
    """SELECT event_id, key, row_number() OVER (PARTITION BY key ORDER BY value, event_id) - 1 AS n
       FROM (SELECT event_id, value, CASE WHEN event_type <> 'error' THEN event_type END AS key FROM events)""",
)
def numbered_null_key(spark, sf):
    key = F.when(F.col("event_type") != "error", F.col("event_type")).alias("key")
    rows = table(spark, sf, "events").select("event_id", "value", key)
    return scan.row_number(rows, ["key"], "value", ["event_id"], "n").select("event_id", "key", "n")


@query(
    "row_number_common_value",
    """SELECT event_id, row_number() OVER (ORDER BY v, event_id) - 1 AS n
       FROM (SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN 7.0::DOUBLE ELSE value END AS v FROM events)""",
)
def numbered_common_value(spark, sf):
    """Two of five rows share one value; the tie-break cuts their group."""
    v = F.when(F.col("event_type").isin("view", "click"), F.lit(7.0)).otherwise(F.col("value")).alias("v")
    rows = table(spark, sf, "events").select("event_id", v)
    return scan.row_number(rows, [], "v", ["event_id"], "n").select("event_id", "n")


@query(
    "leakage_report",
    with_ctes(
        ["labelled"],
        """SELECT sensor_id, train_end, val_start, val_end, test_start, burn_in_anomalies,
                  train_end < val_start AND val_end < test_start AS in_order
           FROM (SELECT sensor_id, max(ts) FILTER (split = 'train') AS train_end, min(ts) FILTER (split = 'val') AS val_start,
                        max(ts) FILTER (split = 'val') AS val_end, min(ts) FILTER (split = 'test') AS test_start,
                        CAST(sum(CASE WHEN pos < floor(floor(n_rows * 0.70::DOUBLE) * 0.15::DOUBLE) THEN label ELSE 0 END) AS BIGINT)
                          AS burn_in_anomalies
                 FROM labelled GROUP BY 1)""",
    ),
)
def leakage(spark, sf):
    return splits.leakage_report(labelled(spark, sf))


@query(
    "normal_train_rows",
    with_ctes(["labelled"], "SELECT sensor_id, count(*) AS n, max(ts) AS last_ts FROM labelled WHERE split = 'train' AND label = 0 GROUP BY 1"),
)
def normal_train(spark, sf):
    return splits.normal_rows(labelled(spark, sf)).groupBy("sensor_id").agg(
        F.count("*").alias("n"), F.max("ts").alias("last_ts")
    )


def rounded_features(df, keys):
    return df.select(*keys, *[r(c).alias(c) for c in features.FEATURES])


FEATURE_SQL = ", ".join(rsql(c, c) for c in features.FEATURES)


@query("rolling_features", with_ctes(["features"], f"SELECT sensor_id, pos, {FEATURE_SQL} FROM features"))
def rolled(spark, sf):
    return rounded_features(feature_table(spark, sf), ["sensor_id", "pos"])


@query("online_features", with_ctes(["online_features"], f"SELECT sensor_id, pos, {FEATURE_SQL} FROM online_features"))
def rolled_online(spark, sf):
    return rounded_features(features.rolling_features(scaled(spark, sf), online=True), ["sensor_id", "pos"])


@query(
    "feature_set_hash",
    """SELECT event_type AS sensor_id, count(*) AS n_keys,
              substr(md5('[' || list_aggregate(list_sort(list(DISTINCT '"' || props || '"')), 'string_agg', ', ') || ']'), 1, 8) AS feature_hash
       FROM (SELECT event_type, json_extract_string(props, '$.k') AS props FROM events) GROUP BY 1""",
)
def contract_hash(spark, sf):
    """Hash of the sorted set of property names seen per sensor (at most 100 names)."""
    rows = table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k"))
    return rows.groupBy(F.col("event_type").alias("sensor_id")).agg(
        F.count("*").alias("n_keys"), features.feature_set_hash_column(F.collect_set("k")).alias("feature_hash")
    )


@query(
    "drop_incomplete",
    with_ctes(["zscores"], "SELECT sensor_id, count(*) AS n, min(pos) AS first_pos FROM zscores WHERE roll_mean_60 IS NOT NULL GROUP BY 1"),
)
def complete_rows(spark, sf):
    rows = clean.drop_incomplete(feature_table(spark, sf), features.FEATURES)
    return rows.groupBy("sensor_id").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"))


@query(
    "zero_fill",
    with_ctes(
        ["zscores"],
        """SELECT sensor_id, count(*) AS n, count(*) FILTER (coalesce(zscore_60, 0) = 0) AS zeros,
                  CAST(0 AS DOUBLE) AS missing_feature FROM zscores GROUP BY 1""",
    ),
)
def zero_filled(spark, sf):
    rows = clean.zero_fill(feature_table(spark, sf), [*features.FEATURES, "missing_feature"])
    return rows.groupBy("sensor_id").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("zscore_60") == 0).alias("zeros"),
        F.max("missing_feature").alias("missing_feature"),
    )


@query(
    "baseline_stats",
    with_ctes(
        ["features"],
        "SELECT * FROM ("
        + " UNION ALL ".join(
            f"SELECT '{c}' AS feature, {rsql(f'avg({c})', 'mean')}, {rsql(f'stddev_samp({c})', 'std')}, {i} AS ord "
            "FROM features WHERE split = 'train' AND label = 0 AND roll_mean_60 IS NOT NULL"
            for i, c in enumerate(features.FEATURES)
        )
        + ")",
    ),
)
def stats(spark, sf):
    rows = clean.drop_incomplete(splits.normal_rows(feature_table(spark, sf)), features.FEATURES)
    return features.baseline_stats(rows).select("feature", r("mean").alias("mean"), r("std").alias("std"), "ord")


@query(
    "causality_check",
    with_ctes(
        ["labelled"],
        """SELECT sensor_id, count(*) AS rows_before_cut, CAST(0 AS BIGINT) AS changed_rows
           FROM labelled WHERE split = 'train' GROUP BY 1""",
    ),
)
def causality(spark, sf):
    """Changing every value after the train split must not change a train feature."""
    base = scaled(spark, sf)
    spoiled = base.withColumn("value_scaled", F.when(F.col("split") == "train", F.col("value_scaled")).otherwise(999.0))
    pick = lambda d: features.rolling_features(d).where(F.col("split") == "train").select(
        "sensor_id", "pos", F.xxhash64(*[F.round(c, 9) for c in features.FEATURES]).alias("h")
    )
    before, after = pick(base), pick(spoiled)
    both = before.alias("a").join(after.alias("b"), ["sensor_id", "pos"], "full")
    return both.groupBy("sensor_id").agg(
        F.count(F.col("a.h")).alias("rows_before_cut"),
        F.count_if(~F.col("a.h").eqNullSafe(F.col("b.h"))).alias("changed_rows"),
    )


@query(
    "retraining_features",
    with_ctes(
        ["grid"],
        f"""SELECT sensor_id, pos, {rsql('rolling_mean', 'rolling_mean')}, {rsql('rolling_std', 'rolling_std')},
                   {rsql('value_diff_1', 'value_diff_1')},
                   {rsql('coalesce(value_diff_1 - lag(value_diff_1) OVER o, 0)', 'value_diff_2')}
            FROM (SELECT sensor_id, pos, avg(value) OVER f AS rolling_mean, coalesce(stddev_samp(value) OVER f, 1e-9) AS rolling_std,
                         coalesce(value - lag(value) OVER o2, 0) AS value_diff_1
                  FROM grid WINDOW f AS (PARTITION BY sensor_id ORDER BY pos ROWS BETWEEN 14 PRECEDING AND CURRENT ROW),
                                   o2 AS (PARTITION BY sensor_id ORDER BY pos))
            WINDOW o AS (PARTITION BY sensor_id ORDER BY pos)""",
    ),
)
def retrain_features(spark, sf):
    rows = features.retraining_features(stored_grid(spark, sf))
    names = ("rolling_mean", "rolling_std", "value_diff_1", "value_diff_2")
    return rows.select("sensor_id", "pos", *[r(c).alias(c) for c in names])
