"""Registered queries: scores, threshold selection, evaluation, decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import clean, evaluate, features, scoring, splits, thresholds
from tidewatch.operators.scan import exact_quantiles
from tidewatch.plans import base
from tidewatch.plans.base import fragment, r, rsql, with_ctes
from tidewatch.plans.store import stored

QUERIES, ORACLES = {}, {}
MODELS = [f"zscore_{w}" for w in features.WINDOWS]


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def feature_store(spark: SparkSession, sf: str) -> DataFrame:
    return stored(spark, sf, "features", lambda: base.feature_table(spark, sf), partition_by="split")


def model_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Long score table of the rolling z-score family; rounding makes ties real ties."""

    def build() -> DataFrame:
        rows = clean.drop_incomplete(feature_store(spark, sf), features.FEATURES)
        each = F.explode(
            F.array(*[F.struct(F.lit(m).alias("model"), F.round(F.abs(F.col(m)), 6).alias("score")) for m in MODELS])
        )
        return rows.select("sensor_id", "pos", "ts", "split", "label", each.alias("s")).select(
            "s.model", "sensor_id", "pos", "ts", "split", "label", "s.score"
        )

    return stored(spark, sf, "scores", build, partition_by="split")


def chosen(spark: SparkSession, sf: str) -> DataFrame:
    """Threshold per model, selected on the validation split."""
    return thresholds.best_of_fixed(validation(spark, sf), ["model"])


def validation(spark: SparkSession, sf: str) -> DataFrame:
    return model_scores(spark, sf).where(F.col("split") == "val")


def predicted(spark: SparkSession, sf: str) -> DataFrame:
    """Test rows with the prediction of each model at its chosen threshold."""

    def build() -> DataFrame:
        test = model_scores(spark, sf).where(F.col("split") == "test")
        limits = chosen(spark, sf).select("model", "threshold")
        return test.join(limits, "model").withColumn("pred", (F.col("score") > F.col("threshold")).cast("int"))

    return stored(spark, sf, "predictions", build)


fragment(
    "scores",
    " UNION ALL ".join(
        f"SELECT '{m}' AS model, sensor_id, pos, ts, split, label, round(abs({m}), 6) AS score FROM zscores WHERE roll_mean_60 IS NOT NULL"
        for m in MODELS
    ),
    "zscores",
)
SWEPT = """SELECT model, k, threshold, tp, predicted, positives,
                  CASE WHEN predicted = 0 THEN 0 ELSE tp / predicted::DOUBLE END AS precision,
                  CASE WHEN positives = 0 THEN 0 ELSE tp / positives::DOUBLE END AS recall,
                  CASE WHEN positives + predicted = 0 THEN 0 ELSE 2 * tp / (positives + predicted)::DOUBLE END AS f1
           FROM (SELECT g.model, g.k, g.t AS threshold, count(*) FILTER ({hit} AND label = 1) AS tp,
                        count(*) FILTER ({hit}) AS predicted, count(*) FILTER (label = 1) AS positives
                 FROM {grid} g JOIN scores s ON s.model = g.model AND s.split = 'val' GROUP BY 1, 2, 3)"""
fragment(
    "linear_points",
    """SELECT model, k, CASE WHEN k = 99 THEN hi ELSE k * ((hi - lo) / 99.0::DOUBLE) + lo END AS t
       FROM (SELECT model, min(score) AS lo, max(score) AS hi, unnest(range(0, 100)) AS k
             FROM scores WHERE split = 'val' GROUP BY 1)""",
    "scores",
)
fragment(
    "fixed_points",
    """SELECT model, k, CASE WHEN k = 50 THEN 6.0::DOUBLE ELSE k * (5.0::DOUBLE / 50.0::DOUBLE) + 1.0::DOUBLE END AS t
       FROM (SELECT model, unnest(range(0, 51)) AS k FROM scores GROUP BY 1)""",
    "scores",
)

def _quantile_points(first: float, last: float, points: int, fallback: float) -> str:
    step = (last - first) / (points - 1)
    percents = [first + i * step for i in range(points - 1)] + [last, fallback]
    listed = ", ".join(f"{p / 100.0!r}::DOUBLE" for p in percents)
    return f"""SELECT model, unnest(range(0, {points + 1})) AS k, unnest(quantile_cont(score, [{listed}])) AS t
               FROM scores WHERE split = 'val' GROUP BY 1"""


fragment("upper_points", _quantile_points(*thresholds.UPPER_PERCENTILES), "scores")
fragment("lower_points", _quantile_points(*thresholds.LOWER_PERCENTILES), "scores")
for _grid, _hit in (("linear", "score > t"), ("fixed", "score > t"), ("upper", "score > t"), ("lower", "score < t")):
    fragment(f"{_grid}_sweep", SWEPT.format(grid=f"{_grid}_points", hit=_hit), f"{_grid}_points")
    fragment(
        f"{_grid}_best",
        f"SELECT * FROM {_grid}_sweep QUALIFY row_number() OVER (PARTITION BY model ORDER BY f1 DESC, k) = 1",
        f"{_grid}_sweep",
    )
fragment(
    "preds",
    """SELECT s.*, b.threshold, CASE WHEN s.score > b.threshold THEN 1 ELSE 0 END AS pred
       FROM scores s JOIN fixed_best b USING (model) WHERE s.split = 'test'""",
    "fixed_best",
)

SWEEP_COLUMNS = f"model, k, tp, predicted, positives, {rsql('threshold', 'threshold')}, {rsql('f1', 'f1')}"
BEST_COLUMNS = ", ".join(["model", *[rsql(c, c) for c in ("threshold", "precision", "recall", "f1")]])


def best_rounded(df: DataFrame) -> DataFrame:
    return df.select("model", *[r(c).alias(c) for c in ("threshold", "precision", "recall", "f1")])


@query(
    "zscore_rule",
    with_ctes(
        ["zscores"],
        """SELECT sensor_id, pos, CASE WHEN abs(round(zscore_15, 6)) > 2.5 THEN 1 ELSE 0 END AS pred
           FROM zscores WHERE roll_mean_60 IS NOT NULL""",
    ),
)
def rule(spark, sf):
    rows = clean.drop_incomplete(feature_store(spark, sf), features.FEATURES)
    rows = rows.withColumn("zscore_15", F.round("zscore_15", 6))
    return rows.select("sensor_id", "pos", scoring.zscore_rule(k=2.5).alias("pred"))


@query(
    "model_scores",
    with_ctes(["scores"], "SELECT model, sensor_id, pos, split, label, score + 0.0::DOUBLE AS score FROM scores"),
)
def scores_long(spark, sf):
    return model_scores(spark, sf).select("model", "sensor_id", "pos", "split", "label", "score")


@query("threshold_sweep_linear", with_ctes(["linear_sweep"], f"SELECT {SWEEP_COLUMNS} FROM linear_sweep"))
def sweep_linear(spark, sf):
    rows = validation(spark, sf)
    swept = thresholds.sweep(rows, ["model"], thresholds.linear_grid(rows, ["model"]))
    return swept.select("model", "k", "tp", "predicted", "positives", r("threshold").alias("threshold"), r("f1").alias("f1"))


@query("threshold_linear", with_ctes(["linear_best"], f"SELECT {BEST_COLUMNS} FROM linear_best"))
def threshold_linear(spark, sf):
    return best_rounded(thresholds.best_linear(validation(spark, sf), ["model"]))


WIDE = (200, 1000)


@query(
    "threshold_sweep_wide",
    with_ctes(
        ["scores"],
        f"""SELECT model, n AS points, k, {rsql("t", "threshold")}, tp, predicted, {rsql("f1", "f1")} FROM (
              SELECT *, CASE WHEN positives + predicted = 0 THEN 0 ELSE 2 * tp / (positives + predicted)::DOUBLE END AS f1 FROM (
                SELECT g.model, g.n, g.k, g.t, count(*) FILTER (score > t AND label = 1) AS tp,
                       count(*) FILTER (score > t) AS predicted, count(*) FILTER (label = 1) AS positives
                FROM (SELECT model, n, k, CASE WHEN k = n - 1 THEN hi ELSE k * ((hi - lo) / (n - 1)::DOUBLE) + lo END AS t
                      FROM (SELECT model, min(score) AS lo, max(score) AS hi FROM scores WHERE split = 'val' GROUP BY 1),
                           (SELECT n, unnest(range(0, n)) AS k FROM (VALUES {", ".join(f"({n})" for n in WIDE)}) v(n))) g
                JOIN scores s ON s.model = g.model AND s.split = 'val' GROUP BY 1, 2, 3, 4))""",
    ),
)
def threshold_sweep_wide(spark, sf):
    """Every point of grids that are wider than 127 thresholds."""
    scores, keys = validation(spark, sf), ["model"]
    parts = [
        thresholds.sweep(scores, keys, thresholds.linear_grid(scores, keys, n)).withColumn("points", F.lit(n)) for n in WIDE
    ]
    rows = parts[0].unionByName(parts[1])
    return rows.select("model", "points", "k", r("threshold").alias("threshold"), "tp", "predicted", r("f1").alias("f1"))


@query("threshold_k_grid", with_ctes(["fixed_best"], f"SELECT {BEST_COLUMNS} FROM fixed_best"))
def threshold_fixed(spark, sf):
    return best_rounded(chosen(spark, sf))


def percentile_sql(side: str, fallback_k: int) -> str:
    """The fallback point is swept too, so it is left out of the choice and joined back."""
    return with_ctes(
        [f"{side}_sweep"],
        f""", pick AS (SELECT * FROM {side}_sweep WHERE k < {fallback_k}
                     QUALIFY row_number() OVER (PARTITION BY model ORDER BY f1 DESC, k) = 1)
        SELECT model, {rsql('CASE WHEN p.f1 > 0 THEN p.threshold ELSE b.t END', 'threshold')},
               {rsql('p.precision * (p.f1 > 0)::INT', 'precision')}, {rsql('p.recall * (p.f1 > 0)::INT', 'recall')}, {rsql('p.f1', 'f1')}
        FROM pick p JOIN (SELECT model, t FROM {side}_points WHERE k = {fallback_k}) b USING (model)""",
    )


@query("threshold_upper_percentile", percentile_sql("upper", 100))
def threshold_upper(spark, sf):
    return best_rounded(thresholds.best_percentile(validation(spark, sf), ["model"]))


@query("threshold_lower_percentile", percentile_sql("lower", 50))
def threshold_lower(spark, sf):
    return best_rounded(thresholds.best_percentile(validation(spark, sf), ["model"], below=True))


@query(
    "exact_quantiles",
    """SELECT event_type AS sensor_id, unnest([0.0::DOUBLE, 0.01, 0.25, 0.5, 0.95, 0.999, 1.0]) AS prob,
              round(unnest(quantile_cont(value, [0.0::DOUBLE, 0.01, 0.25, 0.5, 0.95, 0.999, 1.0])), 6) + 0.0::DOUBLE AS quantile
       FROM events GROUP BY 1""",
)
def quantiles(spark, sf):
    from tidewatch.sources.series import event_readings

    found = exact_quantiles(event_readings(spark, sf), ["sensor_id"], "value", [0.0, 0.01, 0.25, 0.5, 0.95, 0.999, 1.0])
    return found.select("sensor_id", "prob", r("quantile").alias("quantile"))


@query(
    "confusion",
    with_ctes(
        ["preds"],
        """SELECT model, count(*) FILTER (label = 1 AND pred = 1) AS tp, count(*) FILTER (label = 0 AND pred = 0) AS tn,
                  count(*) FILTER (label = 0 AND pred = 1) AS fp, count(*) FILTER (label = 1 AND pred = 0) AS fn
           FROM preds GROUP BY 1""",
    ),
)
def confusion(spark, sf):
    return evaluate.confusion(predicted(spark, sf))


fragment(
    "points",
    """SELECT model, tp, tn, fp, fn, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp)::DOUBLE END AS precision,
              CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn)::DOUBLE END AS recall,
              CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn)::DOUBLE END AS f1,
              fp / (fp + tn + 1e-9) AS false_alarm_rate
       FROM (SELECT model, count(*) FILTER (label = 1 AND pred = 1) AS tp, count(*) FILTER (label = 0 AND pred = 0) AS tn,
                    count(*) FILTER (label = 0 AND pred = 1) AS fp, count(*) FILTER (label = 1 AND pred = 0) AS fn
             FROM preds GROUP BY 1)""",
    "preds",
)
POINTS = ("precision", "recall", "f1", "false_alarm_rate")


@query("point_metrics", with_ctes(["points"], f"SELECT model, tp, tn, fp, fn, {', '.join(rsql(c, c) for c in POINTS)} FROM points"))
def points(spark, sf):
    out = evaluate.point_metrics(predicted(spark, sf))
    return out.select("model", "tp", "tn", "fp", "fn", *[r(c).alias(c) for c in POINTS])


fragment(
    "ranked",
    """SELECT model, score, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp,
              sum(pos) OVER (PARTITION BY model) AS positives, sum(neg) OVER (PARTITION BY model) AS negatives
       FROM (SELECT model, score, sum(label) AS pos, sum(1 - label) AS neg FROM preds GROUP BY 1, 2)
       WINDOW w AS (PARTITION BY model ORDER BY score DESC)""",
    "preds",
)
fragment(
    "curve",
    """SELECT model, score AS threshold, tp / (tp + fp)::DOUBLE AS precision, tp / positives::DOUBLE AS recall,
              fp / negatives::DOUBLE AS false_positive_rate FROM ranked""",
    "ranked",
)
fragment(
    "areas",
    """SELECT c.model, any_value(a.roc_auc) AS roc_auc, sum(step) AS pr_auc
       FROM (SELECT model, (recall - lag(recall, 1, 0) OVER o) * (precision + lag(precision, 1, 1) OVER o) / 2 AS step
             FROM curve WINDOW o AS (PARTITION BY model ORDER BY threshold DESC)) c
       JOIN (SELECT p.model, avg(CASE WHEN p.score > n.score THEN 1.0::DOUBLE WHEN p.score = n.score THEN 0.5::DOUBLE ELSE 0 END) AS roc_auc
             FROM preds p JOIN preds n ON p.model = n.model AND p.label = 1 AND n.label = 0 GROUP BY 1) a USING (model)
       GROUP BY 1""",
    "curve",
)


@query("rank_metrics", with_ctes(["areas"], f"SELECT model, {rsql('roc_auc', 'roc_auc')}, {rsql('pr_auc', 'pr_auc')} FROM areas"))
def areas(spark, sf):
    out = evaluate.rank_metrics(predicted(spark, sf))
    return out.select("model", r("roc_auc").alias("roc_auc"), r("pr_auc").alias("pr_auc"))


CURVE = ("threshold", "precision", "recall", "false_positive_rate")


@query("pr_roc_curves", with_ctes(["curve"], f"SELECT model, {', '.join(rsql(c, c) for c in CURVE)} FROM curve"))
def curve_points(spark, sf):
    return evaluate.curves(predicted(spark, sf)).select("model", *[r(c).alias(c) for c in CURVE])


def run_sql(flag: str) -> str:
    """Gaps and islands by the difference of two row numbers."""
    return f"""SELECT *, row_number() OVER (PARTITION BY model, sensor_id ORDER BY pos)
                      - row_number() OVER (PARTITION BY model, sensor_id, {flag} ORDER BY pos) AS island FROM preds"""


fragment("label_runs", run_sql("label"), "preds")
fragment("pred_runs", run_sql("pred"), "preds")
fragment(
    "windows",
    """SELECT model, sensor_id, min(pos) AS window_start, count(*) AS length, max(pred) AS detected,
              min(CASE WHEN pred = 1 THEN pos END) AS first_hit
       FROM label_runs WHERE label = 1 GROUP BY model, sensor_id, island""",
    "label_runs",
)
fragment(
    "segments",
    """SELECT model, sensor_id, min(pos) AS segment_start, count(*) AS length, max(label) AS touches
       FROM pred_runs WHERE pred = 1 GROUP BY model, sensor_id, island""",
    "pred_runs",
)


@query("anomaly_windows", with_ctes(["windows"], "SELECT * FROM windows"))
def windows(spark, sf):
    return evaluate.true_windows(predicted(spark, sf))


@query("predicted_segments", with_ctes(["segments"], "SELECT * FROM segments"))
def segments(spark, sf):
    return evaluate.predicted_segments(predicted(spark, sf))


def window_fragment(name: str, missed: str) -> None:
    fragment(
        name,
        f"""SELECT model, window_precision, window_recall, detection_latency_min,
                   CASE WHEN window_precision + window_recall = 0 THEN 0
                        ELSE 2 * window_precision * window_recall / (window_precision + window_recall) END AS window_f1
            FROM (SELECT model, avg(detected::DOUBLE) AS window_recall,
                         avg(5.0::DOUBLE * coalesce(first_hit - window_start, {missed})) AS detection_latency_min
                  FROM windows w GROUP BY 1)
            JOIN (SELECT model, avg(touches::DOUBLE) AS window_precision FROM segments GROUP BY 1) USING (model)""",
        "windows",
        "segments",
    )


window_fragment("window_rows", "length")
window_fragment(
    "window_rows_legacy",
    """(SELECT count(*) FROM preds p WHERE p.model = w.model AND p.sensor_id = w.sensor_id
        AND p.label = 1 AND p.pos >= w.window_start)""",
)
WINDOWED = ("window_precision", "window_recall", "window_f1", "detection_latency_min")
WINDOWED_SQL = ", ".join(rsql(c, c) for c in WINDOWED)


@query("window_metrics", with_ctes(["window_rows"], f"SELECT model, {WINDOWED_SQL} FROM window_rows"))
def windowed(spark, sf):
    return evaluate.window_metrics(predicted(spark, sf)).select("model", *[r(c).alias(c) for c in WINDOWED])


@query("window_metrics_legacy", with_ctes(["preds", "window_rows_legacy"], f"SELECT model, {WINDOWED_SQL} FROM window_rows_legacy"))
def windowed_legacy(spark, sf):
    out = evaluate.window_metrics(predicted(spark, sf), legacy=True)
    return out.select("model", *[r(c).alias(c) for c in WINDOWED])


fragment("evaluated", "SELECT * FROM points JOIN areas USING (model) JOIN window_rows USING (model)", "points", "areas", "window_rows")
fragment(
    "ranked_models",
    "SELECT *, row_number() OVER (ORDER BY pr_auc DESC, detection_latency_min, model) AS rank FROM evaluated",
    "evaluated",
)
ALL = (*POINTS, "roc_auc", "pr_auc", *WINDOWED)


@query("evaluation", with_ctes(["evaluated"], f"SELECT model, tp, tn, fp, fn, {', '.join(rsql(c, c) for c in ALL)} FROM evaluated"))
def evaluated(spark, sf):
    out = evaluate.evaluation(predicted(spark, sf))
    return out.select("model", "tp", "tn", "fp", "fn", *[r(c).alias(c) for c in ALL])


@query(
    "model_comparison",
    with_ctes(
        ["ranked_models"],
        "SELECT rank, model AS name, replace(lower(model), ' ', '_') AS slug, tp, tn, fp, fn, "
        + ", ".join(rsql(c, c, 4) for c in (*POINTS, "roc_auc", "pr_auc", *WINDOWED[:3]))
        + f", {rsql('detection_latency_min', 'detection_latency_min', 2)} FROM ranked_models",
    ),
)
def compared(spark, sf):
    return evaluate.comparison(evaluate.rank_models(evaluate.evaluation(predicted(spark, sf))))


CHART = ("precision", "recall", "f1", "pr_auc", "false_alarm_rate")


@query(
    "metrics_long",
    with_ctes(
        ["evaluated"],
        "SELECT * FROM ("
        + " UNION ALL ".join(
            f"SELECT model, '{c}' AS metric, {rsql(c, 'value')}, "
            + (
                f"CASE WHEN {c} < 0.1 THEN 'low' WHEN {c} < 0.3 THEN 'medium' ELSE 'high' END"
                if c == "false_alarm_rate"
                else "NULL::VARCHAR"
            )
            + " AS band FROM evaluated"
            for c in CHART
        )
        + ")",
    ),
)
def chart_rows(spark, sf):
    out = evaluate.metrics_long(evaluate.evaluation(predicted(spark, sf)), list(CHART))
    return out.withColumn("value", r("value"))


def stats_list(spark: SparkSession, sf: str) -> list[tuple[str, float, float]]:
    """The baseline table as literals: one row per contract feature (22)."""

    def build() -> DataFrame:
        rows = clean.drop_incomplete(splits.normal_rows(feature_store(spark, sf)), features.FEATURES)
        return features.baseline_stats(rows)

    table = stored(spark, sf, "baseline", build).collect()
    return [(s["feature"], s["mean"], s["std"]) for s in sorted(table, key=lambda s: s["ord"])]


@query(
    "explain_anomaly",
    with_ctes(
        ["features"],
        ", stats AS (SELECT * FROM ("
        + " UNION ALL ".join(
            f"SELECT '{c}' AS feature, avg({c}) AS mean, stddev_samp({c}) AS std, {i} AS ord FROM features "
            "WHERE split = 'train' AND label = 0 AND roll_mean_60 IS NOT NULL"
            for i, c in enumerate(features.FEATURES)
        )
        + ")), long AS ("
        + " UNION ALL ".join(
            f"SELECT sensor_id, pos, '{c}' AS feature, {c} AS v FROM features WHERE split = 'test'" for c in features.FEATURES
        )
        + """)
        SELECT sensor_id, pos, feature, round(deviation, 4) + 0.0::DOUBLE AS deviation,
               printf('''%s'' is %.1f std devs from baseline (%.3f vs normal %.3f). Rec: monitor system.', feature, deviation, v, mean) AS reason
        FROM (SELECT sensor_id, pos, feature, v, mean, abs(v - mean) / (std + 1e-9) AS deviation, ord FROM long JOIN stats USING (feature))
        QUALIFY row_number() OVER (PARTITION BY sensor_id, pos ORDER BY deviation DESC, ord) = 1""",
    ),
)
def explained(spark, sf):
    rows = feature_store(spark, sf).where(F.col("split") == "test")
    out = scoring.explain(rows, stats_list(spark, sf))
    return out.select("sensor_id", "pos", "feature", F.round("deviation", 4).alias("deviation"), "reason")


@query(
    "ensemble_vote",
    with_ctes(
        ["zscores"],
        """SELECT sensor_id, pos, votes, 3 AS total_models, round(votes / 3.0::DOUBLE, 6) + 0.0::DOUBLE AS ensemble_confidence,
                  votes >= 1.5 AS is_anomaly, printf('%d of %d agree → anomaly, %.0f%%', votes, 3, votes / 3.0::DOUBLE * 100) AS message,
                  n_scored
           FROM (SELECT sensor_id, pos,
                        (coalesce(round(abs(zscore_5), 6) > 1.5, false))::INT + (coalesce(round(abs(zscore_15), 6) > 2.0, false))::INT
                        + (coalesce(round(abs(zscore_60), 6) > 2.5, false))::INT AS votes,
                        (zscore_5 IS NOT NULL)::INT + (zscore_15 IS NOT NULL)::INT + (zscore_60 IS NOT NULL)::INT AS n_scored
                 FROM zscores)""",
    ),
)
def voted(spark, sf):
    """Warm-up rows lack a score of the long windows: no vote, but still in the total."""
    rows = feature_store(spark, sf).select(
        "sensor_id", "pos", *[F.round(F.abs(F.col(m)), 6).alias(m) for m in MODELS]
    )
    limits = {"zscore_5": 1.5, "zscore_15": 2.0, "zscore_60": 2.5}
    out = scoring.ensemble_vote(rows, {m: (m, limits[m]) for m in MODELS})
    return out.select(
        "sensor_id",
        "pos",
        "votes",
        "total_models",
        r("ensemble_confidence").alias("ensemble_confidence"),
        "is_anomaly",
        "message",
        F.size("model_details").alias("n_scored"),
    )


@query(
    "recommendation",
    """SELECT event_type || '_' || CASE CAST(json_extract_string(props, '$.k') AS INT) % 6 WHEN 0 THEN 'value' WHEN 1 THEN 'rate'
              WHEN 2 THEN 'diff' WHEN 3 THEN 'RMS' WHEN 4 THEN 'kurtosis' ELSE 'lag' END AS feature,
              CASE CAST(json_extract_string(props, '$.k') AS INT) % 6 WHEN 0 THEN 'inspect cooling / thermal sensors'
                   WHEN 1 THEN 'check for sudden mechanical shocks or sensor dropouts'
                   WHEN 2 THEN 'check for sudden mechanical shocks or sensor dropouts'
                   WHEN 3 THEN 'inspect bearing for degradation' WHEN 4 THEN 'inspect bearing for degradation'
                   ELSE 'monitor system' END AS action, count(*) AS n
       FROM events GROUP BY 1, 2""",
)
def recommended(spark, sf):
    from tidewatch.sources.series import table

    k = F.get_json_object("props", "$.k").cast("int") % 6
    suffix = F.element_at(F.array(*[F.lit(s) for s in ("value", "rate", "diff", "RMS", "kurtosis", "lag")]), k + 1)
    named = table(spark, sf, "events").select(F.concat("event_type", F.lit("_"), suffix).alias("feature"))
    return named.groupBy("feature", scoring.recommendation(F.col("feature"), F.lit("")).alias("action")).agg(
        F.count("*").alias("n")
    )


@query(
    "decide_with_fallbacks",
    """SELECT event_id, round(CASE WHEN value < 1 OR k < 5 THEN 0 ELSE score END, 6) + 0.0::DOUBLE AS anomaly_score,
              NOT (value < 1 OR k < 5) AND score > 1.0 AS is_anomaly,
              CASE WHEN value < 1 OR k < 5 OR score <= 1.0 THEN 'none' WHEN score - 1.0 < 1 THEN 'low'
                   WHEN score - 1.0 < 3 THEN 'medium' ELSE 'high' END AS severity,
              CASE WHEN value < 1 THEN 'Missing value injected' WHEN k < 5 THEN 'Model or features not loaded'
                   WHEN score > 1.0 THEN 'above limit' ELSE 'Normal operation' END AS reason,
              CASE WHEN value < 1 OR k < 5 THEN 'none' ELSE 'zscore' END AS model
       FROM (SELECT event_id, value, CAST(json_extract_string(props, '$.k') AS INT) AS k, value / 50.0::DOUBLE AS score FROM events)""",
)
def decided(spark, sf):
    """Readings below 1 count as missing, rows with k < 5 as unscored."""
    from tidewatch.sources.series import table

    rows = table(spark, sf, "events").select(
        "event_id",
        F.when(F.col("value") >= 1, F.col("value")).alias("value"),
        F.when(F.get_json_object("props", "$.k").cast("int") >= 5, F.col("value") / 50.0).alias("score"),
    )
    out = scoring.decide(rows, F.lit(1.0), F.lit("zscore"), F.lit("above limit"))
    return out.select("event_id", r("anomaly_score").alias("anomaly_score"), "is_anomaly", "severity", "reason", "model")


SERVING_K = 2.5


def anomalous_readings(features_: DataFrame, stats: list[tuple[str, float, float]]) -> DataFrame:
    """Scored rows by the 15-step rule with severity and reason; only the anomalies."""
    scored = features_.withColumn("score", F.round(F.abs("zscore_15"), 6))
    explained = scoring.explain(scored, stats).withColumnRenamed("reason", "why")
    decided = scoring.decide(explained, F.lit(SERVING_K), F.lit("rolling_zscore"), F.col("why"))
    return decided.where("is_anomaly").select(
        "sensor_id", "pos", "ts", "value", "anomaly_score", "severity", "feature", "reason", "model"
    )


@query(
    "anomalous_readings",
    with_ctes(
        ["zscores"],
        """SELECT sensor_id, pos, ts, round(value, 6) + 0.0::DOUBLE AS value, round(abs(zscore_15), 6) AS anomaly_score,
                  CASE WHEN round(abs(zscore_15), 6) - 2.5 < 1 THEN 'low' WHEN round(abs(zscore_15), 6) - 2.5 < 3 THEN 'medium' ELSE 'high' END AS severity,
                  'rolling_zscore' AS model
           FROM zscores WHERE round(abs(zscore_15), 6) > 2.5""",
    ),
)
def anomalous(spark, sf):
    """Which five-minute readings are anomalous, per sensor."""
    out = anomalous_readings(feature_store(spark, sf), stats_list(spark, sf))
    return out.select("sensor_id", "pos", "ts", r("value").alias("value"), "anomaly_score", "severity", "model")
