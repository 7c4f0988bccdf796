"""Point-wise, rank-based and window-wise evaluation.

Input rows: model, sensor_id, pos, label, score, pred. All results are grouped
by `keys` (default: model), so any number of models is evaluated in one go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewatch.operators.clean import CHUNK, floor_div
from tidewatch.operators.scan import add_bucket, running_total, runs

KEYS = ["model"]
MINUTES_PER_STEP = 5.0
EPS = 1e-9


def ratio(num: Column, den: Column, empty: float = 0.0) -> Column:
    return F.when(den == 0, F.lit(empty)).otherwise(num / den)


def confusion(scores: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    hit, pred = F.col("label") == 1, F.col("pred") == 1
    return scores.groupBy(*keys).agg(
        F.count_if(hit & pred).alias("tp"),
        F.count_if(~hit & ~pred).alias("tn"),
        F.count_if(~hit & pred).alias("fp"),
        F.count_if(hit & ~pred).alias("fn"),
    )


def point_metrics(scores: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return confusion(scores, keys).withColumns(
        {
            "precision": ratio(tp, tp + fp),
            "recall": ratio(tp, tp + fn),
            "f1": ratio(2 * tp, 2 * tp + fp + fn),
            "false_alarm_rate": fp / (fp + tn + F.lit(EPS)),
        }
    )


def ranked_counts(scores: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Per distinct score, from high to low: cumulative tp and fp, and class totals.

    Equal scores collapse on the map side, then balanced score buckets are
    summed locally and shifted by the totals of the buckets above.
    """
    tied = scores.groupBy(*keys, "score").agg(
        F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg")
    )
    placed = add_bucket(
        tied, keys, "score", [F.sum("pos").alias("positives"), F.sum("neg").alias("negatives")]
    )
    return running_total(
        placed, keys, "bucket", [F.col("score").desc()], {"tp": F.col("pos"), "fp": F.col("neg")}, descending=True
    ).drop("bucket")


def rank_metrics(scores: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """ROC-AUC with ties at one half; PR-AUC as a trapezoid closed at (recall 0, precision 1).

    With a single class both are undefined: 0.5 and 0.
    """
    tp, fp, pos, neg = (F.col(c) for c in ("tp", "fp", "pos", "neg"))
    before_tp, before_fp = tp - pos, fp - neg
    pairs = neg * (before_tp + pos / 2.0)
    precision, before = tp / (tp + fp), ratio(before_tp, before_tp + before_fp, 1.0)
    area = pos * (precision + before) / 2.0
    sums = ranked_counts(scores, keys).groupBy(*keys).agg(
        F.sum(pairs).alias("pairs"),
        F.sum(area).alias("area"),
        F.max("positives").alias("positives"),
        F.max("negatives").alias("negatives"),
    )
    both = (F.col("positives") > 0) & (F.col("negatives") > 0)
    return sums.select(
        *keys,
        F.when(both, F.col("pairs") / (F.col("positives") * F.col("negatives").cast("double"))).otherwise(0.5).alias("roc_auc"),
        F.when(both, F.col("area") / F.col("positives")).otherwise(0.0).alias("pr_auc"),
    )


def curves(scores: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """PR and ROC points, one per distinct score."""
    tp, fp = F.col("tp"), F.col("fp")
    return ranked_counts(scores, keys).select(
        *keys,
        F.col("score").alias("threshold"),
        (tp / (tp + fp)).alias("precision"),
        ratio(tp, F.col("positives")).alias("recall"),
        ratio(fp, F.col("negatives")).alias("false_positive_rate"),
    )


def true_windows(scores: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """One row per maximal run of label = 1."""
    own = [*keys, "sensor_id"]
    marked = runs(scores, own, "pos", F.col("label") == 1, "window_start")
    return (
        marked.where(F.col("window_start").isNotNull())
        .groupBy(*own, "window_start")
        .agg(
            F.count("*").alias("length"),
            F.max("pred").alias("detected"),
            F.min(F.when(F.col("pred") == 1, F.col("pos"))).alias("first_hit"),
        )
    )


def predicted_segments(scores: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """One row per maximal run of pred = 1; `touches` = contains a true anomaly."""
    own = [*keys, "sensor_id"]
    marked = runs(scores, own, "pos", F.col("pred") == 1, "segment_start")
    return (
        marked.where(F.col("segment_start").isNotNull())
        .groupBy(*own, "segment_start")
        .agg(F.count("*").alias("length"), F.max("label").alias("touches"))
    )


def window_latencies(windows: DataFrame, keys: list[str] = KEYS, legacy: bool = False) -> DataFrame:
    """Minutes from window start to first hit.

    A missed window counts its own length; legacy=True counts every positive
    from its start to the end of the sensor's series instead.
    """
    missed = F.col("length")
    if legacy:
        own = [*keys, "sensor_id"]
        grouped = windows.withColumn("_chunk", floor_div(F.col("window_start"), CHUNK))
        summed = running_total(grouped, own, "_chunk", [F.col("window_start")], {"upto": F.col("length")})
        totals = windows.groupBy(*own).agg(F.sum("length").alias("all_positives"))
        windows = summed.join(totals, own)
        missed = F.col("all_positives") - F.col("upto") + F.col("length")
    steps = F.coalesce(F.col("first_hit") - F.col("window_start"), missed)
    return windows.withColumn("latency_min", steps * F.lit(MINUTES_PER_STEP))


def window_metrics(scores: DataFrame, keys: list[str] = KEYS, legacy: bool = False) -> DataFrame:
    """Window precision, recall, F1 and mean detection latency."""
    windows = window_latencies(true_windows(scores, keys), keys, legacy)
    per_window = windows.groupBy(*keys).agg(
        F.count("*").alias("n_windows"),
        F.sum("detected").alias("hit_windows"),
        F.avg("latency_min").alias("latency"),
    )
    per_segment = predicted_segments(scores, keys).groupBy(*keys).agg(
        F.count("*").alias("n_segments"), F.sum("touches").alias("hit_segments")
    )
    joined = scores.select(*keys).distinct().join(per_window, keys, "left").join(per_segment, keys, "left")
    none = F.coalesce(F.col("n_windows"), F.lit(0)) == 0
    recall = F.col("hit_windows") / F.col("n_windows")
    precision = F.coalesce(F.col("hit_segments") / F.col("n_segments"), F.lit(0.0))
    return joined.select(
        *keys,
        F.when(none, 1.0).otherwise(precision).alias("window_precision"),
        F.when(none, 1.0).otherwise(recall).alias("window_recall"),
        F.when(none, 1.0).otherwise(ratio(2 * precision * recall, precision + recall)).alias("window_f1"),
        F.coalesce("latency", F.lit(0.0)).alias("detection_latency_min"),
    )


def evaluation(scores: DataFrame, keys: list[str] = KEYS, legacy: bool = False, ms_per_row: Column | None = None) -> DataFrame:
    """The whole evaluation row per model; cost columns only when a time was measured."""
    out = (
        point_metrics(scores, keys)
        .join(rank_metrics(scores, keys), keys)
        .join(window_metrics(scores, keys, legacy), keys)
    )
    if ms_per_row is not None:
        out = out.withColumn("avg_inference_ms", ms_per_row).withColumn(
            "throughput_rps", F.lit(1000.0) / (F.col("avg_inference_ms") + F.lit(EPS))
        )
    return out


def rank_models(results: DataFrame) -> DataFrame:
    """Best PR-AUC first, shorter latency on ties. One row per model, so one window."""
    order = W.orderBy(F.col("pr_auc").desc(), F.col("detection_latency_min").asc(), F.col("model"))
    return results.withColumn("rank", F.row_number().over(order))


def slug(name: Column) -> Column:
    return F.translate(F.lower(name), " -()", "__")


def comparison(ranked: DataFrame) -> DataFrame:
    """What the dashboard shows: slug and rounded metrics."""
    four = ["precision", "recall", "f1", "window_precision", "window_recall", "window_f1"]
    four += ["roc_auc", "pr_auc", "false_alarm_rate"]
    return ranked.select(
        "rank",
        F.col("model").alias("name"),
        slug(F.col("model")).alias("slug"),
        *[F.bround(c, 4).alias(c) for c in four],
        "tp",
        "tn",
        "fp",
        "fn",
        F.bround("detection_latency_min", 2).alias("detection_latency_min"),
    )


def metrics_long(ranked: DataFrame, metrics: list[str]) -> DataFrame:
    """(model, metric, value, band): chart form; bands grade the false alarm rate."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]))
    long = ranked.select("model", pairs.alias("p")).select("model", "p.metric", "p.value")
    band = F.when(F.col("value") < 0.1, "low").when(F.col("value") < 0.3, "medium").otherwise("high")
    return long.withColumn("band", F.when(F.col("metric") == "false_alarm_rate", band))
