import numpy as np
import pytest

from tidewatch.operators import evaluate, thresholds


def frame(spark, label, score=None, pred=None, model="m", sensor="s"):
    n = len(label)
    score = [0.0] * n if score is None else score
    pred = [0] * n if pred is None else pred
    rows = [(model, sensor, i, int(a), float(b), int(c)) for i, (a, b, c) in enumerate(zip(label, score, pred))]
    return spark.createDataFrame(rows, "model string, sensor_id string, pos bigint, label int, score double, pred int")


def brute_auc(label, score):
    pos, neg = score[label == 1], score[label == 0]
    roc = np.mean([(1.0 if p > n else 0.5 if p == n else 0.0) for p in pos for n in neg])
    points = [(0.0, 1.0)]
    for t in sorted(set(score), reverse=True):
        hit = score >= t
        tp = (hit & (label == 1)).sum()
        points.append((tp / (label == 1).sum(), tp / hit.sum()))
    pr = sum((r1 - r0) * (p1 + p0) / 2 for (r0, p0), (r1, p1) in zip(points, points[1:]))
    return roc, pr


def test_auc_with_ties(spark):
    rng = np.random.default_rng(0)
    label = (rng.random(300) < 0.2).astype(int)
    score = np.round(rng.normal(size=300) + label, 1)
    got = evaluate.rank_metrics(frame(spark, label, score)).first()
    roc, pr = brute_auc(label, score)
    assert got["roc_auc"] == pytest.approx(roc) and got["pr_auc"] == pytest.approx(pr)


def test_all_scores_equal_and_single_class(spark):
    same = evaluate.rank_metrics(frame(spark, [0, 1, 0, 1], [2.0] * 4)).first()
    assert (same["roc_auc"], same["pr_auc"]) == (0.5, 0.75)
    single = evaluate.rank_metrics(frame(spark, [0, 0, 0], [1.0, 2.0, 3.0])).first()
    assert (single["roc_auc"], single["pr_auc"]) == (0.5, 0.0)


def windows_of(spark, label, pred, **kw):
    r = evaluate.window_metrics(frame(spark, label, pred=pred), **kw).first()
    return (r["window_precision"], r["window_recall"], r["window_f1"], r["detection_latency_min"])


def test_window_metrics_edges(spark):
    assert windows_of(spark, [0, 0, 0], [0, 1, 0]) == (1.0, 1.0, 1.0, 0.0)  # no true window
    assert windows_of(spark, [0, 1, 1], [0, 0, 0]) == (0.0, 0.0, 0.0, 10.0)  # no segment: own length
    label, pred = [1, 1, 1, 0, 1, 1, 0, 0], [0, 0, 1, 0, 0, 0, 1, 0]
    assert windows_of(spark, label, pred) == (0.5, 0.5, 0.5, 10.0)
    # the missed second window is the last one, so both rules agree
    assert windows_of(spark, label, pred, legacy=True)[3] == 10.0
    label, pred = [1, 1, 0, 1, 1, 1, 0], [0, 0, 0, 1, 0, 0, 0]
    assert windows_of(spark, label, pred)[3] == 5.0  # (10 + 0) / 2
    assert windows_of(spark, label, pred, legacy=True)[3] == 12.5  # (25 + 0) / 2


def test_windows_end_at_sensor_borders(spark):
    df = frame(spark, [0, 1], pred=[0, 1]).unionByName(frame(spark, [1, 0], pred=[0, 0], sensor="t"))
    assert evaluate.true_windows(df).count() == 2


def test_undefined_point_metrics_are_zero(spark):
    r = evaluate.point_metrics(frame(spark, [0, 0], pred=[0, 0])).first()
    assert (r["precision"], r["recall"], r["f1"], r["tn"]) == (0.0, 0.0, 0.0, 2)


def test_evaluation_ranks_and_compares(spark):
    good = frame(spark, [0, 0, 1, 1], [0.1, 0.2, 0.8, 0.9], [0, 0, 1, 1], model="Good One (A-B)")
    bad = frame(spark, [0, 0, 1, 1], [0.9, 0.2, 0.1, 0.4], [1, 0, 0, 0], model="bad")
    import pyspark.sql.functions as F

    ranked = evaluate.rank_models(evaluate.evaluation(good.unionByName(bad), ms_per_row=F.lit(0.5)))
    rows = {r["rank"]: r for r in ranked.collect()}
    assert rows[1]["model"] == "Good One (A-B)" and rows[1]["throughput_rps"] == pytest.approx(2000, rel=1e-6)
    assert evaluate.comparison(ranked).where("rank = 1").first()["slug"] == "good_one_a_b"
    bands = {(r["model"], r["band"]) for r in evaluate.metrics_long(ranked, ["false_alarm_rate"]).collect()}
    assert bands == {("Good One (A-B)", "low"), ("bad", "high")}


def brute_best(label, score, grid, below=False):
    best = (-1.0, None)
    for t in grid:
        pred = score < t if below else score > t
        tp, total = (pred & (label == 1)).sum(), pred.sum() + (label == 1).sum()
        f1 = 2 * tp / total if total else 0.0
        if f1 > best[0]:
            best = (f1, t)
    return best


@pytest.mark.parametrize("shift", [0.0, 1.5])
def test_threshold_grids_equal_brute_force(spark, shift):
    rng = np.random.default_rng(4)
    label = (rng.random(400) < 0.15).astype(int)
    score = rng.normal(size=400) + shift * label
    df = frame(spark, label, score)
    got = thresholds.best_linear(df, ["model"]).first()
    f1, t = brute_best(label, score, np.linspace(score.min(), score.max(), 100))
    assert got["f1"] == pytest.approx(f1) and got["threshold"] == pytest.approx(t)
    got = thresholds.best_of_fixed(df, ["model"]).first()
    f1, t = brute_best(label, score, np.linspace(1, 6, 51))
    assert got["f1"] == pytest.approx(f1) and got["threshold"] == pytest.approx(t)
    for below, (a, b, n, _) in ((False, thresholds.UPPER_PERCENTILES), (True, thresholds.LOWER_PERCENTILES)):
        values = -score if below else score
        f1, t = brute_best(label, values, np.percentile(values, np.linspace(a, b, n)), below)
        got = thresholds.best_percentile(frame(spark, label, values), ["model"], below).first()
        assert got["f1"] == pytest.approx(f1) and got["threshold"] == pytest.approx(t)


def test_percentile_fallback(spark):
    score = np.arange(200.0)
    df = frame(spark, np.zeros(200, dtype=int), score)
    up, low = (thresholds.best_percentile(df, ["model"], below).first() for below in (False, True))
    assert up["threshold"] == pytest.approx(np.percentile(score, 95)) and up["f1"] == 0
    assert low["threshold"] == pytest.approx(np.percentile(score, 1))


def test_midpoint(spark):
    r = thresholds.midpoint(frame(spark, [0, 0, 1, 1], [1.0, 3.0, 6.0, 8.0]), ["model"]).first()
    assert (r["good_mean"], r["defect_mean"], r["threshold"]) == (2.0, 7.0, 4.5)


@pytest.mark.parametrize("points", [100, 127, 128, 200, 1000])
def test_sweeps_of_any_width(spark, points):
    import random

    from tidewatch.operators import thresholds

    rng = random.Random(2)
    rows = [("m", rng.gauss(2.0 if i < 100 else 0.0, 0.4), int(i < 100)) for i in range(1000)]
    scores = spark.createDataFrame(rows, "model string, score double, label int")
    swept = thresholds.sweep(scores, ["model"], thresholds.linear_grid(scores, ["model"], points)).collect()
    assert len(swept) == points
    for r in swept:
        assert r["predicted"] == sum(s > r["threshold"] for _, s, _ in rows)
        assert r["tp"] == sum(s > r["threshold"] and label for _, s, label in rows)
    assert max(r["f1"] for r in swept) > 0.95
