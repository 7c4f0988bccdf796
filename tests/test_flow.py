"""A CSV series from file to evaluation, as a user would write it."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidewatch.operators import alerts, clean, evaluate, features, scoring, splits, thresholds
from tidewatch.operators.detectors import isolation
from tidewatch.sources import files
from tidewatch.sources.series import read_series_csv


def test_csv_to_alerts(spark, tmp_path):
    n = 4000
    rng = np.random.default_rng(0)
    value = 80 + np.sin(np.arange(n) / 40) * 3 + rng.normal(size=n)
    value[2900:2960] += 25  # validation anomaly
    value[3600:3680] += 25  # test anomaly
    ts = pd.date_range("2014-01-01", periods=n, freq="5min")
    frame = pd.DataFrame({"timestamp": ts, "value": value}).drop(index=[100, 101, 500])
    frame.to_csv(tmp_path / "machine.csv", index=False)

    raw = read_series_csv(spark, str(tmp_path / "machine.csv"))
    raw = clean.attach_sensor(raw, "machine").withColumnRenamed("timestamp", "ts")
    grid = clean.to_grid(raw.withColumn("seq", F.unix_seconds("ts")))
    windows = [(str(ts[2900]), str(ts[2959])), (str(ts[3600]), str(ts[3679]))]
    rows = splits.chronological_split(splits.label_windows(grid, windows))
    scaled = splits.apply_scaler(rows, splits.fit_scaler(splits.burn_in(rows)))
    table = features.rolling_features(scaled)
    paths = files.write_processed(table, str(tmp_path / "out"))
    table = clean.drop_incomplete(spark.read.parquet(paths["processed"]), features.FEATURES)
    assert table.count() == n - 59

    train = splits.normal_rows(table)
    model = isolation.fit(train, features.FEATURES, ["sensor_id", "pos"], trees=100)
    scored = model.transform(table).withColumn("model", F.lit("isolation_forest"))
    limit = thresholds.best_linear(scored.where("split = 'val'"), ["model"]).first()["threshold"]
    preds = scored.where("split = 'test'").withColumn("pred", (F.col("score") > limit).cast("int"))
    result = evaluate.evaluation(preds).first()
    assert result["roc_auc"] > 0.95 and result["f1"] > 0.8 and result["window_recall"] == 1.0

    stats = [(s["feature"], s["mean"], s["std"]) for s in features.baseline_stats(train).orderBy("ord").collect()]
    explained = scoring.explain(scored.where("split = 'test'"), stats).withColumnRenamed("reason", "why")
    decided = scoring.decide(explained, F.lit(limit), F.lit("isolation_forest"), F.col("why"))
    hits = alerts.derive_alerts(decided.withColumn("id", F.col("pos")))
    assert hits.count() == preds.where("pred = 1").count()
    assert hits.where("reason like '%std devs from baseline%'").count() == hits.count()
