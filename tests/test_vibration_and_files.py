import base64
import json
import tempfile
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch import schemas
from tidewatch.operators import embeddings, vibration
from tidewatch.sources import files, series


def signals(spark, *arrays):
    rows = [(i, [float(v) for v in a]) for i, a in enumerate(arrays)]
    return spark.createDataFrame(rows, "id bigint, signal array<double>")


def by_numpy(x, rate=20000.0):
    power = np.abs(np.fft.rfft(x)) ** 2
    freq = np.fft.rfftfreq(len(x), 1 / rate)
    total = power.sum() + 1e-9
    p = power / total
    p = p[p > 0]
    m = x.mean()
    return {
        "rms": np.sqrt((x**2).mean()), "peak": np.abs(x).max(), "variance": x.var(),
        "kurtosis": ((x - m) ** 4).mean() / x.var() ** 2, "skewness": ((x - m) ** 3).mean() / x.var() ** 1.5,
        "dominant_freq": freq[power.argmax()], "spectral_centroid": (freq * power).sum() / total,
        "spectral_entropy": -(p * np.log2(p)).sum(), "total_power": total,
    }


def test_features_equal_numpy(spark):
    x = np.random.default_rng(0).normal(size=256)
    df = signals(spark, x)
    got, want = vibration.snapshot_features(df, ["id"]).first(), by_numpy(x)
    long = vibration.time_features(vibration.long_form(df, ["id"]), ["id"]).first()
    for name, value in want.items():
        assert got[name] == pytest.approx(value, rel=1e-9), name
        if name in vibration.TIME_FEATURES:
            assert long[name] == pytest.approx(value, rel=1e-9), name


def test_sine_constant_and_empty(spark):
    n = np.arange(200)
    sine = np.sin(2 * np.pi * 1000 * n / 20000)
    out = {r["id"]: r for r in vibration.snapshot_features(signals(spark, sine, np.full(200, 2.0), []), ["id"]).collect()}
    assert set(out) == {0, 1}
    assert out[0]["dominant_freq"] == 1000 and out[0]["spectral_entropy"] == pytest.approx(0, abs=1e-6)
    assert out[1]["dominant_freq"] == 0 and out[1]["kurtosis"] is None and out[1]["crest_factor"] == pytest.approx(1)


def test_waveform_and_spectrum(spark):
    df = signals(spark, np.arange(1600.0), np.arange(30.0))
    thin = df.select(vibration.thin_waveform(F.col("signal"))).collect()
    assert thin[0][0] == list(np.arange(0, 1600, 3.0)) and thin[1][0] == list(np.arange(30.0))
    head = vibration.spectrum_head(vibration.power_spectrum(F.col("signal")), F.size("signal"))
    bins = df.select(head.alias("h")).collect()
    assert len(bins[0]["h"]) == 200 and len(bins[1]["h"]) == 16
    assert bins[1]["h"][1]["magnitude"] == pytest.approx(abs(np.fft.rfft(np.arange(30.0))[1]))
    assert bins[1]["h"][1]["frequency"] == pytest.approx(20000 / 30)


def test_degradation_is_found(spark):
    """A worn bearing adds shocks, which moves every feature."""
    rng = np.random.default_rng(1)
    n = np.arange(256)
    arrays = [np.sin(2 * np.pi * 1000 * n / 20000) + rng.normal(size=256) * 0.05 for _ in range(70)]
    for x in arrays[60:]:
        x[::37] += 12.0
    rows = vibration.index_snapshots(vibration.snapshot_features(signals(spark, *arrays), ["id"]), "id")
    scaled, model = vibration.fit_degradation(rows, normal=50)
    scored = vibration.score_snapshots(scaled, model)
    assert scored.where("id >= 60").agg(F.min("anomaly_score")).first()[0] > 0
    assert scored.where("is_normal = 1 and is_anomaly").count() <= 1
    assert vibration.score_range(scored).first()["test_samples"] == 20
    assert vibration.score_snapshots(scaled, None).where("is_anomaly or anomaly_score <> 0").count() == 0
    assert sorted(r["file_index"] for r in vibration.strided(rows, 70, 30).collect()) == list(range(35))


def test_snapshot_files(spark, tmp_path):
    for name, cell in (("2004.02.12.10.32.39", "1.5"), ("2004.02.12.10.42.39", "x"), ("2004.02.12.10.52.39", "2.5")):
        (tmp_path / name).write_text("".join(f"{i}.0\t{cell}\t0\t0\n" for i in range(300)))
    out = {r["file"]: r for r in files.read_snapshots(spark, str(tmp_path)).collect()}
    assert len(out) == 3 and out["2004.02.12.10.32.39"]["signal"] == [float(i) for i in range(300)]
    assert out["2004.02.12.10.32.39"]["ts"].hour == 10
    assert files.read_snapshots(spark, str(tmp_path), channel=1).count() == 2
    assert vibration.dataset_status(files.read_snapshots(spark, str(tmp_path)), "file").first()["total_snapshots"] == 3


def test_images_gallery_and_uri(spark):
    # pytest's own folder has "test" in its name, which would decide the split
    tmp_path = Path(tempfile.mkdtemp(prefix="images-"))
    for folder in ("train/ok_front", "test/def_front", "test/other"):
        (tmp_path / folder).mkdir(parents=True)
        for i in range(7):
            (tmp_path / folder / f"{i}.{('png', 'jpeg', 'txt')[i % 3]}").write_bytes(bytes([i, 255]) * 100)
    rows = files.read_images(spark, str(tmp_path))
    assert {(r["label"], r["split"]): r["count"] for r in rows.groupBy("label", "split").count().collect()} == {("good", "train"): 5, ("defective", "test"): 5}
    shown = embeddings.gallery(rows, size=3).collect()
    assert len(shown) == 6
    for r in shown:
        kind = "png" if r["filename"].endswith("png") else "jpeg"
        assert r["data"].startswith(f"data:image/{kind};base64,")
        assert base64.b64decode(r["data"].split(",")[1]) == bytes([int(r["filename"][0]), 255]) * 100
    df = spark.createDataFrame([("data:x;base64,aGk=",), ("aGk=",)], "t string")
    assert [bytes(r[0]) for r in df.select(embeddings.decode_data_uri(F.col("t"))).collect()] == [b"hi", b"hi"]


def test_image_verdict(spark):
    rng = np.random.default_rng(2)
    rows = [(i, 0, rng.normal(size=16).tolist()) for i in range(200)] + [(200 + i, 1, (rng.normal(size=16) + 4).tolist()) for i in range(40)]
    df = spark.createDataFrame(rows, "id bigint, label int, v array<float>")
    scored = embeddings.with_decision(df, embeddings.fit_good(df.where("label = 0"), "v", ["id"]))
    limit = embeddings.midpoint_threshold(scored.withColumn("k", F.lit(1)), ["k"]).first()["threshold"]
    out = embeddings.verdict(scored, F.lit(limit))
    assert out.where("label = 1 and message = 'Defect detected'").count() >= 38
    assert out.where("anomaly_score <> -raw").count() == 0


def test_csv_and_value_column(spark, tmp_path):
    (tmp_path / "s.csv").write_text("timestamp,value\n2013-12-02 21:15:00,73.9\n2013-12-02 21:20:00,\n2013-12-02 21:25:00,NaN\n")
    got = [r["value"] for r in series.read_series_csv(spark, str(tmp_path / "s.csv")).orderBy("timestamp").collect()]
    assert got == [73.9, None, None]
    df = spark.createDataFrame([("a", 1.5, 2)], "name string, temperature double, n int")
    assert series.normalise_value_column(df).columns == ["name", "value", "n"]
    assert series.normalise_value_column(spark.createDataFrame([("a",)], "name string")).columns == ["name"]


def test_documents_and_versions(spark, tmp_path):
    path = tmp_path / "registry.json"
    assert files.read_document(spark, str(path), schemas.REGISTRY).count() == 0
    path.write_text(json.dumps([{"name": "m", "threshold": 0.5, "test_metrics": {"f1": 0.9}}, {"name": "n", "is_production": True}]))
    got = {r["name"]: r for r in files.read_document(spark, str(path), schemas.REGISTRY).collect()}
    assert got["m"]["test_metrics"] == {"f1": 0.9} and got["n"]["is_production"]
    root = str(tmp_path / "drift")
    assert files.read_table(spark, root, "drift_history").count() == 0
    for n in (1, 2):
        rows = spark.range(n).select(F.timestamp_seconds("id").alias("timestamp"), F.lit("stable").alias("status"))
        files.write_version(files.conform(rows, "drift_history"), root)
    assert files.read_table(spark, root, "drift_history").count() == 2
    assert all(isinstance(s, T.StructType) and files.empty_table(spark, n).schema == s for n, s in schemas.TABLES.items())


def test_processed_tables(spark, tmp_path):
    df = spark.createDataFrame([("train", 1.0), ("test", 2.0)], "split string, value double")
    paths = files.write_processed(df, str(tmp_path))
    assert spark.read.parquet(paths["processed"]).count() == 2 and spark.read.parquet(paths["test_stream"]).count() == 1
    out = files.write_report(df, str(tmp_path / "report"))
    assert spark.read.json(out).count() == 2
