import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import clean, evaluate
from tidewatch.operators.detectors import base, envelope, halfspace, isolation, neighbours, oneclass, sequence, tuning


def frame(spark, x, label=None):
    names = [f"f{i}" for i in range(x.shape[1])]
    label = np.zeros(len(x), dtype=int) if label is None else label
    rows = [(i, int(y), *map(float, r)) for i, (y, r) in enumerate(zip(label, x))]
    schema = "id bigint, label int, " + ", ".join(f"{n} double" for n in names)
    return spark.createDataFrame(rows, schema), names


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(0)
    normal = rng.normal(size=(700, 3))
    odd = rng.normal(size=(30, 3)) * 0.5 + np.array([6.0, -6.0, 6.0])
    x = np.vstack([normal, odd])
    df, names = frame(spark, x, np.r_[np.zeros(700, int), np.ones(30, int)])
    return df.cache(), names


def auc(scored):
    rows = scored.select(F.lit("m").alias("model"), "label", "score")
    return evaluate.rank_metrics(rows).first()["roc_auc"]


def fits(names):
    return {
        "forest": lambda d: isolation.fit(d, names, ["id"], trees=50),
        "envelope": lambda d: envelope.fit(d, names, ["id"]),
        "oneclass": lambda d: oneclass.fit(d, names, nu=0.05),
        "lof": lambda d: neighbours.fit(d, names, 20),
    }


@pytest.mark.parametrize("which", ["forest", "envelope", "oneclass", "lof"])
def test_planted_outliers_score_highest(planted, which):
    df, names = planted
    model = fits(names)[which](df.where("label = 0 and id % 2 = 0"))
    assert auc(model.transform(df)) > 0.98


def test_forest_is_repeatable_and_bounded(planted):
    df, names = planted
    a, b = (isolation.fit(df.repartition(n), names, ["id"], trees=20).transform(df).orderBy("id").select("score").toPandas() for n in (1, 5))
    assert np.allclose(a, b) and ((a["score"] > 0) & (a["score"] < 1)).all()


def test_forest_matches_a_plain_walk(planted, spark):
    df, names = planted
    model = isolation.fit(df, names, ["id"], trees=7)
    roots, feature, split, left, path = model.tables
    x = df.orderBy("id").select(names).toPandas().to_numpy()
    got = model.transform(df).orderBy("id").toPandas()["score"].to_numpy()
    for i in (0, 5, 720):
        total = 0.0
        for node in roots:
            while left[node] != node:
                node = left[node] + (x[i, feature[node]] > split[node])
            total += path[node]
        assert got[i] == pytest.approx(2 ** (-(total / 7) / isolation.average_path(256)))


def test_average_path():
    assert isolation.average_path(1) == 0 and isolation.average_path(2) == 1
    assert isolation.average_path(256) == pytest.approx(10.2448, abs=1e-3)


def test_contamination_share(planted):
    df, names = planted
    model = isolation.fit(df, names, ["id"], trees=30, contamination=0.05)
    flagged = model.transform(df).where(model.decision() < 0).count()
    assert flagged == pytest.approx(0.05 * 730, abs=2)


def test_constant_and_tiny_training_sets(spark):
    df, names = frame(spark, np.full((5, 2), 3.0))
    assert isolation.fit(df, names, ["id"], trees=5).transform(df).select("score").distinct().count() == 1
    assert envelope.fit(df, names, ["id"]) is None


def test_moments_equal_numpy(spark):
    x = np.random.default_rng(1).normal(size=(500, 4))
    df, names = frame(spark, x)
    n, mean, cov = base.mean_and_cov(df.repartition(7).select(base.as_vector(names).alias("x")))
    assert n == 500 and np.allclose(mean, x.mean(0)) and np.allclose(cov, np.cov(x.T, bias=True))


def test_envelope_ignores_contamination_and_offset_share(spark):
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(size=(900, 2)), rng.normal(size=(100, 2)) + 12])
    df, names = frame(spark, x)
    model = envelope.fit(df, names, ["id"])
    assert np.allclose(model.mean, 0, atol=0.2) and np.allclose(model.covariance, np.eye(2), atol=0.35)
    assert envelope.chi2_quantile(0.975, 2) == pytest.approx(7.377759, abs=1e-5)
    assert envelope.chi2_quantile(0.5, 22) == pytest.approx(21.337, abs=1e-3)
    assert model.transform(df).where(F.col("score") > model.offset).count() == pytest.approx(20, abs=1)


def test_nu_is_the_share_outside(planted):
    df, names = planted
    train = df.where("label = 0")
    for nu in (0.03, 0.1):
        outside = oneclass.fit(train, names, nu=nu, steps=5).transform(train).where("score > 1e-12").count()
        assert outside / 700 == pytest.approx(nu, abs=0.01)


def brute_lof(ref, query, k):
    def near(x, skip):
        d = np.sqrt(((x - ref) ** 2).sum(1))
        if skip is not None:
            d[skip] = np.inf
        order = np.argsort(d, kind="stable")[:k]
        return order, d[order]

    around = [near(x, i) for i, x in enumerate(ref)]
    kdist = np.array([d[-1] for _, d in around])
    lrd = np.array([1 / (np.maximum(kdist[o], d).mean() + 1e-10) for o, d in around])
    out = []
    for x in query:
        o, d = near(x, None)
        out.append(lrd[o].mean() * (np.maximum(kdist[o], d).mean() + 1e-10))
    return np.array(out)


def test_lof_equals_brute_force_with_many_cells(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL", 20)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 30)
    monkeypatch.setattr(neighbours, "REF_BLOCK", 40)
    rng = np.random.default_rng(3)
    ref = np.vstack([rng.normal(size=(150, 2)), rng.normal(size=(200, 2)) * 0.1 + 5, rng.uniform(-20, 20, size=(50, 2))])
    query = rng.uniform(-8, 8, size=(60, 2))
    (refs, names), (queries, _) = frame(spark, ref), frame(spark, query)
    got = neighbours.fit(refs, names, 10).transform(queries).orderBy("id").toPandas()["score"]
    assert np.allclose(got, brute_lof(ref, query, 10), rtol=1e-9)


def test_knn_join_counts_copies(spark):
    ref = np.vstack([np.zeros((40, 2)), np.arange(1, 11)[:, None] * np.ones((1, 2))])
    refs, names = frame(spark, ref)
    points = neighbours.distinct_points(refs, names)
    assert points.count() == 11 and points.agg(F.sum("w")).first()[0] == 50
    near = neighbours.knn_join(points.select("id", "x"), points, 5, same=True)
    assert {r["s"] for r in near.groupBy("query").agg(F.sum("w").alias("s")).collect()} == {5}
    zero = points.where(F.col("w") == 40).first()["id"]
    assert near.where((F.col("query") == zero)).agg(F.max("dist")).first()[0] == 0.0


def test_half_space_scores_rare_regions_higher(spark):
    rng = np.random.default_rng(5)
    normal = rng.normal(0.3, 0.03, size=(600, 2)).clip(0, 1)
    odd = rng.normal(0.9, 0.02, size=(20, 2)).clip(0, 1)
    df, names = frame(spark, np.vstack([normal, odd]), np.r_[np.zeros(600, int), np.ones(20, int)])
    model = halfspace.fit(df.where("label = 0"), names, ["id"])
    assert model.mass[:, 0].tolist() == [250] * 50
    scored = model.transform(df)
    assert auc(scored) > 0.95
    low, high = scored.agg(F.min("score"), F.max("score")).first()
    assert 0 <= low <= high <= 1


def test_half_space_uses_the_last_complete_window(spark):
    x = np.random.default_rng(6).uniform(size=(620, 2))
    df, names = frame(spark, x)
    model = halfspace.fit(df, names, ["id"])
    assert (model.mass == halfspace.masses(model.trees, x[250:500])).all()


def test_prequential_equals_window_by_window(spark):
    x = np.random.default_rng(7).uniform(size=(230, 2))
    df, names = frame(spark, x)
    rows = df.withColumn("k", F.lit("s"))
    got = halfspace.prequential(rows, names, ["k"], "id", trees=10, height=4, window=50).orderBy("pos").toPandas()["score"]
    trees = halfspace.draw(2, 10, 4)
    assert got[:50].isna().all() and len(got) == 230
    for w in range(1, 5):
        want = halfspace.scores(trees, halfspace.masses(trees, x[50 * (w - 1) : 50 * w]), x[50 * w : 50 * (w + 1)], 50)
        assert np.allclose(got[50 * w : 50 * (w + 1)].astype(float), want)


def grid(spark, n):
    return spark.range(n).select(F.lit("s").alias("sensor_id"), F.col("id").alias("pos"), F.sin(F.col("id") / 5.0).alias("a"), F.col("id").cast("double").alias("b"))


def test_sequences_padding_and_halo(spark):
    n = clean.CHUNK + 40
    rows = sequence.sequences(grid(spark, n), ["b"], ["sensor_id"]).orderBy("pos").collect()
    assert rows[0]["sequence"] == [0.0] * 15 and rows[3]["sequence"] == [0.0] * 12 + [1.0, 2.0, 3.0]
    for p in (14, clean.CHUNK - 1, clean.CHUNK, clean.CHUNK + 3, n - 1):
        assert rows[p]["sequence"] == [float(v) for v in range(p - 14, p + 1)]
    zeros = sequence.sequences(grid(spark, 3).withColumn("b", F.col("b") + 1), ["a", "b"], ["sensor_id"], pad="zeros").orderBy("pos").collect()
    assert zeros[0]["sequence"][:28] == [0.0] * 28 and len(zeros[2]["sequence"]) == 30


def test_reconstruction_finds_a_break(spark):
    df = grid(spark, 600).withColumn("a", F.when(F.col("pos") == 500, 4.0).otherwise(F.col("a")))
    rows = sequence.sequences(df, ["a"], ["sensor_id"])
    model = sequence.fit(rows.where("pos < 400"), 1, hidden=4)
    assert model.transform(rows).orderBy(F.col("score").desc()).first()["pos"] in range(498, 516)


def test_tuning_takes_the_first_best(planted):
    df, names = planted

    class Fixed:
        def __init__(self, sign):
            self.sign = sign

        def transform(self, rows, name="score"):
            return rows.withColumn(name, F.col(names[0]) * self.sign)

    model, value, threshold = tuning.tune(lambda v: Fixed(v), [-1.0, 1.0, 1.0], df)
    assert value == 1.0 and threshold > 0


def test_covariance_far_from_zero(spark):
    import numpy as np

    rows = np.random.default_rng(1).normal(size=(2000, 2)) + 1e8
    df = spark.createDataFrame([(r.tolist(),) for r in rows], "x array<double>").repartition(5)
    n, mean, cov = base.mean_and_cov(df)
    assert n == 2000 and np.allclose(mean, rows.mean(axis=0)) and np.allclose(cov, np.cov(rows.T, bias=True), atol=1e-4)


def test_models_are_saved_and_loaded(spark, tmp_path):
    import numpy as np

    from tidewatch.operators.detectors import envelope, halfspace, isolation, neighbours, oneclass, sequence, store

    rng = np.random.default_rng(4)
    rows = [(i, *map(float, rng.random(2))) for i in range(400)]
    df = spark.createDataFrame(rows, "id bigint, a double, b double")
    names = ["a", "b"]
    models = {
        "forest": isolation.fit(df, names, ["id"], trees=10, contamination=0.1),
        "trees": halfspace.fit(df, names, ["id"], trees=5),
        "envelope": envelope.fit(df, names, ["id"]),
        "svm": oneclass.fit(df, names),
        "lof": neighbours.fit(df, names, k=5),
    }
    for name, model in models.items():
        path = store.save(model, spark, str(tmp_path / name))
        back = store.load(spark, path)
        want = {r["id"]: r["score"] for r in model.transform(df).collect()}
        assert {r["id"]: r["score"] for r in back.transform(df).collect()} == want, name
    wide = df.selectExpr("array(a, b, a + b, a - b) AS sequence")
    kept = sequence.SequenceModel(np.zeros(4), np.eye(4)[:2], 2)
    back = store.load(spark, store.save(kept, spark, str(tmp_path / "sequence")))
    assert np.array_equal(back.basis, kept.basis) and back.width == 2 and wide.count() == 400
    with pytest.raises(FileNotFoundError):
        store.load(spark, str(tmp_path / "none"))
