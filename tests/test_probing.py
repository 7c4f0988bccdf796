import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators.detectors import neighbours, probing
from tidewatch.session import materialize


def points(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "n bigint, x array<double>")


def true_neighbours(x, k):
    d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    return np.argsort(d, axis=1, kind="stable")[:, :k]


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(c, 0.5, (300, 6)) for c in rng.normal(0, 4, (8, 6))])
    refs = materialize(neighbours.distinct_points(points(spark, x), "x"), "points")
    return x, refs


def test_stated_recall_holds_for_all_points(spark, clustered):
    x, refs = clustered
    index = probing.build(refs, 10, recall=0.95, cell=60)
    assert 1 < index.probes < len(index.pivots) == 40 and index.recall >= 0.95
    near = neighbours.probing_join(index, 10)
    names = {r["id"]: i for i, r in enumerate(points(spark, x).select(neighbours.point_id(F.col("x")).alias("id"), "n").orderBy("n").collect())}
    found = {}
    for r in near.collect():
        found.setdefault(names[r["query"]], set()).add(names[r["id"]])
    true = true_neighbours(x, 10)
    hits = np.mean([len(found[i] & set(true[i].tolist())) / 10 for i in range(len(x))])
    assert all(len(f) == 10 for f in found.values()) and hits >= 0.95


def test_full_recall_looks_further(spark, clustered):
    _, refs = clustered
    few, many = (probing.build(refs, 10, recall=r, cell=60) for r in (0.6, 1.0))
    assert few.probes < many.probes and many.recall == 1.0


def test_scores_agree_with_the_exact_mode(spark, clustered):
    x, _ = clustered
    rng = np.random.default_rng(5)
    fresh = points(spark, np.vstack([x[:200] + rng.normal(0, 0.05, (200, 6)), rng.normal(0, 12, (20, 6))]))
    train = points(spark, x)
    exact, near = neighbours.fit(train, "x", 15), neighbours.fit(train, "x", 15, recall=0.99)
    a = exact.transform(fresh).orderBy("n").toPandas()["score"].to_numpy()
    b = near.transform(fresh).orderBy("n").toPandas()
    assert list(b.columns) == ["n", "x", "score"]
    assert np.corrcoef(a, b["score"])[0, 1] > 0.99 and (b["score"][200:] > 1.5).all()


def test_one_cell_is_exact_and_copies_count(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(80, 3))
    train = points(spark, np.vstack([x, x[:7], x[:7]]))
    asked = points(spark, np.vstack([x[:5], x[:5], rng.normal(size=(9, 3))]))
    a, b = (neighbours.fit(train, "x", 8, recall=r).transform(asked).orderBy("n").toPandas() for r in (None, 0.9))
    assert np.allclose(a["score"], b["score"])


def test_a_hot_query_vector_is_looked_up_once_a_block(spark, clustered):
    x, refs = clustered
    model = neighbours.fit(points(spark, x), "x", 10, recall=0.9)
    hot = spark.range(30_000).select(F.col("id").alias("n"), F.array(*[F.lit(float(v)) for v in x[0]]).alias("x"))
    got = model.transform(hot)
    assert got.count() == 30_000 and got.select("score").distinct().count() == 1


def test_no_reference_points(spark):
    with pytest.raises(ValueError):
        probing.build(spark.createDataFrame([], "id string, x array<double>, w bigint"), 5)
