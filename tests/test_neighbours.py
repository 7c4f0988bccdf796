"""Neighbours without copies of the references on disk."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators.detectors import neighbours, probing, tuning
from tidewatch.session import materialize


def table(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "n bigint, x array<double>")


def shuffled_mb(df):
    """Rows of df, and MB its plan wrote to shuffles."""
    rows, total, left = df.collect(), 0, [df._jdf.queryExecution().executedPlan()]
    while left:
        node = left.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            left.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            left.append(node.plan())
        else:
            written = node.metrics().get("shuffleBytesWritten")
            total += written.get().value() if written.isDefined() else 0
            left += [node.children().apply(i) for i in range(node.children().size())]
    return rows, total / 1e6


@pytest.fixture
def small_groups(monkeypatch):
    for module, name, value in ((neighbours, "CELL", 20), (neighbours, "QUERY_BLOCK", 100), (probing, "QUERY_BLOCK", 100)):
        monkeypatch.setattr(module, name, value)
    monkeypatch.setattr(probing, "LEAST_BLOCK", 100, raising=False)


@pytest.fixture(scope="module")
def spread_out(spark):
    """2,000 points of 16 dimensions, where bounds tell nothing: 0.26 MB."""
    x = np.random.default_rng(1).normal(size=(2000, 16))
    return x, materialize(neighbours.distinct_points(table(spark, x), "x"), "points")


def true_distances(x, k):
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    return np.sort(d, axis=1)[:, :k]


def by_query(rows, k):
    found = {}
    for r in rows:
        found.setdefault(r["query"], []).append(r["dist"])
    assert {len(f) for f in found.values()} == {k}
    return np.sort(np.array([sorted(f) for f in found.values()]), axis=0)


def test_exact_join_does_not_copy_references_to_every_cell(spark, spread_out, small_groups):
    x, refs = spread_out
    rows, mb = shuffled_mb(neighbours.knn_join(refs.select("id", "x"), refs, 5, same=True))
    assert np.allclose(by_query(rows, 5), np.sort(true_distances(x, 5), axis=0))
    assert mb < 4 * x.nbytes / 1e6


def test_exact_scores_do_not_copy_references_to_every_cell(spark, spread_out, small_groups):
    x, _ = spread_out
    model = neighbours.fit(table(spark, x), "x", 5)
    rows, mb = shuffled_mb(model.transform(table(spark, x + 0.1)))
    assert sorted(r["n"] for r in rows) == list(range(2000)) and mb < 6 * x.nbytes / 1e6


def test_probing_many_cells_does_not_copy_them_to_every_task(spark, spread_out, small_groups):
    x, refs = spread_out
    index = probing.build(refs, 5, recall=1.0, cell=20)
    assert index.probes > 50
    rows, mb = shuffled_mb(neighbours.probing_join(index, 5))
    assert mb < 4 * x.nbytes / 1e6
    assert by_query(rows, 5).mean() < 1.002 * true_distances(x, 5).mean()


@pytest.mark.parametrize("recall", [None, 0.8])
def test_sent_and_read_references_give_the_same_scores(spark, small_groups, monkeypatch, recall):
    """Rows with copies and many equal distances; some queries far from all references, and some given twice."""
    rng = np.random.default_rng(2)
    grid = rng.integers(0, 12, (900, 3)).astype(float)
    asked = np.vstack([grid[:150] + 0.5, grid[:40], grid[:40], rng.normal(0, 90, (20, 3))])
    got = []
    for most in (1e9, -1.0):
        monkeypatch.setattr(probing, "SPREAD", most, raising=False)
        scored = neighbours.fit(table(spark, grid), "x", 9, recall=recall).transform(table(spark, asked))
        got.append({r["n"]: r["score"] for r in scored.collect()})
    assert got[0] == got[1] and len(got[0]) == len(asked)


def test_nearest_are_those_of_a_full_sort():
    rng = np.random.default_rng(3)
    queries, refs = rng.integers(0, 5, (700, 3)).astype(float), rng.integers(0, 5, (9000, 3)).astype(float)
    ties = rng.permutation(len(refs))
    best = probing.Nearest(queries, 12)
    for at in range(0, len(refs), 700):
        best.offer(refs[at : at + 700], [ties[at : at + 700], np.arange(at, min(at + 700, len(refs)))])
    best.close()
    d = np.sqrt(((queries[:, None, :] - refs[None, :, :]) ** 2).sum(2))
    order = np.lexsort((np.broadcast_to(ties, d.shape), d), axis=1)[:, :12]
    assert (best.kept[1] == order).all() and (best.dist == np.take_along_axis(d, order, 1)).all()


def test_tuning_scores_the_validation_rows_once_for_a_setting(spark):
    scored = spark.sparkContext.accumulator(0)

    class Fixed:
        def transform(self, df, name="score"):
            def count(batches):
                for b in batches:
                    scored.add(len(b))
                    yield b.assign(score=b["value"])

            return df.mapInPandas(count, "label int, value double, score double")

    rows = spark.createDataFrame([(int(i > 90), float(i)) for i in range(100)], "label int, value double")
    _, value, threshold = tuning.tune(lambda v: Fixed(), [3.0, 4.0], rows)
    assert scored.value == 2 * 100 and value == 3.0 and 89 < threshold < 91
