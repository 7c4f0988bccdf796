import math
import random

import duckdb
import numpy as np
import pytest

from tidewatch.llm import negatives, queries
from tidewatch.llm.common import checkpointed

EMBEDDINGS = "vec_id bigint, embedding array<float>, label int, row string, x string, part string, rank string"


def table_of(spark, rows):
    return spark.createDataFrame([(*r, "r", "x", "p", "k") for r in rows], EMBEDDINGS)


def brute_force(rows, n_positives=5, n_negatives=5):
    usable = []
    for vec_id, vector, label in rows:
        if vec_id is None or label is None or vector is None or any(v is None or not math.isfinite(v) for v in vector):
            continue
        x = [math.floor(256 * float(np.float32(v))) for v in vector]
        usable.append((vec_id, x, (label + 1) % 10 if vec_id % 7 == 0 else label))
    out = []
    for k, (anchor, x, label) in enumerate(usable):
        if anchor % 100:
            continue
        scored = sorted((-sum(a * b for a, b in zip(x, y)), i, j, other) for j, (i, y, other) in enumerate(usable) if j != k)
        for score, positive, _, _ in [s for s in scored if s[3] == label][:n_positives]:
            inside = [s for s in scored if s[3] != label and 80 * -score <= 100 * -s[0] <= 100 * -score]
            for rank, (other, negative, _, _) in enumerate(inside[:n_negatives], 1):
                out.append((anchor, positive, rank, negative, -score, -other))
    return sorted(out)


def drawn(n, width, seed, scale=1.0, labels=10):
    rnd = random.Random(seed)
    return [(i, [rnd.gauss(0.05, scale) for _ in range(width)], rnd.randrange(labels)) for i in range(n)]


@pytest.mark.parametrize("width, scale", [(64, 0.2), (3, 1.0), (130, 0.1), (8, 3000.0)])
def test_equal_to_brute_force(spark, width, scale):
    rows = drawn(700, width, width, scale)
    got = negatives.mine(table_of(spark, rows))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == brute_force(rows)


def test_ties_repeats_and_rows_that_take_no_part(spark):
    rows = drawn(300, 2, 5, 0.01, labels=3)  # few distinct vectors, so many ties
    rows += rows[100:103] + rows[::10]  # repeated rows, anchors too
    rows += [(400, None, 1), (500, [1.0, None], 1), (600, [math.nan, 1.0], 1), (700, [math.inf, 1.0], 1)]
    rows += [(800, [0.1, 0.1], None), (None, [0.1, 0.1], 1), (900, [0.05], 2), (1000, [], 2), (1100, [0.01, 0.02, 0.5], 2)]
    got = negatives.mine(table_of(spark, rows))
    assert sorted(map(tuple, got.collect())) == brute_force(rows)


def test_one_common_vector(spark):
    rows = drawn(400, 16, 9, 0.2)
    rows = [(i, rows[0][1] if i % 3 else x, label) for i, x, label in rows]
    assert sorted(map(tuple, negatives.mine(table_of(spark, rows)).collect())) == brute_force(rows)


def test_blocks_do_not_matter(spark, monkeypatch):
    rows = drawn(900, 5, 3, 0.3)
    for name, size in (("ANCHOR_BLOCK", 2), ("ROWS", 7), ("HELD", 3)):
        monkeypatch.setattr(negatives, name, size)
    vectors = checkpointed(negatives.components(table_of(spark, rows)))
    got = negatives.hard_negatives(vectors, vectors.where("id % 100 = 0"), 3, 2, parts=3)
    moved = [(i, x, label) for i, x, label in rows]
    plain = brute_force([(i, x, (label - 1) % 10 if i % 7 == 0 else label) for i, x, label in moved], 3, 2)
    assert sorted(map(tuple, got.collect())) == plain


def test_few_or_no_rows(spark):
    assert negatives.mine(table_of(spark, [])).count() == 0
    assert negatives.mine(table_of(spark, [(1, [1.0], 1), (2, [1.0], 2)])).count() == 0  # no anchor
    assert negatives.mine(table_of(spark, [(0, [1.0], 2), (2, [1.0], 2)])).count() == 0  # no positive
    rows = [(0, [1.0], 1), (7, [1.0], 1), (2, [0.9], 3), (3, [1.1], 3)]
    assert list(map(tuple, negatives.mine(table_of(spark, rows)).collect())) == brute_force(rows)


@pytest.mark.parametrize("size", [1, 200, 60_000, 10**8])
def test_products_are_exact(size):
    rng = np.random.default_rng(size)
    a, b = (rng.integers(-size, size + 1, (20, 150)) for _ in range(2))
    a[0], b[0], b[1] = size, size, -size  # the extremes
    moduli = negatives.primes(size * size * 150)
    got = negatives.products(negatives.residue_parts(a.astype(float), moduli), negatives.residue_parts(b.astype(float), moduli), moduli)
    assert got.tolist() == (a.astype(object) @ b.T.astype(object)).tolist()


def test_primes_keep_float32_exact():
    for p in negatives.primes(1 << 61):
        assert (p // 2) ** 2 * negatives.WIDTH < 1 << 24


def test_scores_beyond_a_long_are_refused(spark):
    with pytest.raises(ArithmeticError):
        negatives.mine(table_of(spark, [(0, [1e30], 1), (7, [1e30], 0)]))


def test_query_equals_its_sql(spark, tmp_path):
    rows = drawn(500, 8, 1, 0.2) + [(100, [0.1] * 8, 3), (700, None, 2)]
    table_of(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.op12_negatives(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    twin = con.execute(queries.ORACLES["op12_negatives"]).fetchdf()[got.columns]
    assert sorted(map(tuple, got.collect())) == sorted(twin.itertuples(index=False, name=None)) == brute_force(rows)
