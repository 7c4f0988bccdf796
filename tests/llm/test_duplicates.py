import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidewatch.llm import exact_dedup, simhash
from tidewatch.llm.components import connected

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_id(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}


def test_exact_groups_match_brute_force_and_span_partitions(spark, docs):
    rng = random.Random(5)
    texts = ["", None, "Same Text", "same text", "É", "é", "x" * 100_000, "X" * 100_000]
    # A third of all rows is one text; others share a long beginning.
    rows = [(i, rng.choice(texts + ["hot"] * 4 + ["p" * 40 + str(rng.randrange(30))])) for i in range(600)]
    table = docs(rows).repartition(7)
    got = by_id(exact_dedup.exact_duplicates(table))
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(LOWER), []).append(i)
    assert len(got) == len(rows)
    for norm, ids in groups.items():
        for i in ids:
            assert got[i] == {
                "doc_id": i, "keep_id": max(ids), "group_size": len(ids), "kept": i == max(ids),
                "text_sha256": hashlib.sha256(norm.encode()).hexdigest(),
            }
    kept = exact_dedup.drop_exact_duplicates(table)
    assert kept.columns == table.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(max(ids) for ids in groups.values())


def test_one_text_in_every_partition_is_one_group(spark, docs):
    got = exact_dedup.exact_duplicates(docs([(i, "Again") for i in range(500)]).repartition(9))
    row = got.agg(F.count("*"), F.sum(F.col("kept").cast("int")), F.min("group_size"), F.max("keep_id")).first()
    assert tuple(row) == (500, 1, 500, 499)


def test_exact_ties_null_ids_and_empty_tables(spark, docs):
    got = exact_dedup.exact_duplicates(docs([(1, "a"), (1, "a"), (None, "a"), (None, "b")])).collect()
    assert sorted((r["doc_id"] or 0, r["keep_id"] or 0, r["group_size"], r["kept"]) for r in got) == [
        (0, 0, 1, True), (0, 1, 3, False), (1, 1, 3, False), (1, 1, 3, True)
    ]
    kept = exact_dedup.drop_exact_duplicates(docs([(1, "a"), (1, "a"), (None, "a"), (None, "b")])).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept) == [(0, "b"), (1, "a")]
    empty = docs([(1, "a")]).limit(0)
    assert exact_dedup.exact_duplicates(empty).count() == 0
    assert exact_dedup.drop_exact_duplicates(empty).count() == 0


def test_equal_sort_keys_with_other_texts_are_kept_apart():
    runs = exact_dedup._Runs(3)
    for code, norm, i in [(1, b"a", 9), (2, b"b", 8), (2, b"b", 7), (2, b"c", 6), (5, b"d", 5)]:
        runs.add((b"", code), norm, i)
    runs.flush(edge=True)
    got = [(r[0], r[1], r[2], r[3], r[5] is not None) for r in runs.out]
    assert got == [(9, 9, 1, True, True), (8, 8, 2, True, False), (7, 8, 2, False, False), (6, 6, 1, True, False), (5, 5, 1, True, True)]


def brute_fingerprint(text):
    words = text.encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    codes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(c >> b & 1 for c in codes) * 2 > len(codes))


@pytest.mark.parametrize("text", ["", "One", "one two", "A b\tC", "été É x y\x0bz", "x " * 20_000, "a b c a b c"])
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode().lower()) == brute_fingerprint(text)


def test_every_pair_within_two_bits_meets_at_a_home_anchor():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2**64, 2000, dtype=np.uint64)
    y = x.copy()
    for i in range(len(y)):
        for bit in rng.choice(64, rng.integers(0, 3), replace=False):
            y[i] ^= np.uint64(1) << np.uint64(bit)
    _, home = simhash.cells(x, 0)
    assert len(home) == len(x)
    row, cell = simhash.cells(y, simhash.THRESHOLD)
    visits = set(zip(row.tolist(), cell.tolist()))
    assert all((i, int(c)) in visits for i, c in enumerate(home))


def brute_components(codes):
    ids = sorted(codes)
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if (codes[a] ^ codes[b]).bit_count() <= 2 and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return label


def test_near_duplicates_match_brute_force(spark, docs):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    rows = [(0, None), (1, ""), (2, " \n"), (3, "solo")]
    for k in range(25):
        base = [rng.choice(words) for _ in range(rng.choice([5, 60, 200]))]
        for _ in range(rng.randint(1, 5)):
            copy = list(base)
            if rng.random() < 0.7:
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows), " ".join(copy)))
    got = by_id(simhash.near_duplicates(docs(rows)))
    codes = {i: brute_fingerprint(t or "") for i, t in rows}
    want = brute_components(codes)
    assert {i: (r["fingerprint"], r["component_id"]) for i, r in got.items()} == {
        i: (f"{codes[i]:016x}", want[i]) for i in codes
    }
    kept = simhash.drop_near_duplicates(docs(rows))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))
    assert simhash.near_duplicates(docs(rows).limit(0)).count() == 0


def test_near_duplicates_without_ids_and_with_repeats(spark, docs):
    got = simhash.near_duplicates(docs([(None, "a b c d"), (None, "a b c d"), (4, "x y z"), (4, "x y z")])).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in got) == [(0, 0), (0, 0), (4, 4), (4, 4)]


def test_one_row_of_each_component_stays_whatever_its_ids(spark, docs):
    one, two, three, four = ("a b c d e f g", "h i j k l m n", "o p q r s t u", "v w x y z a b")
    rows = [
        (None, one), (None, one), (None, one.upper()), (None, two), (5, two), (7, three), (7, three), (7, four),
        (None, four), (7, four), (None, None), (None, ""), (9, "solo"), (9, "other"), (9, "solo"),
    ]
    kept = simhash.drop_near_duplicates(docs(rows))
    assert kept.columns == docs(rows).columns
    got = sorted((r["doc_id"] or 0, (r["text"] or "").lower()) for r in kept.collect())
    assert got == sorted([(0, one), (5, two), (7, three), (7, four), (0, ""), (9, "solo"), (9, "other")])


def test_components_of_a_chain_a_star_and_a_ring(spark):
    chain = [(i, i + 1) for i in range(100, 140)]
    star = [(7, 1000 + i) for i in range(50)]
    ring = [(2000, 2001), (2001, 2002), (2000, 2002)]
    links = spark.createDataFrame(chain + star + ring, "a bigint, b bigint")
    labels = {r["node"]: r["label"] for r in connected(links).collect()}
    assert all(labels[i] == 100 for i in range(100, 141))
    assert all(labels[1000 + i] == 7 for i in range(50)) and labels[2002] == 2000
    assert connected(links.limit(0)).count() == 0
