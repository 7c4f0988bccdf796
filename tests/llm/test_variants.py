import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from tidewatch.llm import queries, variants
from tidewatch.llm.common import UPPER

COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def counts(rows):
    seen = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(str.maketrans(UPPER, UPPER.lower()))
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            seen[run] += 1
    return {w: n for w, n in seen.items() if len(w) >= 7 and n >= 2}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_force(n):
    out, forms = [], {}
    for word in n:
        close = [w for w in n if near(w, word)]
        best = min(close, key=lambda w: (-n[w], w), default=None)
        forms[word] = best if best is not None and n[best] >= 10 * n[word] else None
        out.append([word, forms[word], word, n[word], len(close), n[forms[word]] if forms[word] else None])
    for row in out:
        while forms[row[2]]:
            row[2] = forms[row[2]]
    return sorted(map(tuple, out))


def rows_of(found):
    return sorted(map(tuple, found.select(*COLUMNS).collect()))


def edited(rnd, word, letters):
    at = rnd.randrange(len(word) + 1)
    return rnd.choice([word[:at] + rnd.choice(letters) + word[at:], word[:at] + word[at + 1 :], word[:at] + rnd.choice(letters) + word[at + 1 :]])


@pytest.mark.parametrize("seed, letters", [(1, "ab"), (2, "abcé"), (3, "abcdefghijklmnop"), (4, "a")])
def test_equal_to_brute_force(spark, seed, letters):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice(letters) for _ in range(rnd.randint(7, 11))) for _ in range(60)]
    for _ in range(180):
        words.append(edited(rnd, rnd.choice(words), letters))
    n = {w: rnd.choice([2, 3, 20, 21, 30, 200, 300, 3000]) for w in words if len(w) >= 7}
    table = spark.createDataFrame(list(n.items()), "word string, n bigint")
    assert rows_of(variants.grouped(table)) == brute_force(n)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.dictionaries(st.text("aßÿ", min_size=7, max_size=9), st.integers(2, 400), max_size=40))
def test_any_words(spark, n):
    table = spark.createDataFrame(list(n.items()), "word string, n bigint")
    assert rows_of(variants.grouped(table)) == brute_force(n)


def test_query_equals_brute_force(spark, docs, tmp_path):
    rnd = random.Random(3)
    words = ["Garden-house", "gardenhouse", "gardenhause", "Ünderstanding", "Ünderstandng", "understanding", "aaaaaaaa", "×÷ÀÈÌÒÙ", "short", "Ångström"]
    rows = [(i, " ".join(rnd.choices(words, [90, 900, 9, 70, 7, 60, 50, 40, 30, 20], k=60))) for i in range(120)]
    rows += [(5, rows[5][1]), (None, rows[6][1]), (None, rows[6][1]), (7, None), (8, ""), (9, "longword " * 30_000 + "xy" * 25_000 + " " + "xy" * 25_000)]
    docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_variants(spark, str(tmp_path))
    assert got.columns == COLUMNS
    assert rows_of(got) == brute_force(counts(rows))


def test_a_chain_of_forms_ends_at_its_last(spark):
    n = {"abcdefgh": 2, "abcdefgi": 20, "abcdefii": 200, "abcdeiii": 2000, "abcdiiii": 20000, "zzzzzzz": 5}
    got = {r["word"]: (r["form"], r["root"]) for r in variants.grouped(spark.createDataFrame(list(n.items()), "word string, n bigint")).collect()}
    assert got["abcdefgh"] == ("abcdefgi", "abcdiiii") and got["zzzzzzz"] == (None, "zzzzzzz")


def test_a_pair_of_nodes_has_few_members(spark):
    words = [f"{a}bcdefg" for a in "abcdefghijklmnopqrstuvwxyz"] + ["bcdefgh", "abcdefgh"]
    table = spark.createDataFrame([(w, 2) for w in words], "word string, n bigint")
    paths = variants.trie_paths(table, ["word", "n"]).withColumnRenamed("rank", "id")
    most = variants.node_pairs(paths).groupBy("prefix", "suffix").count().agg({"count": "max"}).first()[0]
    assert most == 26


@pytest.mark.parametrize("letters, parts", [("ab", 9), ("aé", 4), ("abcdefgh", 7)])
def test_trie_nodes_are_numbered_once_over_all_partitions(spark, letters, parts):
    rnd = random.Random(parts)
    words = {"".join(rnd.choice(letters) for _ in range(rnd.randint(1, 12))) for _ in range(400)} | {"a" * 3000, "a" * 2999 + letters[1]}
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        rows = variants.trie_paths(spark.createDataFrame([(w,) for w in words], "word string"), ["word"]).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    number = {}
    for row in rows:
        assert len(row["path"]) == len(row["word"]) + 1
        for depth, node in enumerate(row["path"]):
            assert number.setdefault(node, row["word"][:depth]) == row["word"][:depth]
    assert len(number) == len(set(number.values()))
    assert [r["word"] for r in sorted(rows, key=lambda r: r["rank"])] == sorted(words)


def test_empty_table(spark, docs):
    assert variants.spelling_variants(docs([])).count() == 0
