import hashlib
import re

from tidewatch.llm import decontamination as d

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = "One two three, four five six seven eight nine ten eleven TWELVE"
ITEMS = [(1, LONG), (2, "short item"), (3, None), (4, "..."), (10, "Short  ITEM!"), (None, "lost words"), (5, "é")]


def brute(text):
    words = WORD.findall((text or "").translate(LOWER))
    covered, items = set(), set()
    for item, body in ITEMS:
        w = WORD.findall((body or "").translate(LOWER))
        if item is None or not w:
            continue
        k = min(10, len(w))
        grams = [w[i : i + k] for i in range(len(w) - k + 1)]
        for i in range(len(words) - k + 1):
            if words[i : i + k] in grams:
                covered.update(range(i, i + k))
                items.add(str(item))
    digest = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
    return len(words), len(covered), len(items), digest, bool(covered)


TEXTS = [
    None, "", "?!", "nothing here", LONG, "x " + LONG.upper() + " y", LONG + " " + LONG, "a short item b short-item",
    "one two three four five six seven eight nine", "É é", "é", ("filler " * 5000) + LONG + (" filler" * 4000),
    ("pad " * (d.BLOCK - 5)) + LONG, "lost words",
]


def test_windows_match_brute_force(spark, docs):
    bench = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    got = {r["doc_id"]: r for r in d.contamination(docs(list(enumerate(TEXTS))), bench).collect()}
    for i, text in enumerate(TEXTS):
        row = got[i]
        assert (row["n_words"], row["n_hit"], row["n_items"], row["items_sha256"], row["contaminated"]) == brute(text), i


def test_without_the_first_step_or_a_broadcast_the_result_is_the_same(spark, docs, monkeypatch):
    bench = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    rows = docs(list(enumerate(TEXTS)))
    want = sorted(map(tuple, d.contamination(rows, bench).collect()))
    monkeypatch.setattr(d, "HEADS", 0)
    monkeypatch.setattr(d, "broadcast_if_small", lambda df, size: df)
    assert sorted(map(tuple, d.contamination(rows, bench).collect())) == want


def test_documents_or_spans_go(spark, docs):
    bench = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    table = docs([(1, "Keep me, " + LONG + "; and me."), (2, "clean"), (None, "clean too"), (3, None)])
    left = d.drop_contaminated(table, bench)
    assert left.columns == table.columns
    assert {r["text"] for r in left.collect()} == {"clean", "clean too", None}
    cut = d.remove_spans(table, bench)
    assert {r["text"] for r in cut.collect()} == {"Keep me, and me.", "clean", "clean too", None}


def test_a_contaminated_row_takes_no_other_row_with_its_id(spark, docs):
    bench = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    table = docs([(1, LONG), (1, "clean"), (1, "clean"), (None, LONG), (None, "clean too"), (None, None), (2, LONG)])
    left = d.drop_contaminated(table, bench).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in left) == [(0, ""), (0, "clean too"), (1, "clean"), (1, "clean")]


def test_empty_tables_and_repeated_rows(spark, docs):
    bench = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    table = docs([(1, LONG), (1, LONG), (None, LONG)])
    assert [r["n_hit"] for r in d.contamination(table, bench).collect()] == [12, 12, 12]
    assert d.contamination(table.limit(0), bench).count() == 0
    assert [r["n_hit"] for r in d.contamination(table, bench.limit(0)).collect()] == [0, 0, 0]
