"""Row filters decide by row: ids may be null or repeat, and columns may be called like any helper."""

import time

import pytest
from pyspark.sql import functions as F

from tests.llm.test_benchmark import ITEMS, LONG
from tidewatch.llm import decontamination, exact_dedup, html, language, simhash

CLASHES = ["own_text", "bad_text", "cut_text", "cut_spans", "digest", "place", "keep_id", "keep_text", "own_key", "best_key", "Place_", "key", "label"]


@pytest.fixture
def crowded(docs):
    def build(rows):
        table = docs(rows)
        return table.select("*", *[F.lit(f"user {c}").alias(c) for c in CLASHES])

    return build


def user_columns_are_whole(found):
    return all(all(r[c] == f"user {c}" for c in CLASHES) for r in found)


def test_spans_go_row_by_row(spark, crowded):
    bench = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    rows = [(1, "Keep me, " + LONG + "; and me."), (1, "p q"), (1, "p q"), (1, "Keep me, " + LONG + "; and me."), (None, LONG), (None, "clean"), (2, None), (3, "")]
    table = crowded(rows)
    got = decontamination.remove_spans(table, bench)
    assert got.columns == table.columns
    found = got.collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in found) == sorted(
        [(1, "Keep me, and me."), (1, "Keep me, and me."), (1, "p q"), (1, "p q"), (0, ""), (0, "clean"), (2, ""), (3, "")]
    )
    assert user_columns_are_whole(found)
    assert decontamination.remove_spans(table.limit(0), bench).count() == 0


@pytest.mark.parametrize("drop", [exact_dedup.drop_exact_duplicates, simhash.drop_near_duplicates])
def test_duplicates_go_whatever_columns_are_called(crowded, drop):
    rows = [(1, "a b c d"), (1, "a b c d"), (2, "a b c d"), (None, "x y z"), (None, "x y z"), (3, None), (4, "")]
    table = crowded(rows)
    got = drop(table)
    assert got.columns == table.columns
    found = got.collect()
    assert user_columns_are_whole(found)
    assert len([r for r in found if r["text"] == "a b c d"]) == 1 and len([r for r in found if r["text"] == "x y z"]) == 1
    assert len(found) == 3


@pytest.mark.parametrize("drop", [exact_dedup.drop_exact_duplicates, simhash.drop_near_duplicates])
def test_of_rows_alike_the_same_one_stays_in_every_run(spark, drop):
    rows = [(7, "one text of words", f"v{k}") for k in range(40)]
    kept = {drop(spark.createDataFrame(rows[k:] + rows[:k], "doc_id bigint, text string, other string").repartition(k + 1)).first()["other"] for k in range(4)}
    assert len(kept) == 1


@pytest.mark.parametrize("piece", [1, 3, 7])
def test_long_runs_are_cut_into_pieces(spark, monkeypatch, piece):
    rows = [(None if i % 3 else i, "Same text") for i in range(60)] + [(i, f"text {i % 9}") for i in range(40)] + [(None, None), (None, "")]
    table = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    whole = sorted(map(tuple, exact_dedup.exact_duplicates(table).collect()), key=str)
    held = []
    add = exact_dedup._Runs.add

    def watched(self, *row):
        add(self, *row)
        held.append(max((len(ids) for _, ids in self.runs), default=0))

    monkeypatch.setattr(exact_dedup, "PIECE", piece)
    monkeypatch.setattr(exact_dedup._Runs, "add", watched)
    cut = exact_dedup._Runs(0)
    for k in range(50):
        cut.add((b"a", 1), b"a", 50 - k)
    cut.flush(edge=True)
    assert max(held) <= piece and len(cut.out) == 50 and {row[1] for row in cut.out if row[3]} >= {50}
    group = exact_dedup.exact_duplicates(table).where("text_sha256 = sha2('same text', 256)").collect()
    assert len(group) == 60 and {r["group_size"] for r in group} == {60} and {r["keep_id"] for r in group} == {57}
    assert sum(r["kept"] for r in group) == 1
    assert sorted(map(tuple, exact_dedup.exact_duplicates(table).collect()), key=str) == whole


def test_contaminated_rows_go_with_clashing_columns(spark, crowded):
    bench = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    found = decontamination.drop_contaminated(crowded([(1, LONG), (1, "clean"), (None, None)]), bench).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in found) == [(0, ""), (1, "clean")] and user_columns_are_whole(found)


def test_inline_templates_leave_the_paragraph_whole():
    page = "<article><p>Main words <span class='ad'>Buy <b>this</b></span> go on</p><p>end <button>Share</button></p></article>"
    assert [t for t, p in html.blocks(page) if p == html.FIRM] == ["Main words go on", "end"]
    assert html.blocks("<article><p>a<label>b</p><p>c</label>d</p></article>")[0] == ("a", html.FIRM)


@pytest.mark.parametrize("part", ['<a "', "<a ", "<a '\"", "<!--", "<p class=x", "&amp", "</"])
def test_broken_markup_takes_linear_time(part):
    begun = time.process_time()
    html.blocks("<article><p>x</p>" + part * (1_000_000 // len(part)))
    assert time.process_time() - begun < 5


@pytest.mark.parametrize("text", ["½ ² ① 12", "١٢ Ⅷ", "́ ̈", "", "?! 🙂"])
def test_no_letter_is_undetermined(spark, text):
    rows = [(i, "der die das und nicht" if i % 2 else "the and of not", "de" if i % 2 else "en") for i in range(40)]
    table = spark.createDataFrame([*rows, (999, text, None)], "doc_id bigint, text string, lang string")
    got = language.predictions(table, language.fit(table)).where("doc_id = 999").first()
    assert (got["lang_pred"], got["score"]) == ("und", 0.0)


def test_words_keep_their_marks_and_length():
    assert language.words("हिन्दी été a1b " + "x" * 500) == ["हिन्दी", "été", "a", "b", "x" * 500]


def test_both_word_patterns_agree():
    latin, any_text = language._patterns()
    text = "".join(map(chr, range(256))) + " aéb1c_d·eªµºx×y÷z"
    assert latin(text) == any_text(text) and latin("aéb1c_d") == ["aéb", "c", "d"]


def test_a_long_word_counts_as_its_grams_do():
    model = language.Model(["x", "y"], {}, {"q": [0.0, 0.3]})
    reader = language.Reader(model)
    assert reader.predict("q" * 200)[0] == "y" and "q" * 200 not in reader.places
