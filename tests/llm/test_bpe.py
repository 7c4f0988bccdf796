import hashlib
import json
import random

import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from tidewatch.llm import bpe, queries

PUBLIC = bpe.read_definition()


@pytest.fixture(scope="module")
def both():
    return bpe.Automaton(PUBLIC), Tokenizer.from_str(PUBLIC)


def library_ids(tokenizer, text):
    return tokenizer.encode(text, add_special_tokens=False).ids


def test_every_character_is_split_as_the_library_does(both):
    automaton, tokenizer = both
    cut = tokenizer.pre_tokenizer.pre_tokenize_str
    for page in range(0, 0x110000, 0x4000):
        space = "".join(f"a{chr(c)}1{chr(c)}! {chr(c)}" for c in range(page, page + 0x4000) if not 0xD800 <= c < 0xE000)
        if page < 0x4000 or page % 0x1C000 == 0:
            assert automaton.words(space) == [space[i:j] for _, (i, j) in cut(space)]


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from("aehnt '’sdl\n\t\x1c\x85  -=09½"), st.characters(codec="utf-8")), max_size=60))
def test_ids_and_texts_are_the_library_s(both, text):
    automaton, tokenizer = both
    ids = automaton.encode(text)
    assert ids == library_ids(tokenizer, text)
    assert automaton.decode(ids) == text == tokenizer.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize(
    "text",
    ["a" * 5001, "=" * 777, " " * 513, "\n" * 300, "haha" * 400, "ßé漢字" * 50, "<|endoftext|>", "x<|endoftext|><|endoftext|> y<|endoftext"],
)
def test_long_runs_and_controls(both, text):
    automaton, tokenizer = both
    ids = automaton.encode(text)
    assert ids == library_ids(tokenizer, text) and automaton.decode(ids) == text


def drawn_definition(seed, merges, letters):
    """A byte-level definition with merges drawn at random: no order that training would give."""
    rnd, names = random.Random(seed), bpe.byte_letters()
    parts, pairs, known = list(letters), [], set(names)
    while len(pairs) < merges:
        a, b = rnd.choice(parts), rnd.choice(parts)
        if a + b not in known and len(a + b) < 9:
            known.add(a + b)
            parts.append(a + b)
            pairs.append((a, b))
    vocab = {name: i for i, name in enumerate([*names, *(a + b for a, b in pairs)])}
    spec = json.loads(PUBLIC)
    spec["added_tokens"] = []
    spec["model"]["vocab"], spec["model"]["merges"] = vocab, [list(p) for p in pairs]
    return json.dumps(spec)


@pytest.mark.parametrize("seed", range(12))
def test_gadgets_of_any_merges(both, seed):
    definition = drawn_definition(seed, 40 if seed % 2 else 12, "ab" if seed % 3 else "abc")
    automaton, tokenizer = bpe.Automaton(definition, both[0].pattern), Tokenizer.from_str(definition)
    rnd = random.Random(seed)
    for _ in range(400):
        word = "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 25)))
        assert automaton.encode(word) == library_ids(tokenizer, word), word


def test_bars_are_what_pairs_of_tokens_do(both):
    """A token may follow another exactly if the two encode as themselves."""
    definition = drawn_definition(5, 25, "ab")
    automaton, tokenizer = bpe.Automaton(definition, both[0].pattern), Tokenizer.from_str(definition)
    tokens = [*range(256, len(automaton.ids)), ord("a") - 33, ord("b") - 33]
    for a in tokens:
        for b in tokens:
            ids = [automaton.ids[a], automaton.ids[b]]
            text = tokenizer.decode(ids)
            assert automaton.may_follow(a, b) == (library_ids(tokenizer, text) == ids)


@pytest.mark.parametrize(
    "change",
    [
        lambda s: s["model"].update(type="WordPiece"),
        lambda s: s["pre_tokenizer"].update(add_prefix_space=True),
        lambda s: s["model"].update(dropout=0.1),
        lambda s: s.update(truncation={"max_length": 4, "strategy": "LongestFirst", "stride": 0, "direction": "Right"}),
    ],
)
def test_other_kinds_are_refused(change):
    spec = json.loads(PUBLIC)
    change(spec)
    with pytest.raises(Exception):
        bpe.Automaton(json.dumps(spec))


def brute_force(rows):
    tokenizer = Tokenizer.from_str(PUBLIC)
    out = []
    for doc_id, text in rows:
        ids = library_ids(tokenizer, text or "")
        back = tokenizer.decode(ids, skip_special_tokens=False)
        sha = [hashlib.sha256(t.encode()).hexdigest() for t in (",".join(map(str, ids)), back)]
        out.append((doc_id, len(ids), *sha))
    return sorted(out, key=str)


def test_query_equals_the_library(spark, docs, tmp_path):
    long = " ".join(f"word{i % 977} und-{i}" for i in range(60_000))
    rows = [(1, "It's 12 o'clock"), (1, "It's 12 o'clock"), (2, None), (None, ""), (3, long), (4, "z" * 40_000), (5, "<|endoftext|> ½")]
    docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_bpe(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_force(rows)


def test_columns_ids_and_empty_tables(spark, docs):
    rows = docs([(1, "ab cd"), (1, "ab cd"), (2, None)]).selectExpr("*", "'mine' AS ids")
    got = bpe.encoded(rows, PUBLIC)
    assert got.columns == [*rows.drop("ids").columns, "ids"]
    kept = bpe.decoded(got.drop("text"), PUBLIC)
    assert sorted((r["doc_id"], r["text"], r["row"]) for r in kept.collect()) == [(1, "ab cd", "r"), (1, "ab cd", "r"), (2, "", "r")]
    assert bpe.decoded(spark.createDataFrame([(None,)], "ids array<int>"), PUBLIC).first()["text"] is None
    assert bpe.digests(bpe.round_trips(docs([]), PUBLIC)).count() == 0
