import hashlib
import random
import re

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tidewatch.llm import chat, html, language, pieces, secrets, sharding, toxicity

SF = "/root/testdata/sf0.01"


# --- pieces -------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def coder():
    return pieces.Pieces(pieces.read_model())


def texts():
    rng = random.Random(3)
    made = ["".join(rng.choice("abcdefgh  \n,.%éß中😀") for _ in range(rng.randint(1, 150))) for _ in range(200)]
    return made + [
        "", " ", "   ", "a", "  a  b ", "a\nb\tc", " " * 40 + "y" + " " * 33, "ﬁ Ａ", "hello<s> <unk> <0x41>", "\x00\r\n",
        "a" * 5000, "ab" * 3000, "中文" * 900, "x%%%,y.", "token=\"9f\"",
    ]


def test_ids_equal_the_merge_procedures_and_texts_come_back(coder):
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    for text in texts():
        ids = coder.encode(text)
        assert ids == library.encode(text), text[:40]
        assert coder.decode(ids) == text
    for text in ("▁", "a▁b ▁", "▁▁ x"):
        assert coder.decode(coder.encode(text)) == text


def test_long_texts_commit_in_steps(coder):
    rng = random.Random(1)
    text = "".join(rng.choice("abcdefghij") for _ in range(4000))
    steps = list(coder.search(text))
    assert len(steps) > 10 and [p for s in steps for p in s] == coder.merged(text)


def test_every_stretch_is_committed_by_the_search(monkeypatch):
    coder, committed = pieces.Pieces(pieces.read_model()), []
    search = coder.search

    def watched(text):
        for step in search(text):
            committed.append("".join(step))
            yield step

    monkeypatch.setattr(coder, "search", watched)
    text = "Short words, then one of " + "qwertyuiopasdfghjklzxcvbnm" * 40_000 + " letters."  # a megabyte without a space
    ids = coder.encode(text)
    assert "".join(committed).replace(pieces.MARK, " ") == " " * bool(coder.prefix) + text
    assert max(map(len, committed)) <= (pieces.LOOK + 30) * coder.width and coder.decode(ids) == text


def test_merging_is_not_quadratic(coder):
    assert "".join(coder.merged("ab" * 200_000)) == "ab" * 200_000


def test_round_trips_equal_the_library(spark, docs):
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rows = [(i, t) for i, t in enumerate(texts())] + [(1, "twice"), (1, "twice"), (None, "no id"), (7, None), (8, "x" * 300_000)]
    got = pieces.round_trips(docs(rows), pieces.read_model()).collect()
    want = [(i, None if t is None else library.encode(t), None if t is None else hashlib.sha256(t.encode()).hexdigest()) for i, t in rows]
    key = lambda r: (r[0] is None, r[0] or 0, r[2] or "")
    assert sorted(((r["doc_id"], r["ids"], r["decoded_sha256"]) for r in got), key=key) == sorted(want, key=key)
    assert all(r["round_trip"] and r["n_ids"] == len(r["ids"] or []) for r in got)
    assert pieces.round_trips(docs([]), pieces.read_model()).count() == 0


def test_unigram_search_finds_the_best_path():
    from sentencepiece import sentencepiece_model_pb2 as spm

    rng = random.Random(2)
    model = spm.ModelProto()
    model.trainer_spec.model_type = pieces.UNIGRAM
    model.normalizer_spec.remove_extra_whitespaces = False
    scores = {"".join(rng.choice("ab") for _ in range(rng.randint(1, 5))): -rng.random() * 9 for _ in range(40)}
    for piece, score in ({"<unk>": 0.0} | scores).items():
        model.pieces.add(piece=piece, score=score, type=2 if piece == "<unk>" else 1)
    for b in range(256):
        model.pieces.add(piece=f"<0x{b:02X}>", score=0.0, type=6)
    coder = pieces.Pieces(model.SerializeToString())
    text = "".join(rng.choice("ab") for _ in range(600))
    best = [0.0] + [-1e9] * len(text)
    for j in range(1, len(text) + 1):
        for i in range(max(0, j - 5), j):
            own = scores.get(text[i:j], coder.unknown if j == i + 1 else None)
            if own is not None:
                best[j] = max(best[j], best[i] + own)
    found = [p for step in coder.search(text) for p in step]
    assert "".join(found) == text
    assert sum(scores.get(p, coder.unknown) for p in found) == pytest.approx(best[-1])


def test_pieces_over_a_table(spark, docs):
    model = pieces.read_model()
    rows = docs([(1, "Some text, twice."), (1, "Some text, twice."), (2, ""), (3, None), (None, "é" * 3)])
    rows = rows.withColumn("ids", F.lit("a clash"))
    back = pieces.decoded(pieces.encoded(rows, model), model, out_col="back")
    got = back.collect()
    assert len(got) == 5 and all(r["text"] == r["back"] for r in got)
    assert next(r for r in got if r["doc_id"] == 2)["ids"] == []
    assert pieces.encoded(rows.limit(0), model).count() == 0
    checked = pieces.encoded(rows.withColumn("same", F.lit(1)), model, check_col="same")
    assert checked.columns == [*rows.drop("ids").columns, "ids", "same"] and all(r["same"] for r in checked.collect())


# --- toxicity -----------------------------------------------------------------------------------


def test_held_out_toxic_documents_are_found(spark):
    rng = random.Random(4)
    usual = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 9))) for _ in range(800)]
    rude = ["zorkish", "vlapper", "quomp"]
    rows, labels = [], []
    for i in range(600):
        words = [rng.choice(usual) for _ in range(rng.randint(5, 120))]
        toxic = i % 4 == 0
        for _ in range(rng.randint(2, 4) if toxic else 0):
            words[rng.randrange(len(words))] = rng.choice(rude) + rng.choice(["", "es", "."])
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    rows += [(9001, None), (9002, ""), (None, "zorkish vlapper")]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    truth = spark.createDataFrame(labels + [(5, None), (None, 1)], "doc_id bigint, toxic int")
    model = toxicity.fit(table, truth)
    got = {r["doc_id"]: r for r in toxicity.scores(table, model).collect()}
    assert len(got) == len(rows)
    held = [(got[i]["predicted"], t) for i, t in labels if got[i]["held_out"]]
    assert len(held) > 60 and np.mean([p == t for p, t in held]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values())
    assert got[9001]["predicted"] == got[9002]["predicted"] == 0
    kept = toxicity.drop_toxic(table, truth, model)
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == sorted(
        -1 if i is None else i for i, r in got.items() if not r["predicted"]
    )
    assert toxicity.scores(table.limit(0), model).count() == 0
    # Without labels nothing is toxic.
    assert toxicity.scores(table, toxicity.fit(table, truth.limit(0))).agg(F.max("predicted")).first()[0] == 0


# --- language -----------------------------------------------------------------------------------


def test_words_back_off_to_shorter_grams():
    model = language.Model(["x", "y"], {"known": [1.0, 0.0]}, {"<ab": [0.0, 2.0], "c": [0.5, 0.0], ">": [0.0, 0.1]})
    assert model.word("known") == [1.0, 0.0]
    assert model.word("abc") == [0.5, 2.1]
    assert model.word("zz") == [0.0, 0.1]
    reader = language.Reader(model)
    assert reader.predict("abc 12!")[0] == "y" and reader.predict("12!") == ("und", 0.0)
    assert reader.predict("known Known abc " * 2000)[0] == "x"


def test_language_of_held_out_documents(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(-1, None, "en"), (-2, "", None), (-3, "12 !?", "fr"), (None, "the", "en")], "doc_id bigint, text string, lang string")
    rows = table.select("doc_id", "text", "lang").unionByName(extra)
    got = language.predictions(rows, language.fit(rows))
    joined = got.join(table.select("doc_id", "lang", "n_chars"), "doc_id").where("held_out AND n_chars > 20")
    right = joined.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert got.count() == rows.count() and right > 0.98
    empty = {r["doc_id"]: r["lang_pred"] for r in got.where("doc_id < 0").collect()}
    assert empty == {-1: "und", -2: "und", -3: "und"}
    assert got.where("score < 0 OR score > 1").isEmpty()


def test_language_without_training_rows(spark):
    rows = spark.createDataFrame([(1, "some words", None)], "doc_id bigint, text string, lang string")
    got = language.predictions(rows, language.fit(rows)).first()
    assert (got["lang_pred"], got["score"]) == ("und", 0.0)


# --- chat ---------------------------------------------------------------------------------------


def test_masks_cover_exactly_the_assistants_texts():
    with open(chat.TOKENIZER, encoding="utf-8") as file:
        tokenizer = chat.load_tokenizer(file.read())
    rng = random.Random(1)
    signs = ["\\", "<turn>", "</turn>", "<text>", "<|endoftext|>", " ", "\n", "a", "é", "中", "😀", "\\0;", "<", "ok"]
    for _ in range(300):
        turns = [
            (rng.choice(["user", "assistant", "x<text>"]), "".join(rng.choice(signs) for _ in range(rng.randint(0, 12))))
            for _ in range(rng.randint(0, 6))
        ]
        formatted, spans = chat.render(turns)
        assert chat.parsed(formatted) == turns
        code = tokenizer.encode(formatted, add_special_tokens=False)
        offsets = np.array(code.offsets, np.int64).reshape(-1, 2)
        mask = chat.mask_of(offsets[:, 0], offsets[:, 1], spans)
        learned = chat.learned_text(formatted, offsets[:, 0].tolist(), offsets[:, 1].tolist(), mask.tolist())
        assert learned == "".join(text for role, text in turns if role == "assistant")


def test_chats_of_a_table(spark):
    rows = [(1, 1, "assistant", " b"), (1, 0, "user", "a"), (2, 0, None, None), (2, 0, None, None), (None, 3, "assistant", "n")]
    table = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id bigint, turn bigint, role string, text string, ids string")
    got = {r["conv_id"]: r for r in chat.digests(chat.format_chats(table)).collect()}
    assert (got[1]["n_turns"], got[1]["loss_chars"]) == (2, 2)
    assert got[1]["turns_sha256"] == hashlib.sha256(b"user\na\nassistant\n b\n").hexdigest()
    assert got[1]["loss_sha256"] == hashlib.sha256(b" b").hexdigest()
    assert (got[2]["n_turns"], got[2]["loss_chars"], got[None]["loss_chars"]) == (2, 0, 1)
    assert chat.digests(chat.format_chats(table.limit(0))).count() == 0


# --- pages --------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("", []),
        ("<article><h1>T &amp; U</h1><p>a<br>b<p>c<b>d</b></article><footer>f</footer>", ["T & U", "a b", "cd"]),
        ("<nav><ul><li>m<article><p>t</p></article>", ["t"]),
        ("<div class='comments'><article><p>reader</p></article></div><article><p>x</p></article>", ["x"]),
        ("<article><p>x</p><aside><p>q</p></aside><form>f</form><div class=ad>z</div></article>", ["x"]),
        ("<article><script>var t='<p>no</p>'</script><style>p{}</style><!-- <p>c</p> --><p>y&nbsp; z</p></article>", ["y z"]),
        ('<article><p title="a>b">x</p></article>', ["x"]),
    ],
)
def test_blocks_of_articles(page, want):
    found = html.blocks(page)
    assert [t for t, p in found if p == html.FIRM] == want


def test_repeated_runs_match_brute_force():
    rng = random.Random(8)
    streams = [[rng.choice("abc") for _ in range(rng.randint(0, 40))] for _ in range(9)] + [[]]
    for run in (1, 3, 5, 6):
        got = html.repeated(streams, run)
        for i, words in enumerate(streams):
            want = np.zeros(len(words), bool)
            for at in range(len(words) - run + 1):
                part = words[at : at + run]
                if any(other[k : k + run] == part for j, other in enumerate(streams) if j != i for k in range(len(other))):
                    want[at : at + run] = True
            assert got[i].tolist() == want.tolist()


def test_articles_and_unique_runs_stay(spark):
    menu = "<div>Home News Sport Weather About us Contact</div>"
    rows = [
        (1, "http://h/1", f"<body>{menu}<div>Only this page says these very words</div></body>"),
        (2, "http://h/2", f"<body>{menu}<article><p>Shared words of an article that is mirrored</p></article></body>"),
        (3, "http://h/3", f"<body>{menu}<article><p>Shared words of an article that is mirrored</p></article></body>"),
        (4, "http://other/1", f"<body>{menu}</body>"),
        (5, None, None),
        (5, None, None),
        (None, "http://h/9", "<p>é</p>"),
    ]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id bigint, url string, html string, host string")
    mirrored = "Shared words of an article that is mirrored"
    for size in (html.PART_BYTES, 10_000):
        got = sorted(((r["page_id"] or 0, r["text"], r["n_chars"]) for r in html.extract(pages, size).collect()))
        assert got == [
            (0, "é", 1), (1, "Only this page says these very words", 36), (2, mirrored, 43), (3, mirrored, 43),
            (4, "Home News Sport Weather About us Contact", 40), (5, "", 0), (5, "", 0),
        ]
    assert html.extract(pages.limit(0)).count() == 0
    assert html.extract(pages, 60).count() == 7


def test_runs_are_compared_over_the_whole_host_however_large(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    notice = "This section moves to another place in the coming spring"
    rows = []
    for i in range(60):
        own = " ".join(word() for _ in range(30))
        extra = f"<div>{notice}</div>" if i in (7, 41) else ""
        inside = f"<article>{extra}<p>{own}</p>loose {own}</article>" if i % 3 == 2 else f"{extra}<div>{own}</div>"
        rows.append((i, f"http://h/{i}", f"<body><nav>{word()}</nav>{inside}</body>"))
    rows += [(90, "http://a/1", f"<div>{notice}</div>"), (91, "http://b/1", "<div>" + "again and again " * 9 + "</div>"), (92, "http://h/1", rows[1][2])]
    streams = {}
    for i, url, page in rows:
        streams.setdefault(url.split("/")[2], []).append((i, html.blocks(page)))
    want = {}
    for found in streams.values():
        marked = html.repeated([" ".join(t for t, _ in f).split(" ") for _, f in found])
        want |= {i: html.main_text([t for t, _ in f], [p for _, p in f], m) for (i, f), m in zip(found, marked)}
    assert notice not in want[7] and notice not in want[41] and notice in want[90]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    for size in (html.PART_BYTES, 500, 60):
        assert {r["page_id"]: r["text"] for r in html.extract(pages, size).collect()} == want


def test_suffix_order_marks_the_words_of_every_page(spark):
    rng = random.Random(6)
    line = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "été"]) + str(rng.randint(0, 9)) for _ in range(n))
    menu, quoted, rows = line(7), line(9), []
    for i in range(40):
        own = f"<p>{line(12)}</p><p>{quoted if i % 4 == 0 else line(4)}</p>"
        rows.append((i, f"http://{'ab'[i % 2]}/{i}", f"<nav>{menu}</nav><article>{own}</article><footer>{line(6)}</footer>"))
        rows.append((100 + i, f"http://open/{i}", f"<div>{menu}</div><div>{line(12)}</div><div>{quoted if i in (3, 30) else ''}</div>"))
    rows += [(90, "http://a/0", rows[0][2]), (90, "http://a/0", rows[0][2]), (91, "http://a/91", None), (92, "http://c/1", rows[0][2])]
    hosts, want = {}, []
    for i, url, page in rows:
        hosts.setdefault(url.split("/")[2], []).append((i, [t for t, _ in html.blocks(page or "")]))
    for found in hosts.values():
        marked = html.repeated([" ".join(t).split(" ") if t else [] for _, t in found])
        want += [(i, t, m.tolist()) for (i, t), m in zip(found, marked)]
    assert sum(any(m) and not all(m) for _, _, m in want) > 70  # among them pages that structure decides
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    for size in (html.PART_BYTES, 500, 60):
        got = [(int(r["page_id"]), r["texts"], r["marked"]) for r in html.marks(pages, size).collect()]
        assert sorted(got) == sorted(want)
    text = {r["page_id"]: r["text"] for r in html.extract(pages, 500).collect()}
    assert text[4].split("\n")[1] == quoted and menu not in text[4]  # an article's paragraph is put back
    assert quoted not in text[103] and text[104] and menu not in text[104]


def test_names_travel_whole():
    rng = random.Random(2)
    texts = [[" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 30)))] for _ in range(50)] + [[]]
    found = html.Suffixes(["h"] * len(texts), texts, 6)
    for at in (slice(a, b) for a, b in zip(found.cuts, found.cuts[1:]) if a < b):
        assert html._unpacked_names(html._packed(found.names[at]), at.stop - at.start).tolist() == found.names[at].tolist()
    runs = {tuple(t[0].split()[k : k + html.RUN]) for t in texts if t for k in range(len(t[0].split()) - html.RUN + 1)}
    assert found.cuts[-1] == len(found.names) == len(runs)


def test_runs_of_equal_names_are_told_apart_by_their_words(spark):
    rng = random.Random(3)
    line = lambda n: " ".join(str(rng.randint(0, 10**6)) for _ in range(n))
    notice = line(8)
    own = [line(20) for _ in range(60)]
    rows = [(i, f"http://{'ab'[i % 2]}/", f"<div>{notice}</div><div>{o}</div>") for i, o in enumerate(own)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    for size in (html.PART_BYTES, 500):  # 64 names for 1,800 runs
        assert {r["page_id"]: r["text"] for r in html.extract(pages, size, 6).collect()} == dict(enumerate(own))


def test_given_pages_give_their_articles(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html.extract(pages).collect()}
    import html as references

    for row in pages.collect():
        inner = re.search(r"<article>(.*)</article>", row["html"], re.S)[1]
        parts = re.split(r"</?(?:p|h1)>", inner.replace("<br>", " "))
        parts = [" ".join(references.unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in parts]
        assert got[row["page_id"]] == "\n".join(p for p in parts if p)


# --- sharding -----------------------------------------------------------------------------------


def test_slots_follow_the_preference_orders():
    names, slots = ("a", "b", "c"), 13
    orders = []
    for name in names:
        digest = hashlib.md5(name.encode()).digest()
        at, step = int.from_bytes(digest[:8], "big") % slots, int.from_bytes(digest[8:], "big") % (slots - 1) + 1
        orders.append([(at + k * step) % slots for k in range(slots)])
    owner = {}
    turn = 0
    while len(owner) < slots:
        slot = next(s for s in orders[turn % 3] if s not in owner)
        owner[slot] = turn % 3
        turn += 1
    assert sharding.fill(names, slots) == [owner[s] for s in range(slots)]
    counts = np.bincount(sharding.fill(sharding.SHARDS))
    assert counts.max() - counts.min() <= 1
    for bad in ((("a",), 12), ((), 13), (("a", "a"), 13)):
        with pytest.raises(ValueError):
            sharding.fill(*bad)


def test_a_lost_shard_moves_few_other_keys():
    before = sharding.fill(sharding.SHARDS)
    after = sharding.fill(sharding.SHARDS[:-1])
    moved = sum(a != b for a, b in zip(before, after) if a != len(sharding.SHARDS) - 1)
    assert moved < 0.1 * len(before)


def test_rows_are_placed_and_written(spark, docs, tmp_path):
    rows = [(i, str(i)) for i in range(300)] + [(5, "5"), (None, "n")]
    table = docs(rows)
    names = ("a", "b", "c", "d")
    owner = sharding.fill(names, 101)
    for r in sharding.assign(table, names, 101).collect():
        key = "" if r["doc_id"] is None else str(r["doc_id"])
        slot = int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % 101
        assert (r["slot"], r["shard"]) == (slot, names[owner[slot]])
    sharding.write_sharded(table, str(tmp_path / "out"), names, 101, parts=3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(rows) and set(table.columns) < set(back.columns)
    assert sharding.assign(table.limit(0)).count() == 0


# --- secrets ------------------------------------------------------------------------------------


def test_candidates_have_exact_places(spark, docs):
    rows = [
        (1, 'é x token = "0123456789abcdef0123" y 4111111111111111 z'), (2, None), (3, ""), (1, "no run here"),
        (None, "A" * 16 + " 😀 " + "b1" * 8 + "\n" + "c" * 5000), (4, "x" * 15),
    ]
    found = secrets.candidates(docs(rows)).collect()
    texts_by = {(r["doc_id"], r["finding"]): r for r in found}
    assert len(found) == 5
    assert texts_by[1, "0123456789abcdef0123"]["before"].endswith('token = "')
    whole = {1: rows[0][1], None: rows[4][1]}
    for r in found:
        assert whole[r["doc_id"]][r["begin"] : r["begin"] + len(r["finding"])] == r["finding"]


def test_forest_removes_false_positives(spark):
    rng = random.Random(6)
    rows = []
    for i in range(240):
        hexes = "".join(rng.choice("0123456789abcdef") for _ in range(32))
        words = " ".join(rng.choice(["these", "words", "recur", "often"]) for _ in range(9))
        value = [f'token = "{hexes}"', "internationalisation", str(rng.randrange(10**17, 10**18)), "name.x@mail.example.org"][i % 4]
        rows.append((i, f"{words} {value} {words}", "src"))
    table = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    labelled = secrets.labelled_by_rule(secrets.candidates(table.where("doc_id < 160")))
    got = secrets.scan(table, secrets.fit(labelled)).where("doc_id >= 160").collect()
    assert len(got) == 80 and all(r["secret"] == (r["doc_id"] % 4 == 0) for r in got)
    plan = secrets.scan(table, secrets.fit(labelled))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    unscored = secrets.scan(table, secrets.fit(labelled.where("label = 2")))
    assert unscored.where("secret AND score IS NULL").count() == 240
    assert secrets.scan(table.limit(0), None).count() == 0
