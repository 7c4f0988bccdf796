import corpus_pipeline
from tidewatch.llm import decontamination, exact_dedup, pieces, simhash, toxicity

SF = "/root/testdata/sf0.001"


def test_each_stage_takes_what_the_last_one_kept(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash", "decontamination", "pieces"]

    # Each stage from its operator's decisions, row by row.
    rows = {r["doc_id"]: r for r in docs.collect()}
    scored = toxicity.scores(docs, toxicity.fit(docs, labels)).collect()
    left = {r["doc_id"] for r in scored if not r["predicted"]}
    groups = {}
    for i in left:
        groups.setdefault((rows[i]["text"] or "").encode().lower(), []).append(i)
    left = {max(ids) for ids in groups.values()}
    codes = {i: simhash.fingerprint((rows[i]["text"] or "").encode().lower()) for i in left}
    label = {i: i for i in left}
    while True:
        near = {i: min(label[j] for j in left if (codes[i] ^ codes[j]).bit_count() <= 2) for i in left}
        if near == label:
            break
        label = near
    left = set(label.values())
    found = decontamination.contamination(docs, benchmark).collect()
    left -= {r["doc_id"] for r in found if r["contaminated"]}

    got = corpus_pipeline.run(spark, SF)
    assert got.columns == [*docs.columns, "ids", "round_trip"]
    kept = got.collect()
    assert {r["doc_id"] for r in kept} == left and len(kept) == len(left)
    coder = pieces.Pieces(pieces.read_model())
    assert all(r["round_trip"] and coder.decode(r["ids"]) == r["text"] and r["lang"] == rows[r["doc_id"]]["lang"] for r in kept)


def test_stages_take_nulls_repeats_and_empty_tables(spark, docs):
    table = docs([(1, "a b c"), (1, "a b c"), (2, None), (3, ""), (None, "x y z w"), (4, "A b c")])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, table, SF)
        assert set(table.columns) <= set(out.columns), name
        assert out.count() <= 6
        assert stage(spark, table.limit(0), SF).count() == 0
    assert exact_dedup.drop_exact_duplicates(table).count() == 3
