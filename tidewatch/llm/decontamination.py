"""Benchmark decontamination with a broadcast set of normalised n-grams.

Windows of training words are scanned against the hash set of the benchmark's
windows in two steps. The set of the windows' first two words, as hashes, travels in
the scan's expression and rejects most positions before a window is spelled out. The
others are looked up in a broadcast hash table whose key is the window's text itself,
so this lookup compares whole words and verifies the hit. Built-in functions only.
Both sets hold benchmark rows only, and their sizes are measured: beyond HEADS the
first step is left out, beyond 64 MB the second one is a shuffled join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.llm.common import ascii_lower, broadcast_if_small, checkpointed, free_names

N = 10
BLOCK = 4096
HEADS = 100_000
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Lower-cased words of letters, digits and all characters beyond ASCII; none for null."""
    return F.array_remove(F.split(F.coalesce(ascii_lower(text), F.lit("")), SEPARATORS), "")


def gram(item: Column, i: Column, n: int) -> Column:
    """n words from the i-th on (from 1), or as many as there are. Reads single elements: slice() copies the array."""
    return F.concat_ws(" ", *[F.get(item, i + (k - 1)) for k in range(n)])


def windows(item: Column, n: int) -> Column:
    """The n-word windows of an array of words; a shorter, not empty one is one window."""
    size = F.size(item)
    return F.when(size == 0, F.array().cast("array<string>")).otherwise(
        F.transform(
            F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda i: gram(item, i, n)
        )
    )


def head(item: Column, i: Column, n: int) -> Column:
    """Hash of the first words of the window of n words at i."""
    return F.xxhash64(*[F.get(item, i + (k - 1)) for k in range(min(n, 2))])


def _cells(part: Column, n: int, heads: list[int] | None) -> Column:
    """(at, ngram) of the windows of n words that begin in a block and may be hits."""
    first = F.sequence(F.lit(1), F.least(F.size(part) - n + 1, F.lit(BLOCK)))
    if heads is not None:
        words_at = ", ".join(f"get(part, i + {k - 1})" for k in range(min(n, 2)))
        known = ", ".join(f"{h}L" if h != -(2**63) else "-9223372036854775807L - 1" for h in heads)
        starts = f"sequence(1, least(size(part) - {n} + 1, {BLOCK}))"
        first = F.expr(f"filter({starts}, i -> xxhash64({words_at}) IN ({known}))")
    return F.transform(first, lambda i: F.struct((i - 1).alias("at"), gram(part, i, n).alias("ngram")))


def benchmark_windows(benchmark: DataFrame, n: int = N, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct (item_id string, ngram, n_window) of all items; items without an id or words give none."""
    items = benchmark.select(
        benchmark[f"`{id_col}`"].cast("string").alias("item_id"), words(benchmark[f"`{text_col}`"]).alias("words")
    ).where("item_id IS NOT NULL")
    rows = items.select(
        "item_id",
        F.least(F.size("words"), F.lit(n)).alias("n_window"),
        F.explode(windows(F.col("words"), n)).alias("ngram"),
    )
    return rows.distinct()


def scan(
    docs: DataFrame, benchmark: DataFrame, n: int = N, id_col: str = "doc_id", text_col: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id, n_words, hits) per input row, and the (item_id, ngram) table.

    hits: sorted array of (pos, n_window, ngram), pos counted in words from 0. Texts are
    cut into blocks that overlap by n - 1 words, so no row holds a long text's windows."""
    grams = benchmark_windows(benchmark, n)
    keys = grams.select("ngram", "n_window").distinct()
    keys = broadcast_if_small(keys, F.octet_length("ngram") + 64)
    first = F.split("ngram", " ")
    start = F.when(F.col("n_window") == 1, head(first, F.lit(1), 1)).otherwise(head(first, F.lit(1), 2))
    known = grams.select("n_window", start.alias("head")).distinct()
    few = known.count() <= HEADS
    lengths = {r[0]: None for r in grams.select("n_window").distinct().collect()}  # at most n numbers
    if few:
        for k, h in known.collect():
            lengths[k] = [*(lengths[k] or ()), h]

    texts = docs.select(
        F.monotonically_increasing_id().alias("row"),
        docs[f"`{id_col}`"].alias("doc_id"),
        words(docs[f"`{text_col}`"]).alias("words"),
    )
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0)), F.lit(BLOCK))
    blocks = texts.select("row", "doc_id", "words", F.size("words").alias("n_words"), F.explode(starts).alias("start"))
    blocks = blocks.select(
        "row", "doc_id", "n_words", "start", F.expr(f"slice(words, start + 1, {BLOCK + n - 1})").alias("part")
    )
    part = F.col("part")
    found = [F.when(F.size("part") >= k, _cells(part, k, lengths[k])) for k in sorted(lengths)]
    empty = F.array().cast("array<struct<at:int,ngram:string>>")
    cells = F.concat(*[F.coalesce(x, empty) for x in found]) if found else empty
    rows = blocks.select("row", "doc_id", "n_words", "start", F.posexplode_outer(cells).alias("k", "cell"))
    rows = rows.select(
        "row", "doc_id", "n_words",
        F.expr("start = 0 AND coalesce(k, 0) = 0").alias("opens"),
        (F.col("start") + F.col("cell.at")).alias("pos"),
        F.col("cell.ngram").alias("ngram"),
    )
    hits = rows.join(keys, "ngram", "left").where("n_window IS NOT NULL OR opens")
    hit = F.when(F.col("n_window").isNotNull(), F.struct("pos", "n_window", "ngram"))
    per_row = hits.groupBy("row", "doc_id").agg(
        F.max("n_words").alias("n_words"), F.array_sort(F.collect_list(hit)).alias("hits")
    )
    return per_row, grams.select("item_id", "ngram")


def spans(hits: str = "hits") -> Column:
    """Maximal hit stretches of words, as an array of (begin, until), from sorted hits."""
    return F.expr(
        f"""aggregate({hits}, cast(array() as array<struct<begin:int,until:int>>), (acc, h) ->
            CASE WHEN size(acc) > 0 AND h.pos <= element_at(acc, -1).until
                 THEN concat(slice(acc, 1, size(acc) - 1), array(named_struct('begin', element_at(acc, -1).begin,
                      'until', greatest(element_at(acc, -1).until, h.pos + h.n_window))))
                 ELSE concat(acc, array(named_struct('begin', h.pos, 'until', h.pos + h.n_window))) END)"""
    )


def n_hit(hits: str = "hits") -> Column:
    """Words inside any hit window."""
    return F.expr(
        f"""aggregate({hits}, named_struct('n', 0L, 'until', 0), (acc, h) -> named_struct(
            'n', acc.n + greatest(0, h.pos + h.n_window - greatest(acc.until, h.pos)),
            'until', greatest(acc.until, h.pos + h.n_window)), acc -> acc.n)"""
    )


def contamination(
    docs: DataFrame, benchmark: DataFrame, n: int = N, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A null or wordless text has no words and no hit; rows that repeat an id keep a row each;
    null ids are kept; an empty benchmark leaves every document clean; an empty table gives
    no rows. Only the named columns are read."""
    per_row, members = scan(docs, benchmark, n, id_col, text_col)
    per_row = checkpointed(per_row)  # read twice below; row numbers must be the same in both
    base = per_row.select("row", "doc_id", "n_words", n_hit().alias("n_hit"), F.expr("transform(hits, h -> h.ngram)").alias("grams"))
    members = broadcast_if_small(members, F.octet_length("ngram") + F.octet_length("item_id") + 64)
    pairs = base.select("row", F.explode(F.array_distinct("grams")).alias("ngram")).join(members, "ngram")
    items = pairs.groupBy("row").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    joined = base.drop("grams").join(items, "row", "left")
    found = F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(
        "doc_id",
        F.col("n_words").cast("bigint").alias("n_words"),
        F.col("n_hit").cast("bigint").alias("n_hit"),
        F.size(found).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(found, ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def _scanned_texts(docs: DataFrame, benchmark: DataFrame, n: int, text_col: str) -> tuple[Column, DataFrame]:
    """(the key of a row's text, the rows (doc_id = key, hits) of texts that hold a window)."""
    digest = F.unhex(F.sha2(docs[f"`{text_col}`"].cast("binary"), 256))
    texts = docs.select(digest.alias("text_key"), docs[f"`{text_col}`"].alias("text"))
    hit = scan(texts, benchmark, n, "text_key", "text")[0].where(F.size("hits") > 0)
    return F.coalesce(digest, F.lit(b"")), hit  # a null text has no words


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, n: int = N, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of `docs` without any benchmark window.

    Each row is decided by its own text, known by its digest; ids may be null or repeat, columns
    may have any names, an empty table gives no rows."""
    key, hit = _scanned_texts(docs, benchmark, n, text_col)
    own, bad = free_names(docs, "own_text", "bad_text")
    bad_texts = hit.select(F.col("doc_id").alias(bad)).distinct()
    return docs.withColumn(own, key).join(bad_texts, F.col(own) == F.col(bad), "left_anti").drop(own)


def remove_spans(
    docs: DataFrame, benchmark: DataFrame, n: int = N, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """All rows of `docs`, one for one; in contaminated texts the hit words go, with the separators that follow them.

    Each row is cut by its own text, known by its digest; ids may be null or repeat, columns may have
    any names. Kept words and separators stay as they were; a null text stays null."""
    key, hit = _scanned_texts(docs, benchmark, n, text_col)
    own, cut, cuts = free_names(docs, "own_text", "cut_text", "cut_spans")
    found = hit.select(F.col("doc_id").alias(cut), spans().alias(cuts)).dropDuplicates([cut])  # equal texts, equal spans
    rows = docs.withColumn(own, key).join(found, F.col(own) == F.col(cut), "left")
    piece = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"
    head = F.regexp_extract(F.col(f"`{text_col}`"), r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*", 0)
    kept = F.filter(
        F.regexp_extract_all(F.col(f"`{text_col}`"), F.lit(piece), F.lit(0)),
        lambda _, i: ~F.exists(cuts, lambda s: (i >= s["begin"]) & (i < s["until"])),
    )
    text = F.when(F.col(cuts).isNull(), F.col(f"`{text_col}`")).otherwise(F.concat(head, F.array_join(kept, "")))
    return rows.withColumn(text_col, text).drop(own, cut, cuts)
