"""Spelling variants of the corpus's words through a dictionary of pairs of trie nodes.

The words' prefixes are the nodes of a forward trie and their suffixes those of a reversed
one. A word that skips its code point i is the pair (node of what comes before i, node of
what comes behind), and the word itself, cut at i, is such a pair too. Words that differ by
one replaced code point share a skipped pair, and a word shares its cut pair with the words
that have one code point inserted there. Node numbers are equal exactly if the strings are,
so what meets in a pair needs no check.

Tries are numbered from sorted words: a node is its depth and the first word below it, and
what a word shares with the one before it is all there is to know. Partitions are joined by
the last word of each.

Whoever shares a pair is the pair's two strings with at most one code point between them:
a pair never has more words than a word's alphabet has code points, twice. Each pair tells
its members how many near words they have there and which is the most frequent; pairs of
words are never listed.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import takewhile

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.llm.common import ascii_lower, checkpointed

#: Runs of A-Z, a-z and U+00C0 to U+00FF, after lower-casing.
RUN = "[a-zÀ-ÿ]+"
SHORTEST, LEAST_COUNT = 7, 2
#: One in so many occurrences loses a code point.
DAMAGED = 31
#: A form is so many times more frequent than its variant.
RATIO = 10


def damaged(doc_id: Column, run: Column) -> Column:
    """The lower-cased run, without one code point where DAMAGED divides its checksum."""
    code = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (code % F.length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(code % DAMAGED == 0, cut).otherwise(run)


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): words of at least SHORTEST code points that occur LEAST_COUNT times or more."""
    runs = F.regexp_extract_all(ascii_lower(docs[f"`{text_col}`"]), F.lit(RUN), F.lit(0))
    rows = docs.select(docs[f"`{id_col}`"].alias("doc_id"), F.explode(runs).alias("run")).where(F.length("run") >= SHORTEST)
    words = rows.select(damaged(F.col("doc_id"), F.col("run")).alias("word")).where(F.length("word") >= SHORTEST)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


#: A node's number: the first word below it, and in the lowest bits its depth.
DEPTH_BITS = 24


def shared_length(a: str, b: str) -> int:
    """Code points that two words have in common at their begin."""
    return sum(1 for _ in takewhile(lambda ab: ab[0] == ab[1], zip(a, b)))


def first_words(words: Iterator[str], at: int, before: str | None, path: list[int]) -> Iterator[tuple[int, str, list[int]]]:
    """(number, word, path) of sorted words: for each depth the number of the first word with that prefix."""
    for word in words:
        same = shared_length(before, word) + 1 if before is not None else 0
        path = path[:same] + [at] * (len(word) + 1 - same)
        yield at, word, path
        at, before = at + 1, word


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a sorted partition: its number, size, first and last word, and the last one's path."""
    words = (w for batch in batches for w in batch.column("word").to_pylist())
    first = last = None
    for last in first_words(words, 0, None, []):
        first = first or last
    if last is not None:
        row = [TaskContext.get().partitionId(), last[0] + 1, first[1], last[1], last[2]]
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], ["part", "size", "first", "last", "path"])


def trie_paths(words: DataFrame, keep: list[str]) -> DataFrame:
    """`keep`, and rank and path of distinct, not null words: in sorted order the word's number, and the
    numbers of the trie's nodes from the root to the word."""
    ordered = checkpointed(words.repartitionByRange("word").sortWithinPartitions("word"))
    ends = ordered.select("word").mapInArrow(_ends, "part bigint, size bigint, first string, last string, path array<bigint>")
    begins: dict[int, tuple[int, str | None, list[int]]] = {}
    at, before, path = 0, None, []
    for part in sorted(ends.collect()):  # two words of each partition
        begins[part["part"]] = (at, before, path)
        same = shared_length(before, part["first"]) + 1 if before is not None else 0
        same = min(same, shared_length(part["first"], part["last"]) + 1)
        path = path[:same] + [at + k for k in part["path"][same:]]
        at, before = at + part["size"], part["last"]

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, before, path = begins.get(TaskContext.get().partitionId(), (0, None, []))
        for batch in batches:
            ranks, paths = [], []
            for rank, word, path in first_words(batch.column("word").to_pylist(), at, before, path):
                ranks.append(rank)
                paths.append((np.array(path, np.int64) << DEPTH_BITS) + np.arange(len(path)))
                before = word
            at += batch.num_rows
            columns = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(ranks, pa.int64()), pa.array(paths, pa.list_(pa.int64()))], names)

    names = [*keep, "rank", "path"]
    types = dict(words.dtypes)
    return ordered.mapInArrow(numbered, ", ".join([f"{c} {types[c]}" for c in keep] + ["rank bigint", "path array<bigint>"]))


def node_pairs(words: DataFrame) -> DataFrame:
    """(prefix, suffix, n, id, kind) of words (id, word, n, path): what each is cut at (kind 0) or skips (1, 2).

    Kind 1 is the skip of one of several equal neighbours, but for the last: a place of
    replacements, not of insertions, for which the last one stands for all of them."""
    back = words.select("id", F.reverse("word").alias("word"))
    back = trie_paths(back, ["id"]).select("id", F.reverse("path").alias("behind"))
    nodes = words.join(back, "id")
    cut = "transform(path, (p, i) -> struct(p AS prefix, behind[i] AS suffix, 0 AS kind))"
    skip = """transform(sequence(0, length(word) - 1), i -> struct(path[i] AS prefix, behind[i + 1] AS suffix,
              IF(i + 1 < length(word) AND substring(word, i + 1, 1) = substring(word, i + 2, 1), 1, 2) AS kind))"""
    return nodes.select("id", "n", F.explode(F.expr(f"concat({cut}, {skip})")).alias("p")).select(
        "p.prefix", "p.suffix", "n", "id", "p.kind"
    )


def near_words(words: DataFrame) -> DataFrame:
    """(id, n_near, best) of the words (id, word, n, path) that have a near word; best: struct(less, id).

    Two words are near if one inserted, deleted or replaced code point makes them equal. Ids go
    in the words' order, so the best is the one of largest n (less: its negative) and smallest id."""
    member = F.struct((-F.col("n")).alias("less"), "id", "kind")
    pairs = node_pairs(words).groupBy("prefix", "suffix").agg(F.array_sort(F.collect_list(member)).alias("members"))
    # A pair has few members, as the module's text says; most have one.
    pairs = pairs.where(F.size("members") > 1).select(
        F.expr("filter(members, m -> m.kind > 0)").alias("skips"),
        F.expr("get(filter(members, m -> m.kind = 0), 0)").alias("whole"),
        F.expr("filter(members, m -> m.kind = 2)").alias("inserts"),
    )
    best = lambda m: f"named_struct('less', {m}.less, 'id', {m}.id)"
    none = "cast(null as struct<less:bigint,id:bigint>)"
    told = f"""concat(
        transform(skips, (m, i) -> named_struct('id', m.id, 'n_near', size(skips) - 1L,
            'best', IF(size(skips) > 1, {best("get(skips, IF(i = 0, 1, 0))")}, {none}))),
        transform(IF(whole IS NULL, array(), inserts), m -> named_struct('id', m.id, 'n_near', 1L, 'best', {best("whole")})),
        IF(whole IS NULL, array(), array(named_struct('id', whole.id, 'n_near', size(inserts) + 0L,
            'best', IF(size(inserts) > 0, {best("get(inserts, 0)")}, {none})))))"""
    found = pairs.select(F.explode(F.expr(told)).alias("t")).select("t.*").where("n_near > 0")
    return found.groupBy("id").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def grouped(words: DataFrame) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of distinct words (word, n).

    form: the most frequent near word (ties: the first in code-point order) if it is RATIO times as
    frequent as the word; root: the last of the forms that follow from the word, or itself."""
    words = checkpointed(trie_paths(words, ["word", "n"]).withColumnRenamed("rank", "id"))
    near = near_words(words)
    is_form = -F.col("best.less") >= RATIO * F.col("n")
    rows = checkpointed(
        words.drop("path").join(near, "id", "left").select(
            "id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(is_form, F.col("best.id")).alias("form_id"),
        )
    )
    # Counts grow at least RATIO-fold from form to form, so there are few steps, halved by jumping.
    steps = rows.where("form_id IS NOT NULL").select("id", F.col("form_id").alias("root_id"))
    while True:
        further = steps.select(F.col("id").alias("via"), F.col("root_id").alias("last"))
        jumped = checkpointed(steps.join(further, steps["root_id"] == further["via"], "left").select("id", "root_id", "last"))
        steps = jumped.select("id", F.coalesce("last", "root_id").alias("root_id"))
        if jumped.where("last IS NOT NULL").isEmpty():
            break
    forms = rows.select(F.col("id").alias("form_id"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    roots = rows.select(F.col("id").alias("root_id"), F.col("word").alias("root"))
    named = steps.join(roots, "root_id").select("id", "root").join(
        rows.where("form_id IS NOT NULL").select("id", "form_id").join(forms, "form_id"), "id"
    )
    return rows.join(named.select("id", "form", "form_n", "root"), "id", "left").select(
        "word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root")
    )


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Variants of the words of whole texts: word, n, n_near, form, form_n, root.

    A null text has no words; a null id is an empty string in the checksum; rows that repeat
    count again; an empty table gives no rows; other columns are never read."""
    return grouped(counted(docs, id_col, text_col))
