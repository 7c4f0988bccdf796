"""Language identification by words first, then by shorter and shorter character n-grams.

Known words are scored by their log frequency in each language. An unseen word is taken
apart: the longest n-gram (5 down to 1 characters, with word marks) that the model knows
is scored at each place and the next place begins behind it. Counts cover every training text; the
model keeps at most `WORDS` frequent words and `GRAMS` n-grams of each language, which
bounds what is sent to the executors.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.llm.common import broadcast_if_small, checkpointed

FOLDS, HELD_OUT = 4, 2
WORDS, GRAMS, LONGEST = 20_000, 20_000, 5
#: What a worker remembers: so many words, each of at most so many letters.
MEMO, REMEMBERED = 400_000, 64
UNKNOWN = "und"


def _class(kinds: str, until: int = sys.maxunicode + 1) -> str:
    """All characters below `until` of some general categories, as ranges of a character class."""
    found = [c for c in range(until) if unicodedata.category(chr(c))[0] in kinds]
    begins = [c for c, before in zip(found, [-2, *found]) if c != before + 1]
    ends = [c for c, behind in zip(found, [*found[1:], -2]) if c + 1 != behind]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(begins, ends))


@lru_cache(maxsize=1)
def _patterns() -> tuple:
    """Finders of words: a letter with the letters and combining marks that follow; numbers and signs are no letters.

    The first is for texts of Latin-1, which has no marks: the same with a small character class."""
    return re.compile(f"[{_class('L', 256)}]+").findall, re.compile(f"[{_class('L')}][{_class('LM')}]*+").findall


def words(text: str) -> list[str]:
    """Lower-cased runs of letters with their marks."""
    text = text.lower()
    latin, any_text = _patterns()
    return latin(text) if len(text.encode("latin-1", "ignore")) == len(text) else any_text(text)


def grams(word: str, n: int) -> list[str]:
    marked = f"<{word}>"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


ENTRIES = pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])
HELD = 300_000


def _flushed(counts: dict[str, Counter]) -> pa.RecordBatch:
    rows = ((lang, entry, n) for lang, found in counts.items() for entry, n in found.items())
    columns = list(zip(*rows)) or [(), (), ()]
    counts.clear()
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, ENTRIES.types)], schema=ENTRIES)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to partial (lang, word, n); at most about HELD entries and one text's are held."""
    counts: dict[str, Counter] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            counts.setdefault(lang, Counter()).update(words(text.as_py()))
            if sum(map(len, counts.values())) > HELD:
                yield _flushed(counts)
    yield _flushed(counts)


def _taken_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n) to partial counts of n-grams; at most about HELD entries are held."""
    counts: dict[str, Counter] = {}
    for batch in batches:
        for lang, word, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
            own = counts.setdefault(lang, Counter())
            found = [gram for size in range(1, LONGEST + 1) for gram in grams(word, size)]
            if n == 1:
                own.update(found)
            else:
                for gram in found:
                    own[gram] += n
            if len(own) > HELD:
                yield _flushed(counts)
    yield _flushed(counts)


@dataclass
class Model:
    """Log frequencies by language of words and n-grams, relative to the mean of all languages."""

    langs: list[str]
    words: dict[str, list[float]]
    grams: dict[str, list[float]]

    def word(self, word: str) -> list[float]:
        """The word's evidence for each language."""
        known = self.words.get(word)
        if known is not None:
            return known
        marked, at, found = f"<{word}>", 0, []
        size = len(marked)
        while at < size:
            for until in range(min(at + LONGEST, size), at, -1):
                known = self.grams.get(marked[at:until])
                if known is not None:
                    found.append(known)
                    break
            at = until
        return [sum(column) for column in zip(*found)] if found else [0.0] * len(self.langs)


class Reader:
    """A model at work in one task: words met before are rows of a table, and a text is a sum of rows."""

    def __init__(self, model: Model):
        self.model = model
        self.table = np.zeros((1024, max(1, len(model.langs))))
        reader = self

        class Places(dict):
            def __missing__(self, word: str) -> int:
                """Place 0 is for words too long to be remembered; their evidence is added by itself."""
                if len(word) > REMEMBERED:
                    return 0
                place = len(self)
                if place == len(reader.table):
                    reader.table = np.vstack([reader.table, np.zeros_like(reader.table)])
                reader.table[place] = model.word(word)
                self[word] = place
                return place

        self.places = Places({"": 0})

    def predict(self, text: str) -> tuple[str, float]:
        found = words(text)
        if not found or not self.model.langs:
            return UNKNOWN, 0.0
        if len(self.places) > MEMO:
            self.places.clear()
            self.places[""] = 0
        rows = np.fromiter(map(self.places.__getitem__, found), np.int64, len(found))
        total = self.table[rows].sum(axis=0)
        for word in found:
            if len(word) > REMEMBERED:
                total = total + self.model.word(word)
        best = int(total.argmax())
        return self.model.langs[best], float(1 / np.exp(np.clip(total - total[best], -700, 0)).sum())


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def _largest(counts: DataFrame, most: int) -> DataFrame:
    """The entries that are among the most frequent of any language, at most `most` of each, with their
    counts in every language. Levels of an eighth of a doubling are taken whole from the top, so that
    only a few hundred level sizes reach the driver; of the level that does not fit, the first by a hash."""
    level = F.floor(8 * F.log2("n"))
    sizes: dict[str, list[tuple[int, int]]] = {}
    for lang, at, entries in counts.groupBy("lang", level).count().collect():
        sizes.setdefault(lang, []).append((at, entries))
    keep, place = F.lit(False), F.pmod(F.xxhash64("word"), F.lit(1_000_003))
    for lang, levels in sizes.items():
        left, least, share = most, None, 1.0
        for at, entries in sorted(levels, reverse=True):
            if left <= 0:
                break
            least, share = at, min(1.0, left / entries)
            left -= entries
        whole = (level > least) | ((level == least) & (place < share * 1_000_003))
        keep = keep | ((F.col("lang") == lang) & whole)
    kept = counts.where(keep).select("word").distinct()
    return counts.join(broadcast_if_small(kept, F.octet_length("word") + 64), "word", "left_semi")


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model from every text with a language whose fold is not held out.

    Rows without an id, text or language teach nothing; without training rows nothing is learned
    and every prediction is `und`."""
    doc_id = docs[f"`{id_col}`"]
    rows = docs.where(doc_id.isNotNull() & (fold(doc_id) != HELD_OUT))
    rows = rows.select(docs[f"`{lang_col}`"].alias("lang"), docs[f"`{text_col}`"].alias("text")).na.drop()
    schema = "lang string, word string, n bigint"

    counts = checkpointed(rows.mapInArrow(_counted, schema).groupBy("lang", "word").agg(F.sum("n").alias("n")))
    pieces = checkpointed(counts.mapInArrow(_taken_apart, schema).groupBy("lang", "word").agg(F.sum("n").alias("n")))
    totals = {r[0]: r[1] for r in counts.groupBy("lang").agg(F.sum("n")).collect()}
    langs = sorted(totals)

    def logs(stored: DataFrame, most: int) -> dict[str, list[float]]:
        """Smoothed log shares by entry, relative to the mean of all languages; an entry with no language ahead is 0."""
        if not langs:
            return {}
        by_lang = [F.sum(F.when(F.col("lang") == lang, F.col("n"))).alias(f"n{i}") for i, lang in enumerate(langs)]
        found = _largest(stored, most).groupBy("word").agg(*by_lang).toArrow()  # at most `most` entries a language
        counts = np.stack([c.to_numpy() for c in found.columns[1:]], 1).astype(float)
        shares = (np.nan_to_num(counts) + 0.5) / (np.array([totals[lang] for lang in langs]) + most)
        return dict(zip(found.column(0).to_pylist(), np.log(shares / shares.mean(1, keepdims=True)).tolist()))

    return Model(langs, logs(counts, WORDS), logs(pieces, GRAMS))


def predictions(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score.

    `und` with score 0 where the text is null or has no letter; other columns are never read.
    Ids may be null (never held out) or repeat; an empty table gives no rows."""

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model)
        for batch in batches:
            found = [reader.predict(t.as_py() or "") for t in batch.column(1)]
            langs, scores = zip(*found) if found else ((), ())
            columns = [batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score"])

    rows = docs.select(docs[f"`{id_col}`"].cast("bigint").alias("doc_id"), docs[f"`{text_col}`"].alias("text"))
    rows = rows.mapInArrow(predicted, "doc_id bigint, lang_pred string, score double")
    held_out = F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False))
    return rows.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
