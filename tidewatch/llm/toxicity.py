"""Toxicity by compression distance.

Two zstandard dictionaries of equal size are trained on a bounded labelled sample, one
from toxic and one from ordinary text. A window of a text is compressed with either;
it is the nearer to toxic text the more bytes the toxic dictionary saves. A text's
windows give three figures (largest saving, sum of the three largest, rate of windows
above a learned saving), and a logistic curve fitted on the sample turns them into a
score with 0.5 as its threshold.

Windows are single words: stems the dictionaries hold save whole bytes there, while
longer windows mix them with noise (measured on held-out labels: area under the curve
0.95 with three words, over 0.99 with one). Each window is compressed in front of a
fixed closing text that both dictionaries end with, for zstandard finds no matches in a
block's last bytes and stores tiny blocks as they are. Equal windows are compressed
once per task.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

GRAM = 5
CLOSING = b" | end of window |"
FOLDS, HELD_OUT = 5, 0
SAMPLE = {1: 1500, 0: 3000}
LONGEST = 1_000_000
MEMO = 300_000


def _grams(word: str) -> set[bytes]:
    raw = b" " + word.encode()
    return {raw[i : i + GRAM] for i in range(len(raw) - GRAM + 1)}


def _frequency(texts: list[list[str]]) -> Counter:
    """In how many texts each gram occurs."""
    found: Counter = Counter()
    for words in texts:
        grams: set[bytes] = set()
        for word in words:
            grams |= _grams(word)
        found.update(grams)
    return found


def _grow(gram: bytes, words: Counter, useful: set[bytes]) -> bytes:
    """The gram, longer by the bytes that nearly always stand beside it, of useful grams only."""
    holders = [(b" " + w.encode(), n) for w, n in words.items() if gram in b" " + w.encode()]
    grown = gram
    while True:
        left, right, total = Counter(), Counter(), 0
        for raw, n in holders:
            at = raw.find(grown)
            if at >= 0:
                total += n
                left[raw[at - 1 : at] if at else b""] += n
                right[raw[at + len(grown) : at + len(grown) + 1]] += n
        for side, joined in ((left, lambda b, g=grown: b + g), (right, lambda b, g=grown: g + b)):
            byte, n = max(side.items(), key=lambda kv: (kv[1], kv[0]), default=(b"", 0))
            longer = joined(byte)
            if byte and n >= 0.7 * total and {longer[:GRAM], longer[-GRAM:]} <= useful:
                grown = longer
                break
        else:
            return grown


def train_dictionary(own: list[list[str]], other: list[list[str]], lift: float, size: int) -> bytes:
    """Stretches of bytes that cover the texts of `own` and are rarer in `other`, the most useful last.

    Grams are taken greedily by the number of texts they cover that are not covered four
    times yet, and grown to the stretch they belong to."""
    mine, theirs = _frequency(own), _frequency(other)
    floor = max(3, len(own) // 300)

    def contrast(gram: bytes) -> float:
        return math.log((mine[gram] + 0.5) / (len(own) + 1)) - math.log((theirs[gram] + 0.5) / (len(other) + 1))

    useful = {g for g, n in mine.items() if n >= floor and contrast(g) > lift}
    words: Counter = Counter()
    holds: list[set[bytes]] = []
    for text in own:
        grams: set[bytes] = set()
        for word in text:
            if hit := _grams(word) & useful:
                grams |= hit
                words[word] += 1
        holds.append(grams)
    where: dict[bytes, list[int]] = {}
    for i, grams in enumerate(holds):
        for gram in grams:
            where.setdefault(gram, []).append(i)
    need = [4] * len(own)
    parts: list[bytes] = []
    while where and sum(map(len, parts)) < size:
        gains = {g: sum(need[i] > 0 for i in at) for g, at in where.items()}
        gram = max(gains, key=lambda g: (gains[g] * contrast(g), g))
        if gains[gram] < floor:
            break
        part = _grow(gram, words, useful)
        parts.append(part)
        covered = [g for g in where if g in part]
        for i in {i for g in covered for i in where[g]}:
            need[i] -= 1
        for g in covered:
            del where[g]
        where.pop(gram, None)
    return b"".join(reversed(parts))[-size:]


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters(
        window_log=14, chain_log=14, hash_log=14, search_log=6, min_match=5, target_length=32,
        strategy=zstandard.STRATEGY_LAZY2, format=zstandard.FORMAT_ZSTD1_MAGICLESS,
        write_content_size=0, write_checksum=0, write_dict_id=0,
    )
    words = zstandard.ZstdCompressionDict(content + CLOSING, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(dict_data=words, compression_params=params)


@dataclass
class Model:
    """The two dictionaries, the saving that marks a window, and the curve."""

    toxic: bytes
    plain: bytes
    mark: int
    weights: list[float]

    def savings(self, texts: Iterator[list[str]]) -> Iterator[np.ndarray]:
        """By text, the bytes each window saves with the toxic dictionary."""
        toxic, plain = _compressor(self.toxic).compress, _compressor(self.plain).compress
        memo: dict[str, int] = {}
        for words in texts:
            if len(memo) > MEMO:
                memo.clear()
            for word in set(words).difference(memo):
                raw = b" " + word.encode() + CLOSING
                memo[word] = len(plain(raw)) - len(toxic(raw))
            yield np.fromiter(map(memo.__getitem__, words), np.int64, len(words))

    def figures(self, saved: np.ndarray) -> list[float]:
        if not len(saved):
            return [1.0, 0.0, 0.0, 0.0]
        top = np.sort(saved)[-3:]
        rate = np.count_nonzero(saved >= self.mark) / (len(saved) + 20)
        return [1.0, float(top[-1]), float(np.maximum(top, 0).sum()), 20 * float(rate)]

    def score(self, saved: np.ndarray) -> float:
        return 1 / (1 + math.exp(-float(np.clip(np.dot(self.weights, self.figures(saved)), -30, 30))))


def _fit_curve(rows: np.ndarray, labels: np.ndarray) -> list[float]:
    """Logistic regression by Newton steps with a small ridge."""
    weights = np.zeros(rows.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(rows @ weights, -30, 30)))
        slope = rows.T @ (p - labels) + 0.01 * weights
        curve = (rows * (p * (1 - p))[:, None]).T @ rows + 0.01 * np.eye(len(weights))
        step = np.linalg.solve(curve, slope)
        weights -= step
        if np.abs(step).max() < 1e-6:
            break
    return weights.tolist()


def fit_texts(toxic: list[str], plain: list[str]) -> Model:
    """The model of labelled texts on the driver. Without toxic texts every score is low."""
    own, other = [t.lower().split() for t in toxic], [t.lower().split() for t in plain]
    distinct = [[*dict.fromkeys(t)] for t in own], [[*dict.fromkeys(t)] for t in other]
    near = train_dictionary(distinct[0], distinct[1], 2.0, 2048)
    common = Counter(w for t in distinct[1] for w in t if not any(g in near for g in _grams(w)))
    usual = sorted(common, key=lambda w: (common[w], w))[-2000:]
    far = b"".join(b" " + w.encode() for w in usual)[-max(1, len(near)) :]
    far = b" " * (len(near) - len(far)) + far
    model = Model(near or b" ", far or b" ", 1, [])
    saved = list(model.savings(iter(own + other)))
    labels = np.array([1.0] * len(own) + [0.0] * len(other))
    if not own or not other:
        model.weights = [-5.0 if not own else 0.0, 0.0, 0.0, 0.0]
        return model
    # The mark: the saving whose presence in a text agrees best with the labels.
    most = np.array([s.max(initial=0) for s in saved])
    model.mark = max(range(1, 12), key=lambda m: (((most >= m) == labels) * np.where(labels, len(other), len(own))).sum())
    model.weights = _fit_curve(np.array([model.figures(s) for s in saved]), labels)
    return model


def fold(doc_id: Column, folds: int = FOLDS) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def fit(docs: DataFrame, labels: DataFrame, sample: dict[int, int] | None = None, longest: int = LONGEST) -> Model:
    """A model from a bounded sample of the labelled documents whose fold is not the held-out one: at
    most about `sample` ids of each class, chosen by a hash, twice as many rows in all where ids
    repeat, and no text of more than `longest` bytes.

    Rows without an id or label teach nothing; of several labels of an id the largest counts."""
    sample = sample or SAMPLE
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(fold(F.col("doc_id")) != HELD_OUT)
    sizes = dict(known.groupBy("toxic").count().collect())
    share = F.lit(0.0)
    for label, most in sample.items():
        share = F.when(F.col("toxic") == label, F.lit(min(1.0, most / max(1, sizes.get(label, 1))))).otherwise(share)
    # About as many rows as `sample` names, of two numbers each: small enough to broadcast at any size.
    known = F.broadcast(known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < share * 1_000_003))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.octet_length("text") <= longest)
    drawn = texts.join(known, "doc_id").orderBy(F.xxhash64("doc_id", "text"), "text").limit(2 * sum(sample.values()))
    rows = drawn.select("toxic", "text").collect()  # bounded by `sample`
    rows.sort()
    return fit_texts([t for x, t in rows if x == 1], [t for x, t in rows if x == 0])


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Null and wordless texts get the curve's value without any saving. Ids may be null (never
    held out) or repeat. An empty table gives no rows. Only the named columns are read."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[list[str]] = []

        def feed() -> Iterator[list[str]]:
            while True:
                yield texts[0]

        saved = model.savings(feed())
        for batch in batches:
            found = []
            for text in batch.column(1):
                texts[:] = [(text.as_py() or "").lower().split()]
                found.append(model.score(next(saved)))
            columns = [batch.column(0), pa.array(found, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score"])

    rows = docs.select(docs[f"`{id_col}`"].cast("bigint").alias("doc_id"), docs[f"`{text_col}`"].alias("text"))
    rows = rows.mapInArrow(scored, "doc_id bigint, score double")
    return rows.select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """The rows of `docs` that are not predicted toxic, with all their columns. The text is scored in
    place, so rows need no join and no unique id."""
    model = model or fit(docs, labels)
    names = docs.columns

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[list[str]] = []

        def feed() -> Iterator[list[str]]:
            while True:
                yield texts[0]

        saved = model.savings(feed())
        for batch in batches:
            fine = []
            for text in batch.column(names.index("text")):
                texts[:] = [(text.as_py() or "").lower().split()]
                fine.append(model.score(next(saved)) < 0.5)
            yield batch.filter(pa.array(fine, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
