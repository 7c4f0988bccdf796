"""Hard-negative mining with exact integer scores from float32 matrix products.

Components are integers. A block of anchors meets rows as matrices of residues modulo a few
small primes, near zero and so small that every partial sum of a product is an integer that
float32 holds exactly. The products' residues give back the signed score by Chinese
remaindering in mixed radix. The number of primes follows from the largest norm.

Anchors are dealt into blocks and rows into a fixed number of parts. A task holds one block
of anchors, streams one part's rows past it and keeps a few rows for each anchor, so neither
a common vector nor a common label makes anything larger. Two such passes are made: the
first keeps each anchor's best rows of its own label, the second, with those positives'
scores as windows, the best rows of other labels in each window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidewatch.llm.common import checkpointed

SCALE = 256
POSITIVES, NEGATIVES = 5, 5
#: A negative scores between this share (in percent) of the positive's score and all of it.
LEAST_PERCENT = 80
#: Anchors of a block, and parts the rows are dealt into: tasks are parts times blocks, whatever the rows.
ANCHOR_BLOCK, PARTS = 32768, 32
#: Rows, and anchors, whose scores are held at once.
ROWS, HELD = 2048, 512
#: Sums of products of two residues, each at most half a prime, stay below 2^24 over so many components.
WIDTH = 64
EXACT = 1 << 24


def primes(bound: int, width: int = WIDTH) -> list[int]:
    """The largest primes that float32 sums of `width` products can be held with, enough of them
    that every number of at most `bound` in size has residues of its own."""
    found, product = [], 1
    p = 2 * int((EXACT / width) ** 0.5)
    while product <= 2 * bound:
        p -= 1
        if p < 3:
            raise ArithmeticError("scores do not fit")
        if (p // 2) ** 2 * width < EXACT and all(p % d for d in range(2, int(p**0.5) + 1)):
            found.append(p)
            product *= p
    return found


def centred(x: np.ndarray, p: int) -> np.ndarray:
    """Residues modulo p in [-(p - 1) / 2, (p - 1) / 2], as float32; exact for whole numbers of any size."""
    rest = np.fmod(x, float(p))
    rest -= p * np.rint(rest / p)
    return rest.astype(np.float32)


def residue_parts(x: np.ndarray, moduli: list[int]) -> list[np.ndarray]:
    """One residue matrix for each prime."""
    return [centred(x, p) for p in moduli]


def products(left: list[np.ndarray], right: list[np.ndarray], moduli: list[int]) -> np.ndarray:
    """Exact signed inner products (rows of left x rows of right) as int64."""
    digits: list[np.ndarray] = []
    total = np.zeros((len(left[0]), len(right[0])), np.int64)
    radix = 1
    for k, p in enumerate(moduli):
        a, b = left[k], right[k]
        r = np.zeros(total.shape, np.float64)
        for at in range(0, a.shape[1], WIDTH):
            r += a[:, at : at + WIDTH] @ b[:, at : at + WIDTH].T  # whole numbers below 2^24
        digit = np.fmod(r, p).astype(np.int64)
        # The next digit in mixed radix: take off what the digits so far stand for.
        weight, known = 1, np.zeros(total.shape, np.int64)
        for q, d in zip(moduli, digits):
            known = (known + d * weight) % p
            weight = weight * q % p
        digit = (digit - known) % p * pow(weight, -1, p) % p
        digit = np.where(digit > p // 2, digit - p, digit)
        digits.append(digit)
        total += digit * np.int64(radix)  # below 2^63, as the bound is below 2^62
        radix *= p
    return total


class Best:
    """The k best (score, then smaller id, then row) of each slot, over all that was offered."""

    def __init__(self, slots: int, k: int):
        self.k = k
        self.kept = np.zeros((4, 0), np.int64)  # slot, score, id, row
        self.least = np.full(slots, np.iinfo(np.int64).min)  # what a row must reach: score, and id at that score
        self.last = np.full(slots, np.iinfo(np.int64).max)

    def reached(self, slots: slice, scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Which of (slots x rows) could still be kept."""
        least = self.least[slots, None]
        return (scores > least) | ((scores == least) & (ids[None, :] <= self.last[slots, None]))

    def offer(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        if not len(slot):
            return
        both = np.hstack([self.kept, np.stack([slot, score, ids, rows]).astype(np.int64)])
        both = both[:, np.lexsort((both[3], both[2], -both[1], both[0]))]
        first = np.flatnonzero(np.diff(both[0], prepend=-1))
        place = np.arange(both.shape[1]) - np.repeat(first, np.diff(np.append(first, both.shape[1])))
        self.kept = both[:, place < self.k]
        full = both[:, place == self.k - 1]
        self.least[full[0]], self.last[full[0]] = full[1], full[2]


def components(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(row, id, label, x): rows that take part, with whole components; `row` tells equal ids apart.

    Out go rows with a null id or label, a null vector, or a component that is null or not finite."""
    x = F.transform(rows[f"`{vector_col}`"], lambda v: v.cast("double"))
    usable = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    kept = rows.select(
        rows[f"`{id_col}`"].cast("bigint").alias("id"), rows[f"`{label_col}`"].cast("bigint").alias("label"), x.alias("x")
    ).where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(usable, F.lit(False)))
    # rint of a double is a double: floor() would pass through a long and cut large components
    whole = F.transform("x", lambda v: F.rint(v * SCALE) - F.when(F.rint(v * SCALE) > v * SCALE, 1.0).otherwise(0.0))
    return kept.select(F.monotonically_increasing_id().alias("row"), "id", "label", whole.alias("x"))


def _dealt(anchors: DataFrame, rows: DataFrame, n_anchors: int, parts: int) -> DataFrame:
    """Anchors (with what else they carry) and rows, each copied to the tasks it belongs to.

    In a task anchors come before rows, and rows by id."""
    blocks = -(-n_anchors // ANCHOR_BLOCK)
    dealt = lambda n, seed: F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(n)).cast("int")
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = anchors.withColumn("block", dealt(blocks, 1)).withColumn("part", numbers(parts)).withColumn("asks", F.lit(True))
    right = rows.withColumn("part", dealt(parts, 2)).withColumn("block", numbers(blocks)).withColumn("asks", F.lit(False))
    both = left.unionByName(right, allowMissingColumns=True)
    both = both.withColumn("task", F.col("block") * parts + F.col("part")).drop("block", "part")
    return both.repartitionByRange(blocks * parts, "task").sortWithinPartitions("task", F.desc("asks"), "id", "row")


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a column of arrays; a shorter one counts as filled up with zeros."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    values = column.flatten().to_numpy(zero_copy_only=False)
    width = int(sizes.max()) if len(sizes) else 0
    out = np.zeros((len(sizes), width))
    out[np.arange(width)[None, :] < sizes[:, None]] = values
    return out


def _tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bool, pa.RecordBatch]]:
    """(task, whether anchors, at most ROWS rows) in order."""
    for batch in batches:
        kinds = 2 * batch.column("task").to_numpy() + ~batch.column("asks").to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.diff(kinds, prepend=-1)).tolist() + [batch.num_rows]
        for begin, until in zip(cuts, cuts[1:]):
            for at in range(begin, until, ROWS):
                yield int(kinds[begin]) // 2, not kinds[begin] % 2, batch.slice(at, min(ROWS, until - at))


def _wide(parts: list[np.ndarray], width: int) -> list[np.ndarray]:
    return [np.pad(p, ((0, 0), (0, width - p.shape[1]))) if p.shape[1] < width else p for p in parts]


def _scored(anchors: list[np.ndarray], rows: pa.RecordBatch, moduli: list[int]) -> Iterator[tuple[slice, np.ndarray]]:
    """(some of the anchors, their scores against the rows)."""
    right = residue_parts(_matrix(rows.column("x")), moduli)
    width = max(anchors[0].shape[1], right[0].shape[1])
    left, right = _wide(anchors, width), _wide(right, width)
    for at in range(0, len(left[0]), HELD):
        held = slice(at, min(at + HELD, len(left[0])))
        yield held, products([x[held] for x in left], right, moduli)


class _Anchors:
    """A task's anchors, and what is kept for them."""

    def __init__(self, k: int, slots: int):
        self.k, self.slots, self.batches = k, slots, []

    def add(self, batch: pa.RecordBatch) -> None:
        self.batches.append(batch)

    def close(self, moduli: list[int]) -> None:
        table = pa.Table.from_batches(self.batches).combine_chunks()
        self.table = table.drop_columns(["x"])
        self.parts = residue_parts(_matrix(table.column("x").chunk(0)), moduli)
        self.label, self.row = (table.column(c).to_numpy() for c in ("label", "row"))
        self.best = [Best(len(table), self.k) for _ in range(self.slots)]
        self.batches = []


def _score_bound(vectors: DataFrame) -> int:
    """No score is larger than the largest squared norm."""
    norm = F.aggregate("x", F.lit(0.0), lambda total, v: total + v * v)
    largest = vectors.agg(F.max(norm)).first()[0] or 0.0
    if largest >= 2.0**62:
        raise ArithmeticError("inner products of these vectors do not fit into a long")
    return int(largest * (1 + 1e-9)) + 1


def _streamed(batches: Iterator[pa.RecordBatch], moduli: list[int], k: int, slots: int, allowed) -> Iterator[_Anchors]:
    """The anchors of each task with the k best rows of each of their slots.

    allowed(anchors, held, labels, rows, scores, slot) says which of (held anchors x rows) may be taken."""
    task, anchors = None, None
    for number, asks, batch in _tasks(batches):
        if number != task:
            if anchors is not None and not anchors.batches:
                yield anchors
            task, anchors = number, None
        if asks:
            anchors = anchors or _Anchors(k, slots)
            anchors.add(batch)
            continue
        if anchors is None:
            continue  # rows of a task without anchors
        if anchors.batches:
            anchors.close(moduli)
        labels, ids, rows = (batch.column(c).to_numpy() for c in ("label", "id", "row"))
        for held, scores in _scored(anchors.parts, batch, moduli):
            for slot, best in enumerate(anchors.best):
                may = allowed(anchors, held, labels, rows, scores, slot) & best.reached(held, scores, ids)
                a, r = np.nonzero(may)
                best.offer(a + held.start, scores[a, r], ids[r], rows[r])
    if anchors is not None and not anchors.batches:
        yield anchors


def hard_negatives(
    vectors: DataFrame, anchors: DataFrame, n_positives: int = POSITIVES, n_negatives: int = NEGATIVES, parts: int = PARTS
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for each anchor row.

    vectors: (row, id, label, x) with x of whole numbers, stored, so that row numbers stay; anchors: some of
    these rows. An anchor's positives are its best `n_positives` other rows of its label; its
    negatives the best `n_negatives` rows of other labels with a score from LEAST_PERCENT of the
    positive's up to it. Higher scores first, ties by smaller id; rows that share an id count one
    by one. Without positives or negatives an anchor has no row; a shorter vector is filled up
    with zeros. Scores beyond a long are refused with an error."""
    moduli = primes(_score_bound(vectors))
    n_anchors = anchors.count()
    if not n_anchors:
        empty = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
        return vectors.sparkSession.createDataFrame([], empty)

    def own_label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def allowed(anchors, held, labels, rows, scores, slot):
            return (anchors.label[held, None] == labels) & (anchors.row[held, None] != rows)

        for anchors in _streamed(batches, moduli, n_positives, 1, allowed):
            at, score, ids, row = anchors.best[0].kept
            columns = [anchors.row[at], row, ids, score]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["row", "positive_row", "positive_id", "positive_score"])

    schema = "row bigint, positive_row bigint, positive_id bigint, positive_score bigint"
    near = _dealt(anchors, vectors, n_anchors, parts).mapInArrow(own_label, schema)
    first = Window.partitionBy("row").orderBy(F.desc("positive_score"), "positive_id", "positive_row")
    near = near.withColumn("k", F.row_number().over(first)).where(F.col("k") <= n_positives)
    positives = near.groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("k", "positive_id", "positive_score"))).alias("positives")  # n_positives at most
    )
    # Slots without a positive have a window that nothing is in.
    slot = lambda field, k, default: F.coalesce(F.get("positives", F.lit(k))[field], F.lit(default))
    windows = [slot("positive_score", k, -1).alias(f"top{k}") for k in range(n_positives)]
    windows += [slot("positive_id", k, 0).alias(f"positive{k}") for k in range(n_positives)]
    asked = checkpointed(anchors.join(positives, "row").select("row", "id", "label", "x", *windows))

    def other_labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def allowed(anchors, held, labels, rows, scores, slot):
            top = anchors.table.column(f"top{slot}").to_numpy()[held, None]
            return (anchors.label[held, None] != labels) & (scores <= top) & (scores >= -(-LEAST_PERCENT * top // 100))

        for anchors in _streamed(batches, moduli, n_negatives, n_positives, allowed):
            for slot, best in enumerate(anchors.best):
                at, score, ids, row = best.kept
                known = [anchors.table.column(c).to_numpy()[at] for c in ("row", "id", f"positive{slot}", f"top{slot}")]
                columns = [*known, np.full(len(at), slot, np.int64), row, ids, score]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), FOUND)

    found = _dealt(asked, vectors, n_anchors, parts).mapInArrow(other_labels, ", ".join(f"{c} bigint" for c in FOUND))
    first = Window.partitionBy("row", "k").orderBy(F.desc("negative_score"), "negative_id", "negative_row")
    return (
        found.withColumn("rank", F.row_number().over(first))
        .where(F.col("rank") <= n_negatives)
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )


FOUND = ["row", "anchor_id", "positive_id", "positive_score", "k", "negative_row", "negative_id", "negative_score"]


def mine(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Hard negatives of every row whose id is divisible by 100, against all rows.

    Where the id is divisible by 7 the label moves on by one, modulo 10, before anything else."""
    vectors = components(rows, id_col, vector_col, label_col)
    moved = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = checkpointed(vectors.withColumn("label", moved))
    return hard_negatives(vectors, vectors.where(F.col("id") % 100 == 0))
