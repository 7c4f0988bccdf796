"""SimHash near-duplicates by anchor-point covering.

A fingerprint's 64 bits are read as two blocks of 23 bits and a rest of 18. Over each
block the binary Golay code is a perfect covering code of radius 3: every block value
has exactly one code word, its home anchor, within 3 bits. A fingerprint y within 2
bits of x lies within 3 + e1 and 3 + e2 bits of x's two home anchors, e1 + e2 <= 2.
So every distinct fingerprint goes to all anchor pairs it can meet a neighbour at
(61 on average), is compared there with the fingerprints at home, on all 64 bits, and
no link is lost. Equal fingerprints are one row before this step, however many
documents share them. Components of links are found on distinct fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatch.llm.common import checkpointed, free_names, row_hash
from tidewatch.llm.components import connected

SHINGLE = 3
SEED = 42
THRESHOLD = 2
RADIUS = 3
LENGTH, DIMENSION = 23, 12
GENERATOR = 0b110001110101  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
STEP = 1 << 14
ROWS = 2048


def fingerprint(text: bytes) -> int:
    """Unsigned fingerprint of a text whose A-Z are lower-cased; zero without words."""
    words = text.split()
    if not words:
        return 0
    size = min(SHINGLE, len(words))
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    begins = (ends - lengths).tolist()
    ends = ends[size - 1 :].tolist()
    digest, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(ends), STEP):
        part = ends[at : at + STEP]
        codes = [digest(joined[b:e], SEED) for b, e in zip(begins[at : at + STEP], part)]
        octets = np.array(codes, "<u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(total * 2 > len(ends), bitorder="little")
    return int(bits.view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Puts the fingerprint in the text's place; other columns stay."""
    for batch in batches:
        texts = batch.column("text")
        codes = [fingerprint(t.as_buffer().to_pybytes().lower()) if t.is_valid else 0 for t in texts]
        signed = pa.array(np.array(codes, np.uint64).view(np.int64))
        kept = [signed if name == "text" else batch.column(name) for name in batch.schema.names]
        names = ["fp" if name == "text" else name for name in batch.schema.names]
        yield pa.RecordBatch.from_arrays(kept, names=names)


@cache
def _code() -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Syndrome tables by byte; by syndrome, the patterns of up to 5 bits, padded, and their excess over 3 bits."""

    def syndrome(word: int) -> int:
        for bit in range(LENGTH - 1, LENGTH - DIMENSION - 1, -1):
            if word >> bit & 1:
                word ^= GENERATOR << (bit - (LENGTH - DIMENSION))
        return word

    by_byte = [np.array([syndrome(b << s) if b << s < 1 << LENGTH else 0 for b in range(256)]) for s in (0, 8, 16)]
    patterns: list[list[tuple[int, int]]] = [[] for _ in range(1 << (LENGTH - DIMENSION))]
    ones = [syndrome(1 << b) for b in range(LENGTH)]
    for weight in range(RADIUS + THRESHOLD + 1):
        for bits in combinations(range(LENGTH), weight):
            code = 0
            for b in bits:
                code ^= ones[b]
            patterns[code].append((sum(1 << b for b in bits), max(0, weight - RADIUS)))
    width = max(map(len, patterns))
    flips = np.zeros((len(patterns), width), np.int64)
    excess = np.full((len(patterns), width), THRESHOLD + 1, np.int8)
    for code, found in enumerate(patterns):
        flips[code, : len(found)] = [p for p, _ in found]
        excess[code, : len(found)] = [e for _, e in found]
    return by_byte, flips, excess


def _anchors(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Anchors in reach of each 23-bit block value, with the excess over the radius (3: none)."""
    by_byte, flips, excess = _code()
    code = by_byte[0][block & 255] ^ by_byte[1][block >> 8 & 255] ^ by_byte[2][block >> 16]
    return (block[:, None] ^ flips[code]) >> (LENGTH - DIMENSION), excess[code]


def cells(codes: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) of every anchor pair within `reach` bits of excess; reach 0 is the home cell alone."""
    codes = codes.view(np.uint64)
    low = (codes & np.uint64((1 << LENGTH) - 1)).astype(np.int64)
    high = (codes >> np.uint64(LENGTH) & np.uint64((1 << LENGTH) - 1)).astype(np.int64)
    (a, ea), (b, eb) = _anchors(low), _anchors(high)
    row, i, j = np.nonzero(ea[:, :, None] + eb[:, None, :] <= reach)
    return row, a[row, i] << DIMENSION | b[row, j]


def _dealt(reach: int):
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False))
            for at in range(0, len(codes), ROWS):
                part = codes[at : at + ROWS]
                row, cell = cells(part, reach)
                yield pa.RecordBatch.from_arrays([pa.array(part[row]), pa.array(cell.astype(np.int32))], ["fp", "cell"])

    return deal


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the 64-bit fingerprint of each row's whole text, as a signed number."""
    rows = docs.select(docs[f"`{id_col}`"].cast("bigint").alias("doc_id"), docs[f"`{text_col}`"].alias("text"))
    return rows.mapInArrow(_fingerprints, "doc_id bigint, fp bigint")


def links(codes: DataFrame) -> DataFrame:
    """(a, b), a < b: all pairs of the distinct codes (fp) that differ in 1 or 2 bits, each once."""
    home = codes.select("fp").mapInArrow(_dealt(0), "a bigint, cell int")
    visits = codes.select("fp").mapInArrow(_dealt(THRESHOLD), "b bigint, cell int")
    near = F.expr(f"a < b AND bit_count(a ^ b) <= {THRESHOLD}")
    return home.join(visits, (home["cell"] == visits["cell"]) & near).select("a", "b")


def _components(found: DataFrame) -> DataFrame:
    """(fp, label, component_id) of the distinct codes in `found` (doc_id, fp): the component's least code and id."""
    codes = checkpointed(found.groupBy("fp").agg(F.min("doc_id").alias("least")))
    joined = checkpointed(connected(checkpointed(links(codes))).join(codes, F.col("node") == F.col("fp")))
    least = joined.groupBy("label").agg(F.min("least").alias("component_id"))
    named = checkpointed(joined.select("fp", "label").join(least, "label").select("fp", "label", "component_id"))
    return checkpointed(
        codes.join(named, "fp", "left").select(
            "fp", F.coalesce("label", "fp").alias("label"), F.coalesce("component_id", "least").alias("component_id")
        )
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, fingerprint, component_id.

    Null and wordless texts have fingerprint zero and link like any other. Ids may be
    null (smaller components' ids ignore them) or repeat; equal texts always share a
    component. An empty table gives no rows. Only the named columns are read."""
    found = checkpointed(fingerprints(docs, id_col, text_col))
    whole = _components(found).drop("label")
    return found.join(whole, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _row_key(doc_id: Column, text: Column) -> Column:
    """Digest of an id and a text; neither nulls nor separators make two pairs alike."""
    known = F.coalesce(doc_id.cast("bigint").cast("string"), F.lit("null"))
    return F.unhex(F.sha2(F.concat_ws(":", known, F.isnull(text).cast("int"), F.coalesce(text, F.lit(""))).cast("binary"), 256))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each component exactly one row stays, with all its columns: one with the smallest id.

    A row without an id stays only where no row of the component has one. Rows are known by
    id and text together, so null and repeated ids decide about no other component's rows."""
    key = _row_key(docs[f"`{id_col}`"], docs[f"`{text_col}`"])
    rows = docs.select(
        docs[f"`{id_col}`"].cast("bigint").alias("doc_id"), docs[f"`{text_col}`"].alias("text"), key.alias("key")
    )
    found = checkpointed(rows.mapInArrow(_fingerprints, "doc_id bigint, fp bigint, key binary"))
    first = F.min(F.struct(F.isnull("doc_id").alias("unknown"), "doc_id", "key")).alias("first")
    own, best, place = free_names(docs, "own_key", "best_key", "place")
    kept = found.join(_components(found), "fp").groupBy("label").agg(first).select(F.col("first.key").alias(best))
    marked = docs.withColumn(own, key).join(kept, F.col(own) == F.col(best), "left_semi")
    again = Window.partitionBy(own).orderBy(row_hash(docs))  # rows that share id and text: always the same one stays
    return marked.withColumn(place, F.row_number().over(again)).where(F.col(place) == 1).drop(own, place)
