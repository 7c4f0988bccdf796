"""Exact duplicates by a content sort.

Normalised bytes are dealt by sampled splitters (`repartitionByRange`) and sorted in
each partition by Spark's external sort, so equal texts are neighbours. Splitters are
short: a prefix, a 64-bit hash, the document's id and its row's number, so the driver holds no
texts and a group of a third of all rows, with ids or without, spreads over as many partitions
as its rows need. One pass over each sorted partition compares whole neighbouring texts. Runs that
touch a partition's edge (two keys a partition at most) are joined across partitions
by their whole text, and so are the pieces of a run that is too long to be held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from tidewatch.llm.common import ascii_lower, checkpointed, free_names, row_hash

PREFIX = 32
EDGES = 1 << 20
#: Ids of one text that are held at once.
PIECE = 1 << 16
ROWS = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("keep_id", pa.int64()),
        ("group_size", pa.int64()),
        ("head", pa.bool_()),
        ("text_sha256", pa.string()),
        ("edge", pa.int64()),
        ("edge_text", pa.binary()),
    ]
)
ROWS_DDL = (
    "doc_id bigint, keep_id bigint, group_size bigint, head boolean, text_sha256 string, edge bigint, edge_text binary"
)


def normalised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) with A-Z lower-cased and null as empty."""
    for batch in batches:
        norm = pc.ascii_lower(pc.fill_null(batch.column(1), ""))
        yield pa.RecordBatch.from_arrays([batch.column(0), norm], names=["doc_id", "norm"])


class _Runs:
    """Runs of equal texts in one sorted partition; holds at most PIECE ids of a text, of the current sort key only."""

    def __init__(self, partition: int):
        self.partition, self.edges = partition, 0
        self.key, self.first, self.cut = None, True, False
        self.runs: list[tuple[bytes, list]] = []
        self.out: list[tuple] = []

    def add(self, key, norm: bytes, doc_id) -> None:
        if key != self.key:
            self.flush(edge=self.first or self.cut)
            self.first, self.cut = self.key is None, False
            self.key, self.runs = key, []
        if self.runs and self.runs[-1][0] == norm:
            self.runs[-1][1].append(doc_id)
        else:
            self.runs.append((norm, [doc_id]))
        if len(self.runs[-1][1]) >= PIECE:  # what follows of this key is an edge too, and all are joined by their text
            self.flush(edge=True)
            self.cut = True

    def flush(self, edge: bool) -> None:
        for norm, ids in self.runs:
            digest = hashlib.sha256(norm).hexdigest()
            number = None
            if edge:
                number = self.partition * EDGES + self.edges
                self.edges += 1
            for i, doc_id in enumerate(ids):
                self.out.append((doc_id, ids[0], len(ids), i == 0, digest, number, norm if edge and i == 0 else None))
        self.runs = []

    def take(self) -> pa.RecordBatch:
        columns = list(zip(*self.out)) or [()] * len(ROWS)
        self.out = []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, ROWS.types)], schema=ROWS)


def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (prefix, code, norm, doc_id descending) to one row per document."""
    runs = _Runs(TaskContext.get().partitionId())
    for batch in batches:
        codes = batch.column("code").to_pylist()
        ids = batch.column("doc_id").to_pylist()
        for code, norm, doc_id in zip(codes, batch.column("norm"), ids):
            whole = norm.as_buffer().to_pybytes()
            runs.add((whole[:PREFIX], code), whole, doc_id)
        if runs.out:
            yield runs.take()
    runs.flush(edge=True)
    yield runs.take()


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; the row with the largest
    id stays. Null texts count as empty; a null id is smaller than any other; of rows
    that repeat both id and text exactly one stays. An empty table gives no rows, and
    other columns are never read.
    """
    rows = docs.select(docs[f"`{id_col}`"].cast("bigint").alias("doc_id"), docs[f"`{text_col}`"].alias("norm"))
    rows = rows.mapInArrow(normalised, "doc_id bigint, norm string").withColumn("code", F.xxhash64("norm"))
    prefix, last = F.substring(F.col("norm").cast("binary"), 1, PREFIX), F.desc_nulls_last("doc_id")
    number = F.monotonically_increasing_id().alias("number")  # parts rows that share text and id
    rows = rows.select("doc_id", F.col("norm").cast("binary").alias("norm"), "code", prefix.alias("prefix"), number)
    dealt = rows.repartitionByRange("prefix", "code", last, "number").sortWithinPartitions("prefix", "code", "norm", last)
    found = checkpointed(dealt.select("doc_id", "norm", "code").mapInArrow(neighbours, ROWS_DDL))

    # At most two sort keys of each partition have rows here, and one row for each piece of a long run.
    edges = found.where("edge_text IS NOT NULL")
    totals = edges.groupBy("edge_text").agg(
        F.sum("group_size").alias("total"), F.max("keep_id").alias("last_id"), F.min("edge").alias("first_edge")
    )
    edges = edges.select("edge", "edge_text").join(totals, "edge_text").drop("edge_text")
    joined = found.drop("edge_text").join(F.broadcast(edges), "edge", "left")
    return joined.select(
        "doc_id",
        F.when(F.col("edge").isNull(), F.col("keep_id")).otherwise(F.col("last_id")).alias("keep_id"),
        F.coalesce("total", "group_size").alias("group_size"),
        (F.col("head") & (F.col("edge").isNull() | (F.col("edge") == F.col("first_edge")))).alias("kept"),
        "text_sha256",
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay, with all their columns.

    Rows are matched by id (nulls match) and, where an id repeats, by their digest; of rows that
    share both the one with the smallest hash of all columns stays. Columns may have any names."""
    digest, place, keep, text = free_names(docs, "digest", "place", "keep_id", "keep_text")
    kept = exact_duplicates(docs, id_col, text_col).where("kept")
    kept = kept.select(F.col("doc_id").alias(keep), F.col("text_sha256").alias(text))
    own = F.sha2(F.coalesce(ascii_lower(docs[f"`{text_col}`"]), F.lit("")).cast("binary"), 256)
    marked = docs.withColumn(digest, own)
    same = F.col(f"`{id_col}`").eqNullSafe(F.col(keep)) & (F.col(digest) == F.col(text))
    rows = marked.join(kept, same, "left_semi")
    again = Window.partitionBy(F.col(f"`{id_col}`"), F.col(digest)).orderBy(row_hash(docs))
    return rows.withColumn(place, F.row_number().over(again)).where(F.col(place) == 1).drop(digest, place)
