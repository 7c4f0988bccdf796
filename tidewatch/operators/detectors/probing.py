"""Approximate nearest neighbours: cells as hash tables, probed in the order of their distance.

Reference points are hashed to the cell of their nearest pivot. A query's own cell names the
cells to look into: the `probes` ones whose pivots lie nearest to its own. How many are
needed is measured, not guessed: for a bounded sample of queries the true neighbours are
found by a scan of all references, and the smallest number of probes that reaches the wanted
recall is taken. Cells keep about CELL points however many references there are, so the cost
of a query depends on the data's shape, not on its size.

Queries of neighbouring cells form groups of a bounded size. All cells a group looks into are
streamed past it, each home cell's queries keep their best points; nothing is merged between
tasks, and a large cell is just a longer stream. While groups look into few cells, references
are shuffled to them; where that would copy the references more than SPREAD times, each group
reads the stored references instead, so that the disk taken grows with the rows, not their square.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tidewatch.operators.detectors.base import key_hash, matrix
from tidewatch.session import materialize

CELL, MAX_CELLS = 500, 8192
SAMPLE = 256
QUERY_BLOCK, REF_BLOCK = 4096, 4096
LEAST_BLOCK = 1024  # few queries are dealt out finer, but not below this
HOMES = 32  # in a group
SPREAD = 8
STEP = 256  # queries of one product of matrices


def product_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances by the product form, centred against cancellation."""
    centre = b.mean(0) if len(b) else 0.0
    a, b = a - centre, b - centre
    out = (-2.0 * a) @ b.T
    out += (a * a).sum(1)[:, None]
    out += (b * b).sum(1)
    return np.maximum(out, 0.0, out=out)


def vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


class Nearest:
    """The `need` nearest references of each query of a block over all that was offered; of equally near ones
    those of the lowest tie. The first column of the payload is the tie."""

    def __init__(self, queries: np.ndarray, need: int):
        self.queries, self.need = queries, need
        self.dist: np.ndarray | None = None
        self.kept: list[np.ndarray] = []
        self.waiting: list[tuple[np.ndarray, list[np.ndarray]]] = []
        self.held = 0

    def offer(self, points: np.ndarray, payload: list[np.ndarray]) -> None:
        """Small stretches wait until they are worth a product of matrices."""
        self.waiting.append((points, payload))
        self.held += len(points)
        if self.held >= REF_BLOCK:
            self.close()

    def close(self) -> None:
        if not self.held:
            return
        points = np.concatenate([p for p, _ in self.waiting])
        payload = [np.concatenate(columns) for columns in zip(*(p for _, p in self.waiting))]
        self.waiting, self.held = [], 0
        centre = points.mean(0)
        b, squares = points - centre, ((self.queries - centre) ** 2).sum(1)
        right = np.column_stack([b, np.ones(len(b)), (b * b).sum(1)]).T
        slack = 1e-12 * (squares.max() + right[-1].max())  # beyond what rounding can move a distance of the product form
        parts = []
        for at in range(0, len(self.queries), STEP):
            asked = self.queries[at : at + STEP]
            left = np.column_stack([-2.0 * (asked - centre), squares[at : at + STEP], np.ones(len(asked))])
            parts.append(self._best(at, asked, left @ right, slack, points, payload))
        self.dist = np.concatenate([dist for dist, _ in parts])
        self.kept = [np.concatenate(columns) for columns in zip(*(kept for _, kept in parts))]

    def _best(
        self, at: int, asked: np.ndarray, rough: np.ndarray, slack: float, points: np.ndarray, payload: list[np.ndarray]
    ) -> tuple[np.ndarray, list[np.ndarray]]:
        """What is kept of some queries whose squared distances are `rough` within slack."""
        old = self.dist[at : at + STEP] if self.dist is not None else np.empty((len(asked), 0))
        take = min(self.need, len(points))
        limit = old[:, -1] ** 2 if old.shape[1] >= self.need else np.partition(rough, take - 1, axis=1)[:, take - 1]
        far = rough > limit[:, None] * (1 + 1e-12) + slack
        row, col = np.divmod(np.flatnonzero(np.logical_not(far, out=far)), len(points))
        count = np.bincount(row, minlength=len(asked))
        seat = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        dist, which = np.full((len(asked), count.max()), np.inf), np.zeros((len(asked), count.max()), np.int64)
        which[row, seat] = col
        for i in range(0, len(row), 1 << 16):  # exact distances of the chosen few
            cut = slice(i, i + (1 << 16))
            part = asked[row[cut]] - points[col[cut]]
            dist[row[cut], seat[cut]] = np.sqrt((part * part).sum(1))
        kept = [column[which] for column in payload]
        kept[0][np.arange(dist.shape[1])[None, :] >= count[:, None]] = np.iinfo(np.int64).max
        if old.shape[1]:
            dist, kept = np.hstack([old, dist]), [np.hstack([o[at : at + STEP], k]) for o, k in zip(self.kept, kept)]
        order = np.lexsort((kept[0], dist), axis=1)[:, : min(self.need, old.shape[1] + take)]
        return np.take_along_axis(dist, order, 1), [np.take_along_axis(c, order, 1) for c in kept]


class Group:
    """Queries of some home cells. floors(home) gives for each cell how far from its pivot a reference must lie to matter."""

    def __init__(self, homes: np.ndarray, ids: np.ndarray, points: np.ndarray, floors: Callable[[int], np.ndarray], need: int):
        order = np.argsort(homes, kind="stable")
        parts = np.split(order, np.flatnonzero(np.diff(homes[order])) + 1)
        self.homes = [(floors(int(homes[at[0]])), ids[at], Nearest(points[at], need)) for at in parts]

    def offer(self, cell: int, points: np.ndarray, payload: list[np.ndarray], away: np.ndarray | None) -> None:
        for floor, _, best in self.homes:
            if away is None:
                keep = floor[cell] <= 0
            else:
                keep = away >= floor[cell]
                some = keep.any()
                if some and not keep.all():
                    best.offer(points[keep], [c[keep] for c in payload])
                    continue
                keep = some
            if keep:
                best.offer(points, payload)

    def ended(self, finish) -> Iterator[pa.RecordBatch]:
        for _, ids, best in self.homes:
            best.close()
            if best.dist is not None:
                yield finish(ids, best.dist, best.kept[1:])


@dataclass
class Index:
    """refs: (id, x, w, cell, ...), stored. `recall` was measured over the sample with `probes` cells.

    packed: (cell, m, tie, and columns of refs as arrays), a row for each REF_BLOCK references of a cell
    at most; m holds their vectors as one matrix."""

    pivots: np.ndarray
    refs: DataFrame
    packed: DataFrame
    sizes: np.ndarray
    probes: int
    recall: float

    def routes(self) -> np.ndarray:
        """(home, probes) cells by the distance of their pivots."""
        out = np.empty((len(self.pivots), self.probes), np.int32)
        for at in range(0, len(self.pivots), 256):
            far = product_distances(self.pivots[at : at + 256], self.pivots)
            out[at : at + 256] = np.argsort(far, axis=1, kind="stable")[:, : self.probes]
        return out

    def with_refs(self, refs: DataFrame, payload: list[str]) -> Index:
        """The same cells over references that carry other columns."""
        return Index(self.pivots, refs, packed(refs, self.sizes, payload), self.sizes, self.probes, self.recall)


def packed(refs: DataFrame, sizes: np.ndarray, payload: list[str], size: int = REF_BLOCK) -> DataFrame:
    """References by cell and block of a cell, written once. tie: a hash of the id."""
    blocks = F.array(*[F.lit(int(b)) for b in np.maximum(-(-sizes // size), 1)])
    block = F.floor(key_hash(["id"], 12) * F.element_at(blocks, F.col("cell") + 1)).cast("int")
    payload = ["tie", *payload]
    rows = refs.withColumn("tie", F.xxhash64("id")).select("cell", block.alias("block"), "x", *payload)
    types = dict(rows.dtypes)

    def pack(block: pa.Table) -> pa.Table:
        block = block.combine_chunks()
        matrix = np.ascontiguousarray(vectors(block.column("x").chunk(0)), dtype=np.float64)
        columns = {"cell": [block.column("cell")[0].as_py()], "m": [matrix.tobytes()]}
        columns |= {c: pa.array([block.column(c).to_numpy()], pa.list_(block.schema.field(c).type)) for c in payload}
        return pa.table(columns, schema=pa.schema(
            [("cell", pa.int32()), ("m", pa.binary())] + [(c, pa.list_(block.schema.field(c).type)) for c in payload]
        ))

    schema = ", ".join(["cell int", "m binary"] + [f"{c} array<{types[c]}>" for c in payload])
    return materialize(rows.groupBy("cell", "block").applyInArrow(pack, schema), "probing-cells")


def placed(df: DataFrame, pivots: np.ndarray) -> DataFrame:
    @F.pandas_udf("int")
    def nearest(x: pd.Series) -> pd.Series:
        points = matrix(x)
        cells = [product_distances(points[i : i + 512], pivots).argmin(1) for i in range(0, len(points), 512)]
        return pd.Series(np.concatenate(cells) if cells else np.zeros(0, np.int64)).astype("int32")

    return df.withColumn("cell", nearest("x"))


def _sample_neighbours(refs: DataFrame, asked: pd.DataFrame, k: int) -> pd.DataFrame:
    """(query, cell) of the true k nearest points of each sampled point, itself left out: a scan of all
    references, of which each task hands on the k best for each of the sample."""
    ids, points = asked["id"].to_numpy(), matrix(asked["x"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Nearest(points, k + 1)
        for batch in batches:
            for at in range(0, batch.num_rows, REF_BLOCK):
                part = batch.slice(at, REF_BLOCK)
                best.offer(vectors(part.column("x")), [part.column(c).to_numpy(zero_copy_only=False) for c in ("tie", "id", "cell")])
        best.close()
        if best.dist is not None:
            of = np.repeat(np.arange(len(ids)), best.dist.shape[1])
            rows = [of, best.dist.ravel(), *(c.ravel() for c in best.kept[1:])]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, rows)), ["query", "dist", "id", "cell"])

    scanned = refs.select(F.xxhash64("id").alias("tie"), "id", "x", "cell")
    found = scanned.mapInArrow(scan, "query bigint, dist double, id string, cell int")
    by_dist = W.partitionBy("query").orderBy("dist", "id")
    found = found.withColumn("k", F.row_number().over(by_dist)).where(F.col("k") <= k + 1)
    near = found.select("query", "id", "cell").toPandas()  # the sample times k + 1
    near = near[near["id"].to_numpy() != ids[near["query"].to_numpy()]]
    return near.groupby("query").head(k)


def build(points: DataFrame, k: int, recall: float = 0.95, cell: int = CELL, sample: int = SAMPLE) -> Index:
    """An index of (id, x, w) with unique ids. The sample measures recall for `k` neighbours and is asked for half
    of the missing share more than wanted, as it is only a sample."""
    n = points.count()
    if not n:
        raise ValueError("no reference points")
    cells = min(MAX_CELLS, max(1, n // cell))
    drawn = points.select("id", "x").orderBy(key_hash(["id"], 7), "id").limit(max(cells, sample)).toPandas()
    pivots = matrix(drawn["x"])[:cells]
    refs = materialize(placed(points, pivots), "probing-refs")
    sizes = np.zeros(cells, np.int64)
    counted = refs.groupBy("cell").count().toPandas()  # a number for each cell
    sizes[counted["cell"]] = counted["count"]

    # Sampled points from the far end of the draw: pivots themselves lie in the middle of their cells.
    asked = refs.orderBy(key_hash(["id"], 8), "id").limit(sample).toPandas()
    near = _sample_neighbours(refs, asked, k)
    order = product_distances(pivots[asked["cell"].to_numpy()], pivots).argsort(1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(cells)[None, :], 1)
    ranks = np.sort(place[near["query"].to_numpy(), near["cell"].to_numpy()])
    if not len(ranks):
        return Index(pivots, refs, packed(refs, sizes, ["id", "w"]), sizes, 1, 1.0)
    share = 1 - (1 - recall) / 2
    probes = int(ranks[min(len(ranks) - 1, math.ceil(share * len(ranks)) - 1)]) + 1
    return Index(pivots, refs, packed(refs, sizes, ["id", "w"]), sizes, probes, float((ranks < probes).mean()))


def probe(index: Index, queries: DataFrame, need: int, payload: list[str], finish, out: T.StructType | str) -> DataFrame:
    """Shows queries (id, x, cell), ids unique, the references of the cells they probe; finish as in `meet`."""
    routes, cells = index.routes(), len(index.pivots)
    looks = np.zeros((cells, -(-cells // 8)), np.uint8)  # a bit for each home and cell
    for home, row in enumerate(routes):
        looks[home] = np.packbits(np.bincount(row, minlength=cells) > 0)

    def floors(home: int) -> np.ndarray:
        return np.where(np.unpackbits(looks[home], count=cells), 0.0, np.inf)

    return meet(index.packed, index.sizes, index.pivots, floors, queries, need, payload, finish, out)


def neighbouring(pivots: np.ndarray) -> np.ndarray:
    """Cells in an order that keeps near ones together: halves along the widest axis, again and again."""
    out, left = [], [np.arange(len(pivots))]
    while left:
        part = left.pop()
        if len(part) < 3:
            out.extend(part.tolist())
            continue
        part = part[np.argsort(pivots[part][:, pivots[part].var(0).argmax()], kind="stable")]
        left += [part[len(part) // 2 :], part[: len(part) // 2]]
    return np.array(out, np.int64)


def dealt(asked: np.ndarray, order: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(run, first, parts) by cell and the number of groups. The queries of a run of cells in this order are a group
    of about `size` rows at most; a cell with more is a run of several groups."""
    run, first, parts = (np.zeros(len(asked), np.int64) for _ in range(3))
    parts[:] = np.maximum(-(-asked // size), 1)
    groups, runs, rows, homes = 0, 0, size, 0
    for cell in order[asked[order] > 0]:
        if rows + asked[cell] > size or homes == HOMES:
            runs, groups, rows, homes = runs + 1, groups + int(parts[cell]), 0, 0
        run[cell], first[cell] = runs - 1, groups - parts[cell]
        rows, homes = rows + asked[cell], homes + 1
    return run, first, parts, groups


def meet(
    cells: DataFrame, sizes: np.ndarray, pivots: np.ndarray, floors: Callable[[int], np.ndarray], queries: DataFrame,
    need: int, payload: list[str], finish, out: T.StructType | str, farthest: np.ndarray | None = None, block: int | None = None,
) -> DataFrame:
    """Shows each query (id, x, cell) every packed reference of `cells` that can matter to its home cell.

    floors(home) has for each cell the least distance from its pivot that a reference must have; inf
    for none of its references. With `farthest`, the largest distance by cell, `cells` has a column away.
    finish(ids, dist, kept) gives the record batch of a home's results: by query the distances, nearest
    first, and what the references' payload columns hold. Null vectors must be gone."""
    spark, measured = queries.sparkSession, farthest is not None
    asked = np.zeros(len(sizes), np.int64)
    counted = queries.groupBy("cell").count().toPandas()  # a number for each cell
    asked[counted["cell"]] = counted["count"]
    size = block or min(QUERY_BLOCK, max(LEAST_BLOCK, math.ceil(int(asked.sum()) / (2 * spark.sparkContext.defaultParallelism))))
    run, first, parts, groups = dealt(asked, neighbouring(pivots), size)
    homes = np.flatnonzero(asked)
    looked = np.zeros((int(run.max(initial=0)) + 1, len(sizes)), bool)  # by run and cell
    for home in homes:
        looked[run[home]] |= (floors(int(home)) <= (farthest if measured else 0.0)) & (sizes > 0)
    of_run = np.bincount(run[homes], weights=parts[homes] / np.bincount(run[homes])[run[homes]], minlength=len(looked)) if len(homes) else np.ones(1)
    copies = float(of_run @ (looked @ sizes)) / max(1, int(sizes.sum()))

    @F.pandas_udf("int")
    def group(cell: pd.Series, spread: pd.Series) -> pd.Series:
        c = cell.to_numpy()
        return pd.Series((first[c] + (spread.to_numpy() * parts[c]).astype(np.int64)).astype("int32"))

    columns = ["tie", *payload]
    sent = [*columns, "away"] if measured else columns
    left = queries.select(group("cell", key_hash(["id"], 11)).alias("group"), "cell", F.col("id").alias("query"), "x")

    def offered(best: Group, part: pa.RecordBatch, i: int) -> None:
        points = np.frombuffer(part.column("m")[i].as_buffer()).reshape(-1, pivots.shape[1]).copy()  # lets the batch go
        rows = [part.column(c)[i].values.to_numpy(zero_copy_only=False).copy() for c in sent]
        best.offer(part.column("cell")[i].as_py(), points, rows[: len(columns)], rows[-1] if measured else None)

    if copies > SPREAD:
        return _read(cells, sent, left, groups, looked, run, lambda *q: Group(*q, floors, need), offered, finish, out)

    to: list[list[int]] = [[] for _ in sizes]
    for home in {int(r): int(h) for h, r in zip(homes, run[homes])}.values():  # any cell of a run names its groups
        for cell in np.flatnonzero(looked[run[home]]):
            to[cell].extend(range(int(first[home]), int(first[home] + parts[home])))

    @F.pandas_udf("array<int>")
    def tasks(cell: pd.Series) -> pd.Series:
        return pd.Series([np.array(to[c], np.int32) for c in cell])

    refs = cells.select(F.explode(tasks("cell")).alias("group"), "cell", "m", *sent, F.lit(1).alias("kind"))
    both = left.withColumn("kind", F.lit(0)).unionByName(refs, allowMissingColumns=True)
    both = both.repartitionById(max(1, groups if groups < 1024 else groups // 4), "group").sortWithinPartitions("group", "kind")

    def shown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, waiting, best = None, [], None
        for batch in batches:
            keys = batch.column("group").to_numpy().astype(np.int64) * 2 + batch.column("kind").to_numpy()
            cuts = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1)).tolist() + [batch.num_rows] if len(keys) else [0]
            for begin, until in zip(cuts, cuts[1:]):
                number, is_ref = divmod(int(keys[begin]), 2)
                if number != current:
                    if best is not None:
                        yield from best.ended(finish)
                    current, waiting, best = number, [], None
                part = batch.slice(begin, until - begin)
                if not is_ref:
                    waiting.append(part)
                    continue
                if best is None:
                    if not waiting:
                        continue
                    whole = pa.Table.from_batches(waiting).combine_chunks()
                    found = whole.column("x").combine_chunks()
                    best = Group(whole.column("cell").to_numpy(), whole.column("query").to_numpy(), vectors(found), floors, need)
                for i in range(part.num_rows):
                    offered(best, part, i)
        if best is not None:
            yield from best.ended(finish)

    return both.mapInArrow(shown, out)


def _read(cells, sent, left, groups, looked, run, begun, offered, finish, out) -> DataFrame:
    """Each group is a task that reads the stored references from end to end: no reference is copied on disk.

    Spark's product of partitions streams its left side and holds the right one, a group; only
    references of cells that the group looks into reach Python, and its queries only once."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [b for b in batches if b.num_rows]
        whole = pa.Table.from_batches(found).combine_chunks() if found else None
        for number in np.unique(whole.column("group").to_numpy()) if found else ():
            rows = whole.filter(pa.array(whole.column("group").to_numpy() == number)).combine_chunks()
            homes = rows.column("cell").to_numpy()
            points = np.ascontiguousarray(vectors(rows.column("x").combine_chunks()), dtype=np.float64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([number], pa.int32()), pa.array([looked[run[homes[0]]]], pa.list_(pa.bool_())), pa.array([homes.tobytes()], pa.binary()),
                    pa.array([rows.column("query").to_numpy()], pa.list_(pa.string())), pa.array([points.tobytes()], pa.binary()),
                ],
                ["group", "looked", "homes", "ids", "points"],
            )

    asked = left.repartitionById(max(1, groups), "group")
    asked = asked.mapInArrow(gather, "group int, looked array<boolean>, homes binary, ids array<string>, points binary")
    stored = cells.select("cell", "m", *sent).coalesce(1).withColumn("nth", F.monotonically_increasing_id())
    matters = F.element_at("looked", F.col("cell") + 1) | (F.col("nth") == 0)
    pairs = stored.hint("shuffle_replicate_nl").join(asked, matters)
    once = [F.when(F.col("nth") == 0, F.col(c)).alias(c) for c in ("homes", "ids", "points")]

    def shown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_groups: dict[int, Group] = {}
        for batch in batches:
            for i, number in enumerate(batch.column("group").to_pylist()):
                if number not in all_groups:
                    homes, points = (batch.column(c)[i].as_buffer() for c in ("homes", "points"))
                    ids = batch.column("ids")[i].values.to_numpy(zero_copy_only=False).copy()
                    homes = np.frombuffer(homes, np.int32).copy()
                    all_groups[number] = begun(homes, ids, np.frombuffer(points).reshape(len(homes), -1).copy())
                offered(all_groups[number], batch, i)
        for best in all_groups.values():
            yield from best.ended(finish)

    return pairs.select("group", "cell", "m", *sent, *once).mapInArrow(shown, out)
