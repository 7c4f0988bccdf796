"""Local outlier factor (Breunig et al. 2000) over a distributed k-NN join, exact or probing.

The exact join follows the pivot scheme of Lu et al. (2012): rows go to the cell of
their nearest pivot; triangle-inequality bounds tell which cells of queries a
reference row can matter to, and only those meet it. Equal points are
collapsed to one weighted point first, so a group of copies costs one row.
Groups of queries meet the references of their cells as numpy matrices in one stream and
only the k best per query leave the task (`probing.meet`). The probing join of `probing.py` looks
into as many cells as a wanted recall needs; its cost per row does not grow with the references.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tidewatch.operators.detectors import probing
from tidewatch.operators.detectors.base import as_vector, key_hash, matrix
from tidewatch.session import materialize

K_GRID = (20, 35, 50)
MAX_PIVOTS = 1024
CELL = 500
QUERY_BLOCK, REF_BLOCK = None, 4096  # None: as many queries as `probing.meet` deals out
TINY = 1e-10


def point_id(vector: Column) -> Column:
    """128 hash bits of the coordinates."""
    return F.concat(F.hex(F.xxhash64(F.lit(1), vector)), F.lit("-"), F.hex(F.xxhash64(F.lit(2), vector)))


def distinct_points(df: DataFrame, features: list[str] | str) -> DataFrame:
    """(id, x, w): each point once, with its number of copies."""
    return df.groupBy(as_vector(features).alias("x")).agg(F.count("*").alias("w")).select(
        point_id(F.col("x")).alias("id"), "x", "w"
    )


def nearest_pivot(vector: Column, pivots: np.ndarray) -> Column:
    @F.pandas_udf("cell int, away double")
    def assign(vectors: pd.Series) -> pd.DataFrame:
        x = matrix(vectors)
        cells, away = np.zeros(len(x), dtype=np.int32), np.zeros(len(x))
        for i in range(0, len(x), 256):
            part = x[i : i + 256]
            d = np.sqrt(((part[:, None, :] - pivots[None, :, :]) ** 2).sum(2)) if len(pivots) <= 64 else _cross(part, pivots)
            best = d.argmin(1)
            cells[i : i + 256] = best
            away[i : i + 256] = np.sqrt(((part - pivots[best]) ** 2).sum(1))
        return pd.DataFrame({"cell": cells, "away": away})

    return assign(vector)


def _cross(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances by the product form, centred against cancellation."""
    centre = b.mean(0)
    a, b = a - centre, b - centre
    squared = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(squared, 0.0))


def _bounds(refs: DataFrame, query_cells: pd.DataFrame, pivots: np.ndarray, need: int) -> np.ndarray:
    """lower[i, j]: a reference of cell j closer to its pivot than this cannot be among
    the `need` nearest of any query of cell i. inf where cell i has no query."""
    by_away = W.partitionBy("cell").orderBy("away", "id")
    nearest = (
        refs.select("cell", "away", "id", "w")
        .withColumn("rn", F.row_number().over(by_away))
        .where(F.col("rn") <= need)
        .select("cell", "away", "w")
        .toPandas()
    )  # at most MAX_PIVOTS * need rows
    between = _cross(pivots, pivots)
    reach = np.full(len(pivots), -1.0)
    reach[query_cells["cell"].to_numpy()] = query_cells["reach"].to_numpy()
    cell, away, weight = (nearest[c].to_numpy() for c in ("cell", "away", "w"))
    lower = np.full((len(pivots), len(pivots)), np.inf)
    for i in np.flatnonzero(reach >= 0):
        upper = reach[i] + between[i, cell] + away
        order = np.argsort(upper, kind="stable")
        enough = np.searchsorted(np.cumsum(weight[order]), need)
        theta = upper[order[min(enough, len(order) - 1)]]
        lower[i] = (between[i] - reach[i] - theta) - 1e-9 * (1.0 + between[i] + theta)
    return lower


def knn_join(queries: DataFrame, refs: DataFrame, k: int, same: bool = False) -> DataFrame:
    """(query, id, dist, w): the k nearest references of each query, by total weight w.

    queries: (id, x), refs: (id, x, w), ids unique on each side. same=True joins a set of
    points with itself; a point is not its own neighbour, but its copies are. Exact.
    """
    # copies count as neighbours, so one more point covers the query itself
    return _exact(queries, refs, k + 1 if same else k, ["id", "w"], _by_weight(k, same), NEAR)


def _exact(queries: DataFrame, refs: DataFrame, need: int, payload: list[str], finish, out: T.StructType | str) -> DataFrame:
    """Shows queries (id, x) the references (id, x, w, ...) that can be among their `need` nearest. Reads both several times."""
    n_refs = refs.count()
    size = int(min(MAX_PIVOTS, max(1, n_refs // CELL)))
    sample = refs.select("x", "id").orderBy(key_hash(["id"], 7), "id").limit(size).toPandas()
    pivots = matrix(sample["x"])
    place = lambda df: df.withColumn("_p", nearest_pivot(F.col("x"), pivots)).select(
        *df.columns, "_p.cell", "_p.away"
    )
    placed_refs, placed = place(refs), place(queries.select("id", "x"))
    query_cells = placed.groupBy("cell").agg(F.max("away").alias("reach"), F.count("*").alias("n")).toPandas()
    lower = _bounds(placed_refs, query_cells, pivots, need)
    held = placed_refs.groupBy("cell").agg(F.max("away").alias("farthest"), F.count("*").alias("n")).toPandas()
    sizes, farthest = np.zeros(len(pivots), np.int64), np.zeros(len(pivots))
    sizes[held["cell"]], farthest[held["cell"]] = held["n"], held["farthest"]
    cells = probing.packed(placed_refs, sizes, [*payload, "away"], REF_BLOCK)
    asked = placed.select("id", "x", "cell")
    return probing.meet(cells, sizes, pivots, lambda home: lower[home], asked, need, payload, finish, out, farthest, QUERY_BLOCK)


NEAR = "query string, id string, dist double, w long"


def _by_weight(k: int, same: bool):
    """The nearest points up to a total weight of k; a query itself counts its other copies only."""

    def rows(ids: np.ndarray, dist: np.ndarray, kept: list[np.ndarray]) -> pa.RecordBatch:
        near, w = kept[0], kept[1].astype(np.int64)
        if same:
            w = w - (near == ids[:, None])
        w = np.minimum(w, np.maximum(k - (np.cumsum(w, 1) - w), 0))
        some = w > 0
        columns = [np.broadcast_to(ids[:, None], w.shape)[some], near[some], dist[some], w[some]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), None, None))], ["query", "id", "dist", "w"])

    return rows


def probing_join(index: probing.Index, k: int) -> DataFrame:
    """(query, id, dist, w) of the index's own points, as `knn_join` gives them, with the index's recall."""
    return probing.probe(index, index.refs.select("id", "x", "cell"), k + 1, ["id", "w"], _by_weight(k, same=True), NEAR)


@dataclass
class LofModel:
    """refs: (id, x, w, kdist, lrd), written to the shared folder; with an index also their cell."""

    features: list[str] | str
    refs: DataFrame
    k: int
    index: probing.Index | None = None

    def transform(self, df: DataFrame, name: str = "score") -> DataFrame:
        """Each distinct point is scored where it meets its neighbours; rows get the score of their point."""
        k = self.k

        def score(ids: np.ndarray, dist: np.ndarray, kept: list[np.ndarray]) -> pa.RecordBatch:
            w, kdist, lrd = (c.astype(float) for c in kept)
            w = np.minimum(w, np.maximum(k - (np.cumsum(w, 1) - w), 0))
            total = w.sum(1)
            own = 1.0 / ((w * np.maximum(dist, kdist)).sum(1) / total + TINY)
            around = (w * lrd).sum(1) / total
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(around / own)], ["_point", name])

        out = T.StructType([T.StructField("_point", T.StringType()), T.StructField(name, T.DoubleType())])
        points = materialize(distinct_points(df, self.features).select("id", "x"), "lof-asked")
        payload = ["w", "kdist", "lrd"]
        if self.index:
            scored = probing.probe(self.index, probing.placed(points, self.index.pivots), k, payload, score, out)
        else:
            scored = _exact(points, self.refs, k, payload, score, out)
        rest = df.drop(name) if name in df.columns else df
        return rest.withColumn("_point", point_id(as_vector(self.features))).join(scored, "_point").drop("_point")


def fit(df: DataFrame, features: list[str] | str, k: int = 20, recall: float | None = None) -> LofModel:
    """Local reachability density of every reference point: exact, or probing with a wanted recall."""
    points = materialize(distinct_points(df, features), "lof-points")
    copies = points.agg(F.sum("w").alias("n")).first()["n"]
    k = min(k, copies - 1)
    index = probing.build(points, k, recall) if recall is not None else None
    joined = probing_join(index, k) if index else knn_join(points.select("id", "x"), points, k, same=True)
    near = materialize(joined, "lof-near")
    kdist = near.groupBy("query").agg(F.max("dist").alias("kdist"))
    reach = near.join(kdist.withColumnRenamed("query", "id"), "id")
    w = F.col("w")
    density = reach.groupBy("query").agg(
        (1.0 / (F.sum(w * F.greatest("dist", "kdist")) / F.sum(w) + F.lit(TINY))).alias("lrd")
    )
    known = index.refs if index else points
    refs = materialize(known.join(kdist.join(density, "query").withColumnRenamed("query", "id"), "id"), "lof-model")
    return LofModel(features, refs, k, index.with_refs(refs, ["w", "kdist", "lrd"]) if index else None)
