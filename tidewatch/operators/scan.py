"""Ordered scans without a window over a whole key.

`W.partitionBy(sensor)` would put a hot sensor into one task. These helpers
window inside bounded groups and carry one summary row per group across.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewatch.operators.clean import CHUNK, floor_div

BUCKET_ROWS = 1 << 16


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on keys that may be NULL: NULL meets NULL. Keeps the left keys."""
    renamed = right.select(*[F.col(k).alias(f"_on_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_on_{k}"))
    return left.join(renamed, same, how).drop(*[f"_on_{k}" for k in keys])


def bucket_count(df: DataFrame) -> int:
    """The power of two that leaves about BUCKET_ROWS rows to a bucket, counted on the input."""
    rows = df.count()
    return max(2, 1 << (rows // BUCKET_ROWS).bit_length())


def count_below(sorted_array: Column, value: Column, bits: int | None = None) -> Column:
    """How many entries of an ascending array are < value, by binary search.

    `bits`: for arrays of at most 2**bits - 1 entries; else it follows each array's size.
    Places behind the end read as NULL, which is never < value."""
    if bits is None:
        width = F.length(F.bin(F.size(sorted_array)))
        jumps = F.transform(F.sequence(width - 1, F.lit(0)), lambda b: F.call_function("shiftleft", F.lit(1), b))
    else:
        jumps = F.array(*[F.lit(1 << b) for b in reversed(range(bits))])
    return F.aggregate(
        jumps,
        F.lit(0),
        lambda at, jump: F.when(F.get(sorted_array, at + jump - 1) < value, at + jump).otherwise(at),
    )


def cut_points(df: DataFrame, keys: list[str], value: str, buckets: int, extra: list[Column] | None = None) -> DataFrame:
    """Per key, the values that split its rows into about equal buckets (mergeable sketch)."""
    probs = [i / buckets for i in range(1, buckets)]
    return df.groupBy(*keys).agg(
        F.percentile_approx(F.col(value).cast("double"), probs, max(10000, 4 * buckets)).alias("cuts"),
        *(extra or []),
    )


def add_bucket(df: DataFrame, keys: list[str], value: str, extra: list[Column] | None = None) -> DataFrame:
    """Adds `bucket`: order-preserving, balanced, equal values together.

    The cut table has one row per key with fewer numbers than there are buckets; without
    keys it is a scalar. A NULL key is a key like any other.
    """
    buckets = bucket_count(df)
    bits = buckets.bit_length() - 1
    cuts = cut_points(df, keys, value, buckets, extra)
    with_cuts = join_on(df, cuts, keys) if keys else df.withColumn("cuts", cuts.scalar())
    return with_cuts.withColumn("bucket", count_below(F.col("cuts"), F.col(value).cast("double"), bits)).drop("cuts")


def running_total(
    df: DataFrame,
    keys: list[str],
    group: str,
    order: list[Column],
    sums: dict[str, Column],
    descending: bool = False,
) -> DataFrame:
    """Inclusive running sums along (group, order) per key.

    `group` must increase with the order and be bounded in rows. The carry table
    has one row per (key, group).
    """
    direction = F.col(group).desc() if descending else F.col(group)
    before = W.partitionBy(*keys).orderBy(direction).rowsBetween(W.unboundedPreceding, -1)
    totals = df.groupBy(*keys, group).agg(*[F.sum(e).alias(f"_t_{n}") for n, e in sums.items()])
    carry = totals.select(
        *keys, group, *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_c_{n}") for n in sums]
    )
    inside = W.partitionBy(*keys, group).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    local = df.select("*", *[F.sum(e).over(inside).alias(n) for n, e in sums.items()])
    joined = join_on(local, carry, [*keys, group])
    return joined.withColumns({n: F.col(n) + F.col(f"_c_{n}") for n in sums}).drop(*[f"_c_{n}" for n in sums])


def row_number(df: DataFrame, keys: list[str], value: str, ties: list[str], name: str = "row_no") -> DataFrame:
    """0-based position by (value, ties) per key; `value` must be numeric.

    Rows are windowed inside balanced buckets; only bucket counts meet in one place. A
    value that more than BUCKET_ROWS rows share is a group of its own, cut again by the
    first tie-break if that is a number. NULL keys are numbered like any other key.
    """
    placed = add_bucket(df, keys, value)
    order = [F.col(c) for c in (value, *ties)]
    numeric = bool(ties) and dict(df.dtypes)[ties[0]].startswith(("tinyint", "smallint", "int", "bigint", "float", "double", "decimal"))
    group = "bucket"
    if numeric:
        placed, group = split_ties(placed, keys, value, ties[0]), "_part"
    out = running_total(placed, keys, group, order, {name: F.lit(1)})
    return out.withColumn(name, (F.col(name) - 1).cast("bigint")).drop("bucket", group)


def split_ties(placed: DataFrame, keys: list[str], value: str, tie: str) -> DataFrame:
    """Adds `_part`, a struct in the order (bucket, value, tie). A value of more than BUCKET_ROWS rows
    is 64 parts of its bucket, the other values between two such ones are one part.

    The common values are at most rows / BUCKET_ROWS in number, and so are the parts, but for a factor."""
    number = F.col(tie).cast("double")
    common = (
        placed.groupBy(*keys, "bucket", value)
        .agg(F.count("*").alias("_n"))
        .where(F.col("_n") > BUCKET_ROWS)
        .select(*keys, "bucket", F.col(value).alias("_common"))
    )
    listed = common.groupBy(*keys, "bucket").agg(F.sort_array(F.collect_list("_common")).alias("_listed"))
    marked = join_on(placed, listed, [*keys, "bucket"], "left")
    cuts = join_on(placed.withColumn("_common", F.col(value)), common, [*keys, "bucket", "_common"]).groupBy(*keys, "bucket", "_common")
    cuts = cuts.agg(F.percentile_approx(number, F.lit([i / 64 for i in range(1, 64)]), F.lit(10000)).alias("_cuts"))
    marked = join_on(marked.withColumn("_common", F.col(value)), cuts, [*keys, "bucket", "_common"], "left")
    piece = F.when(F.col("_cuts").isNull(), 0).otherwise(count_below(F.col("_cuts"), number))
    among = 2 * count_below(F.col("_listed"), F.col(value)) + F.array_contains("_listed", F.col(value)).cast("int")
    among = F.when(F.col("_listed").isNull(), 0).otherwise(F.coalesce(among, F.lit(0)))
    part = F.struct("bucket", among.alias("among"), piece.alias("piece"))
    return marked.withColumn("_part", part).drop("_common", "_cuts", "_listed")


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float]) -> DataFrame:
    """(keys, prob, quantile): linear interpolation between order statistics, exact.

    Equal values are collapsed first; then only prefix counts travel. The
    percentile aggregate would hold all distinct values of a key in one task.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    rank = F.col("prob") * (F.col("total") - 1)
    lower, upper = F.floor(rank), F.ceil(rank)
    targets = (
        counts.groupBy(*keys)
        .agg(F.sum("n").alias("total"))
        .select(*keys, F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("prob"), "total")
        .select(*keys, "prob", (rank - lower).alias("share"), F.explode(F.array_distinct(F.array(lower, upper))).alias("target"))
    )
    need = targets.groupBy(*keys).agg(F.sort_array(F.collect_set("target")).alias("targets"))  # <= 2 per prob
    placed = add_bucket(counts, keys, value)
    ranked = running_total(placed, keys, "bucket", [F.col(value)], {"upto": F.col("n")})
    # a value covers the ranks [upto - n, upto); each wanted rank falls on one value
    covered = F.filter("targets", lambda t: (t >= F.col("upto") - F.col("n")) & (t < F.col("upto")))
    ranked = join_on(ranked, need, keys) if keys else ranked.withColumn("targets", need.scalar())
    found = ranked.select(*keys, F.explode(covered).alias("target"), F.col(value).alias("found"))
    return (
        join_on(targets, found, [*keys, "target"])
        .groupBy(*keys, "prob")
        .agg(F.max("share").alias("share"), F.min("found").alias("low"), F.max("found").alias("high"))
        .select(*keys, "prob", (F.col("low") + (F.col("high") - F.col("low")) * F.col("share")).alias("quantile"))
    )


def runs(df: DataFrame, keys: list[str], pos: str, hit: Column, name: str, chunk: int = CHUNK) -> DataFrame:
    """Adds `name`: the position where the current run of hits began, NULL outside runs.

    `pos` is a dense or sparse integer order. Rows of one chunk are at most
    `chunk`; each chunk passes on its last row's flag and its last run start.
    """
    src = df.withColumn("_hit", F.coalesce(hit, F.lit(False))).withColumn("_chunk", floor_div(F.col(pos), chunk))
    inside = W.partitionBy(*keys, "_chunk").orderBy(pos)
    local = src.withColumn("_prev", F.lag("_hit").over(inside)).withColumn(
        # the first row of a chunk starts a run only provisionally
        "_start", F.when(F.col("_hit") & ~F.coalesce("_prev", F.lit(False)), F.col(pos))
    )
    ends = local.groupBy(*keys, "_chunk").agg(
        F.max_by("_hit", pos).alias("_end_hit"),
        F.max("_start").alias("_last"),
        F.min_by("_hit", pos).alias("_head_hit"),
        F.min(pos).alias("_head"),
    )
    across = W.partitionBy(*keys).orderBy("_chunk")
    ends = ends.withColumn("_prev_end", F.lag("_end_hit").over(across))
    # the provisional start of a chunk is void when the previous chunk ended in a run
    void = F.col("_head_hit") & F.coalesce("_prev_end", F.lit(False))
    ends = ends.withColumn("_real", F.when(void & (F.col("_last") == F.col("_head")), None).otherwise(F.col("_last")))
    ends = ends.withColumn(
        "_carry", F.max("_real").over(across.rowsBetween(W.unboundedPreceding, -1))
    ).select(*keys, "_chunk", "_carry", void.alias("_void"), "_head")
    running = F.max("_start").over(inside.rowsBetween(W.unboundedPreceding, 0))
    out = join_on(local.withColumn("_run", running), ends, [*keys, "_chunk"])
    began = F.when(F.col("_void") & (F.col("_run") == F.col("_head")), F.col("_carry")).otherwise(F.col("_run"))
    return out.withColumn(name, F.when(F.col("_hit"), began)).drop(
        "_hit", "_chunk", "_prev", "_start", "_run", "_carry", "_void", "_head"
    )
