"""Cleaning: parse, deduplicate, put on a regular grid, fill the gaps.

After `bucket_to_grid` / `drop_duplicate_timestamps` a sensor owns at most one
row per grid slot, so a (sensor, chunk) group of CHUNK slots can never hold more
than CHUNK rows, however hot the sensor is. Every ordered step below works
inside such groups and passes only one summary row per chunk between them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewatch.schemas import STEP_SECONDS

CHUNK = 1024
SHORT_GAP = 3


def floor_div(column: Column, size: int) -> Column:
    return F.floor(column / F.lit(size)).cast("bigint")


def parse_readings(df: DataFrame, ts: str = "timestamp", fmt: str | None = None) -> DataFrame:
    """Text to TIMESTAMP. Order is only ever imposed inside windows, not on the table."""
    return df.withColumn(ts, F.to_timestamp(F.col(ts), fmt) if fmt else F.to_timestamp(F.col(ts)))


def attach_sensor(df: DataFrame, sensor_id: str) -> DataFrame:
    return df.withColumn("sensor_id", F.lit(sensor_id))


def drop_duplicate_timestamps(df: DataFrame, seq: str = "seq") -> DataFrame:
    """Keep the row ingested last per (sensor, ts), combined on the map side, so a timestamp
    with a third of all rows shrinks before the shuffle. With numbers and times only it is
    a hash aggregate; text columns make Spark sort first."""
    payload = [c for c in df.columns if c not in ("sensor_id", "ts")]
    last = F.coalesce(F.col(seq), F.lit(-1))
    fixed = ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean", "date", "timestamp", "decimal")
    if all(kind.startswith(fixed) for name, kind in df.dtypes if name in payload):
        return df.groupBy("sensor_id", "ts").agg(*[F.max_by(c, last).alias(c) for c in payload])
    kept = df.groupBy("sensor_id", "ts").agg(F.max_by(F.struct(*payload), last).alias("row"))
    return kept.select("sensor_id", "ts", *[F.col(f"row.{c}").alias(c) for c in payload])


def bucket_to_grid(df: DataFrame, step: int = STEP_SECONDS) -> DataFrame:
    """Snap off-grid readings to their slot; the last reading of a slot (ts, seq) wins."""
    slot = floor_div(F.unix_micros("ts"), step * 1_000_000) * step
    # One fixed-width number in the order (ts, seq): a hash aggregate can hold it, a struct not.
    seq = F.coalesce(F.col("seq").cast("decimal(20,0)"), F.lit(-(1 << 63)).cast("decimal(20,0)"))
    last = (
        F.unix_micros("ts").cast("decimal(18,0)") * F.lit("100000000000000000000").cast("decimal(21,0)") + seq
    ).cast("decimal(38,0)")
    kept = df.groupBy("sensor_id", slot.alias("slot")).agg(
        F.max_by("value", last).alias("value"), F.max_by("seq", last).alias("seq")
    )
    return kept.select("sensor_id", F.timestamp_seconds("slot").alias("ts"), "value", "seq")


def grid_bounds(df: DataFrame, step: int = STEP_SECONDS) -> DataFrame:
    """One row per sensor: first slot and number of slots, over all rows (NULL values too)."""
    second = F.unix_seconds("ts")
    return df.groupBy("sensor_id").agg(
        F.min(second).alias("first_slot"),
        (F.floor((F.max(second) - F.min(second)) / step) + 1).cast("bigint").alias("n_rows"),
    )


def slot_bounds(readings: DataFrame, step: int = STEP_SECONDS) -> DataFrame:
    """`grid_bounds` of the bucketed series, straight from the raw rows: two columns,
    combined on the map side, without waiting for the per-slot aggregate."""
    slot = floor_div(F.unix_micros("ts"), step * 1_000_000) * step
    return readings.groupBy("sensor_id").agg(
        F.min(slot).alias("first_slot"), (F.floor((F.max(slot) - F.min(slot)) / step) + 1).cast("bigint").alias("n_rows")
    )


def to_grid(readings: DataFrame, step: int = STEP_SECONDS) -> DataFrame:
    """Raw readings at any time -> the complete, gap-filled grid."""
    return fill_gaps(regrid(bucket_to_grid(readings, step), step, slot_bounds(readings, step)), step)


def regrid(df: DataFrame, step: int = STEP_SECONDS, bounds: DataFrame | None = None) -> DataFrame:
    """Rows on the grid min, min+step, ...; rows off the grid are dropped.

    Adds pos (0-based slot number) and n_rows (slots of the sensor). The bounds
    table has one row per sensor; its size decides at run time (AQE) whether it is
    broadcast, and a hot sensor is split by the skew-join rule otherwise.
    """
    offset = F.unix_seconds("ts") - F.col("first_slot")
    return (
        df.join(grid_bounds(df, step) if bounds is None else bounds, "sensor_id")
        .where(offset % step == 0)
        .withColumn("pos", floor_div(offset, step))
    )


def fill_gaps(df: DataFrame, step: int = STEP_SECONDS, short_gap: int = SHORT_GAP) -> DataFrame:
    """The complete grid: short gaps repeat the left value, longer ones are interpolated.

    Input: output of `regrid`. A gap is arithmetic between two neighbouring
    observed slots, so nothing is windowed over the grid itself. Slots before the
    first value stay NULL; a trailing gap repeats the last value.
    Output: sensor_id, pos, ts, value, imputed, n_rows, first_pos.
    """
    per_sensor = df.groupBy("sensor_id").agg(
        F.min("first_slot").alias("first_slot"),
        F.max("n_rows").alias("n_rows"),
        F.min(F.when(F.col("value").isNotNull(), F.col("pos"))).alias("first_pos"),
    )
    # a NULL "observation" at -1 makes the leading gap an ordinary one
    head = per_sensor.select("sensor_id", F.lit(-1).cast("bigint").alias("pos"), F.lit(None).cast("double").alias("value"))
    observed = (
        df.where(F.col("value").isNotNull())
        .select("sensor_id", "pos", "value")
        .unionByName(head)
        .withColumn("chunk", floor_div(F.col("pos"), CHUNK))
    )
    point = F.struct("pos", "value")
    edges = (
        observed.groupBy("sensor_id", "chunk")
        .agg(F.min(point).alias("first"))
        .join(per_sensor, "sensor_id")
        .withColumn("after", F.lead("first").over(W.partitionBy("sensor_id").orderBy("chunk")))
        .drop("first")
    )
    by_pos = W.partitionBy("sensor_id", "chunk").orderBy("pos")
    pairs = (
        observed.withColumn("next", F.lead(point).over(by_pos))
        .join(edges, ["sensor_id", "chunk"])
        .withColumn("next", F.coalesce("next", "after"))
        .select(
            "sensor_id",
            "first_slot",
            "n_rows",
            "first_pos",
            F.col("pos").alias("p0"),
            F.col("value").alias("v0"),
            F.coalesce(F.col("next.pos"), F.col("n_rows")).alias("p1"),
            F.coalesce(F.col("next.value"), F.col("value")).alias("v1"),
        )
    )
    lo = F.greatest(F.col("p0"), F.lit(0))
    hi = F.col("p1") - 1
    # two bounded explodes: an outage of years never becomes one huge array
    pieces = pairs.where(lo <= hi).withColumn(
        "chunk", F.explode(F.sequence(floor_div(lo, CHUNK), floor_div(hi, CHUNK)))
    )
    first = F.greatest(lo, F.col("chunk") * CHUNK)
    last = F.least(hi, F.col("chunk") * CHUNK + (CHUNK - 1))
    slots = pieces.withColumn("pos", F.explode(F.sequence(first, last)))
    k = F.col("pos") - F.col("p0")
    gap = F.col("p1") - F.col("p0") - 1
    line = F.col("v0") + (F.col("v1") - F.col("v0")) * k / (gap + 1)
    return slots.select(
        "sensor_id",
        "pos",
        F.timestamp_seconds(F.col("first_slot") + F.col("pos") * step).alias("ts"),
        F.when((k == 0) | (gap <= short_gap), F.col("v0")).otherwise(line).alias("value"),
        F.when((k == 0) & F.col("v0").isNotNull(), 0).otherwise(1).alias("imputed"),
        "n_rows",
        "first_pos",
    )


def gap_blocks(df: DataFrame, step: int = STEP_SECONDS) -> DataFrame:
    """Every block of missing slots with its size, from the gap-filled grid.

    A block is a maximal run of imputed slots; `runs` keys it by its first slot.
    """
    from tidewatch.operators.scan import runs

    marked = runs(df, ["sensor_id"], "pos", F.col("imputed") == 1, "block_start")
    return (
        marked.where(F.col("block_start").isNotNull())
        .groupBy("sensor_id", "block_start")
        .agg(F.count("*").alias("block_size"))
    )


def clean_series(df: DataFrame, step: int = STEP_SECONDS) -> DataFrame:
    """Deduplicate, re-grid and fill a series whose timestamps are grid times."""
    return fill_gaps(regrid(drop_duplicate_timestamps(df), step), step)


def drop_incomplete(df: DataFrame, features: list[str]) -> DataFrame:
    """Offline rule: a row with any missing feature is left out."""
    return df.na.drop(subset=features)


def zero_fill(df: DataFrame, features: list[str]) -> DataFrame:
    """Online rule: a missing value, or a missing column, counts as 0."""
    for name in features:
        if name not in df.columns:
            df = df.withColumn(name, F.lit(0.0))
    return df.na.fill(0.0, subset=features)
