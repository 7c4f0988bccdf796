"""Model registry and experiment log as tables: every change is a new version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.scan import row_number

BASELINE = "rolling_zscore"


def upsert(registry: DataFrame, entries: DataFrame, seq: str = "seq") -> DataFrame:
    """The newest record per name replaces the whole older record.

    Both sides carry (registered_at, seq); a missing registered_at becomes now.
    Combined on the map side, so a name registered a billion times is shuffled once per task.
    Records hold text and maps, for which Spark sorts before it combines.
    """
    stamped = entries.withColumn("registered_at", F.coalesce("registered_at", F.current_timestamp()))
    both = registry.withColumn("_new", F.lit(0)).unionByName(stamped.withColumn("_new", F.lit(1)))
    rest = [c for c in both.columns if c not in ("name", "_new")]
    newest = both.groupBy("name").agg(F.max_by(F.struct(*rest), F.struct("_new", "registered_at", seq)).alias("m"))
    return newest.select("name", "m.*")


def get(registry: DataFrame, name: str) -> DataFrame:
    return registry.where(F.col("name") == name)


def set_production(registry: DataFrame, name: str) -> DataFrame:
    """Exactly one production model; an unknown name leaves the table as it is."""
    known = get(registry, name).agg(F.count("*")).scalar() > 0
    return registry.withColumn(
        "is_production", F.when(known, F.col("name") == name).otherwise(F.col("is_production"))
    )


def append_experiments(existing: DataFrame, records: DataFrame, order: str = "created_at", ties: tuple[str, ...] = ()) -> DataFrame:
    """New records get id = count + 1, + 2, ... in time order (distributed row numbers)."""
    timed = records.withColumn("_us", F.unix_micros(order))
    numbered = row_number(timed, [], "_us", list(ties), "_no").drop("_us")
    start = existing.agg(F.count("*")).scalar()
    fresh = numbered.withColumn("id", F.col("_no") + 1 + start).drop("_no")
    return existing.unionByName(fresh)


def select_model(registry: DataFrame, name: str | None = None) -> DataFrame:
    """(name, threshold, outcome). The threshold stored with the metrics wins over the
    one in the threshold file; the baseline and unknown artifacts are refused."""
    rows = registry if name is None else get(registry, name)
    refused: Column = F.when(F.col("name") == BASELINE, "refused: baseline").when(
        F.col("artifact_path").isNull(), "refused: no artifact"
    )
    threshold = F.coalesce(F.try_element_at("metrics", F.lit("threshold")), F.col("threshold"))
    outcome = F.coalesce(refused, F.lit("ok"))
    return rows.select("name", F.when(outcome == "ok", threshold).alias("threshold"), outcome.alias("outcome"))
