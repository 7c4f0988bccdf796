"""Shared inputs of the registered queries, in DataFrame form and in SQL form.

The SQL side is written independently of the DataFrame side (calendar join and
IGNORE NULLS instead of gap arithmetic, self joins instead of carried sums), so
that agreement means something.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import clean, features, splits
from tidewatch.plans.store import stored
from tidewatch.sources.series import event_readings

# fixed values: labelled failure windows of the event series, both ends inclusive
EVENT_WINDOWS = [
    ("2024-01-08 06:25:00", "2024-01-10 05:35:00"),
    ("2024-01-24 17:50:00", "2024-01-25 17:00:00"),
    ("2024-01-27 14:20:00", "2024-01-28 13:30:00"),
]


def r(column: Column | str, digits: int = 6) -> Column:
    return F.round(column, digits)


def slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.bucket_to_grid(event_readings(spark, sf_dir))


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.to_grid(event_readings(spark, sf_dir))


def stored_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cleaned series is read several times per plan (bounds of the scaler, carried
    means, features), so it is written once, narrow and compressed."""
    return stored(spark, sf_dir, "grid", lambda: grid(spark, sf_dir))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.chronological_split(splits.label_windows(stored_grid(spark, sf_dir), EVENT_WINDOWS))


def scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir)
    return splits.apply_scaler(rows, splits.fit_scaler(splits.burn_in(rows)))


def feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.rolling_features(scaled(spark, sf_dir))


def with_ctes(names: list[str], select: str) -> str:
    """WITH clause holding the named fragments and all they depend on."""
    seen: list[str] = []

    def add(name: str) -> None:
        for dep in DEPENDS.get(name, ()):
            add(dep)
        if name not in seen:
            seen.append(name)

    for name in names:
        add(name)
    body = ",\n".join(f"{n} AS ({FRAGMENTS[n]})" for n in seen)
    return f"WITH {body}\n{select}"


FRAGMENTS: dict[str, str] = {}
DEPENDS: dict[str, tuple[str, ...]] = {}


def fragment(name: str, sql: str, *depends: str) -> None:
    FRAGMENTS[name] = sql
    DEPENDS[name] = depends


fragment("readings", "SELECT event_type AS sensor_id, ts, value, event_id AS seq FROM events")
fragment(
    "slots",
    """SELECT sensor_id, to_timestamp(slot)::TIMESTAMP AS ts, slot, value, seq FROM (
         SELECT *, CAST(floor(epoch(ts) / 300) AS BIGINT) * 300 AS slot FROM readings)
       QUALIFY row_number() OVER (PARTITION BY sensor_id, slot ORDER BY ts DESC, seq DESC) = 1""",
    "readings",
)
fragment(
    "bounds",
    "SELECT sensor_id, min(slot) AS lo, max(slot) AS hi, (max(slot) - min(slot)) // 300 + 1 AS n_rows FROM slots GROUP BY 1",
    "slots",
)
fragment(
    "grid_raw",
    """SELECT c.sensor_id, c.pos, c.n_rows, c.lo, s.value AS raw
       FROM (SELECT sensor_id, lo, n_rows, unnest(range(0, n_rows)) AS pos FROM bounds) c
       LEFT JOIN slots s ON s.sensor_id = c.sensor_id AND s.slot = c.lo + c.pos * 300""",
    "bounds",
)
fragment(
    "grid",
    """SELECT sensor_id, pos, n_rows, to_timestamp(lo + pos * 300)::TIMESTAMP AS ts,
              CASE WHEN raw IS NULL THEN 1 ELSE 0 END AS imputed,
              CASE WHEN raw IS NOT NULL THEN raw
                   WHEN coalesce(p1, n_rows) - coalesce(p0, -1) - 1 <= 3 THEN v0
                   ELSE v0 + (coalesce(v1, v0) - v0) * CAST(pos - p0 AS DOUBLE) / (coalesce(p1, n_rows) - p0) END AS value,
              CASE WHEN raw IS NULL THEN coalesce(p0, -1) + 1 END AS block_start
       FROM (SELECT *,
                    last_value(raw IGNORE NULLS) OVER back AS v0,
                    last_value(CASE WHEN raw IS NOT NULL THEN pos END IGNORE NULLS) OVER back AS p0,
                    first_value(raw IGNORE NULLS) OVER ahead AS v1,
                    first_value(CASE WHEN raw IS NOT NULL THEN pos END IGNORE NULLS) OVER ahead AS p1
             FROM grid_raw
             WINDOW back AS (PARTITION BY sensor_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                    ahead AS (PARTITION BY sensor_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))""",
    "grid_raw",
)
_inside = " OR ".join(f"ts BETWEEN TIMESTAMP '{a}' AND TIMESTAMP '{b}'" for a, b in EVENT_WINDOWS)
fragment(
    "labelled",
    f"""SELECT *, CASE WHEN {_inside} THEN 1 ELSE 0 END AS label,
              CASE WHEN pos < floor(n_rows * 0.70::DOUBLE) THEN 'train'
                   WHEN pos < floor(n_rows * 0.85::DOUBLE) THEN 'val' ELSE 'test' END AS split
       FROM grid""",
    "grid",
)
fragment(
    "scaler",
    """SELECT sensor_id, avg(value) AS mean,
              CASE WHEN stddev_pop(value) = 0 THEN 1.0::DOUBLE ELSE stddev_pop(value) END AS scale
       FROM labelled
       WHERE label = 0 AND pos < floor(floor(n_rows * 0.70::DOUBLE) * 0.15::DOUBLE)
       GROUP BY sensor_id""",
    "labelled",
)
fragment(
    "scaled",
    "SELECT l.*, (l.value - s.mean) / s.scale AS x FROM labelled l JOIN scaler s USING (sensor_id)",
    "scaler",
)


def _rolling_sql() -> str:
    parts = [f"lag(x, {k}) OVER o AS lag_{k}" for k in (1, 2, 3)] + ["x - lag(x, 1) OVER o AS roc"]
    frames = ["o AS (PARTITION BY sensor_id ORDER BY pos)"]
    for w in features.WINDOWS:
        frames.append(f"f{w} AS (PARTITION BY sensor_id ORDER BY pos ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)")
        for name, agg in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max")):
            parts.append(f"CASE WHEN count(x) OVER f{w} = {w} THEN {agg}(x) OVER f{w} END AS roll_{name}_{w}")
    return f"SELECT *, {', '.join(parts)} FROM scaled WINDOW {', '.join(frames)}"


fragment("rolled", _rolling_sql(), "scaled")
fragment(
    "zscores",
    "SELECT *, "
    + ", ".join(f"(x - roll_mean_{w}) / (roll_std_{w} + 1e-9) AS zscore_{w}" for w in features.WINDOWS)
    + " FROM rolled",
    "rolled",
)
# weights older than these many rows are below 1e-20
REACH = {5: 120, 15: 350, 60: 1400}


def _ewma_sql(w: int) -> str:
    q = f"(1 - 2.0::DOUBLE / ({w} + 1))"
    return f"""SELECT t.sensor_id, t.pos,
              sum(CASE WHEN s.pos = 0 THEN pow({q}, t.pos) ELSE (1 - {q}) * pow({q}, t.pos - s.pos) END * s.x) AS ewma_{w}
       FROM (SELECT sensor_id, pos, unnest(range(greatest(0, pos - {REACH[w]}), pos + 1)) AS src FROM scaled) t
       JOIN scaled s ON s.sensor_id = t.sensor_id AND s.pos = t.src
       GROUP BY 1, 2"""


for _w in features.WINDOWS:
    fragment(f"ewma_{_w}", _ewma_sql(_w), "scaled")
fragment(
    "features",
    "SELECT z.*, " + ", ".join(f"ewma_{w}" for w in features.WINDOWS) + " FROM zscores z "
    + " ".join(f"JOIN ewma_{w} USING (sensor_id, pos)" for w in features.WINDOWS),
    "zscores",
    *[f"ewma_{w}" for w in features.WINDOWS],
)


def _buffered_sql(w: int) -> str:
    q = f"(1 - 2.0::DOUBLE / ({w} + 1))"
    return f"""SELECT t.sensor_id, t.pos,
              sum(CASE WHEN s.pos = t.oldest THEN pow({q}, t.pos - t.oldest)
                       ELSE (1 - {q}) * pow({q}, t.pos - s.pos) END * s.x) AS ewma_{w}
       FROM (SELECT sensor_id, pos, greatest(0, pos - 64) AS oldest,
                    unnest(range(greatest(0, pos - 64), pos + 1)) AS src FROM scaled) t
       JOIN scaled s ON s.sensor_id = t.sensor_id AND s.pos = t.src
       GROUP BY 1, 2"""


for _w in features.WINDOWS:
    fragment(f"buffered_{_w}", _buffered_sql(_w), "scaled")
fragment(
    "online_features",
    "SELECT z.sensor_id, z.pos, z.ts, "
    + ", ".join(
        f"coalesce({c if not c.startswith('ewma') else 'b' + c.split('_')[1] + '.' + c}, 0) AS {c}" for c in features.FEATURES
    )
    + " FROM zscores z "
    + " ".join(f"JOIN buffered_{w} b{w} ON b{w}.sensor_id = z.sensor_id AND b{w}.pos = z.pos" for w in features.WINDOWS),
    "zscores",
    *[f"buffered_{w}" for w in features.WINDOWS],
)


def rsql(expr: str, name: str, digits: int = 6) -> str:
    """Rounded like Spark; adding 0.0 turns a negative zero into zero."""
    return f"round({expr}, {digits}) + 0.0::DOUBLE AS {name}"
