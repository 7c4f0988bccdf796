"""Replay context while the stream runs: alerts meet the readings around them in an interval join.

Both sides are streams with a watermark. Ids decide who belongs to whom; a bound on the time
between an alert and its readings lets the engine forget rows that nobody can ask for any more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.alerts import CONTEXT
from tidewatch.operators.clean import floor_div

BUCKET = 64


def replay_stream(alerts: DataFrame, readings: DataFrame, context: int = CONTEXT, span: str = "7 days", delay: str = "1 hour") -> DataFrame:
    """(alert_id, id, ts, sensor_id, value, anomaly_score) for readings whose id is within `context` of the
    alert's reading and whose time is within `span` of the alert's.

    A row is written when both sides have arrived, so context behind an alert follows later.
    Ids are cut into buckets of at least `context`, so an alert asks for three and the join is on equal buckets."""
    size = max(BUCKET, context)
    asked = alerts.withWatermark("ts", delay).select(
        F.col("id").alias("alert_id"),
        F.col("reading_id").alias("centre"),
        F.col("ts").alias("alert_ts"),
        F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: floor_div(F.col("reading_id"), size) + k)).alias("bucket"),
    )
    given = readings.withWatermark("ts", delay).select(
        "id", "ts", "sensor_id", "value", "anomaly_score", floor_div(F.col("id"), size).alias("own")
    )
    near = (F.col("bucket") == F.col("own")) & F.col("id").between(F.greatest(F.lit(1), F.col("centre") - context), F.col("centre") + context)
    timely = F.expr(f"ts >= alert_ts - INTERVAL {span} AND ts <= alert_ts + INTERVAL {span}")
    return asked.join(given, near & timely).select("alert_id", "id", "ts", "sensor_id", "value", "anomaly_score")
