"""Scoring a stream end to end, its sinks, and running KPIs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewatch.operators import scoring, splits
from tidewatch.operators.detectors.base import Model
from tidewatch.schemas import ALERTS
from tidewatch.streaming.buffer import online_features


def score_stream(
    readings: DataFrame,
    scaler: DataFrame,
    model: Model | None,
    threshold: float,
    model_name: str,
    stats: list[tuple[str, float, float]],
    warm: DataFrame | None = None,
) -> DataFrame:
    """Readings -> scale -> buffer -> features -> score -> severity and reason.

    Without a model every row gets the fallback decision. A sensor without a fitted
    scaler is scored on its raw value. Late rows are passed on unscored with late = true.
    """
    rows = online_features(splits.apply_scaler(readings, scaler), warm)
    scored = model.transform(rows.na.fill(0.0, [s[0] for s in stats])) if model else rows.withColumn("score", F.lit(None).cast("double"))
    usable = F.col("value_scaled").isNotNull() & ~F.col("late")
    scored = scored.withColumn("score", F.when(usable, F.col("score")))
    explained = scoring.explain(scored, stats).withColumnRenamed("reason", "_why").drop("feature", "deviation")
    return scoring.decide(explained, F.lit(threshold), F.lit(model_name), F.col("_why")).drop("_why")


def reading_id() -> Column:
    """One number for a reading of any sensor, the same whenever the reading is replayed."""
    return F.xxhash64("sensor_id", F.unix_micros("ts"), "seq").bitwiseAND(F.lit((1 << 63) - 1))


def prediction_columns(df: DataFrame) -> DataFrame:
    return df.select(
        reading_id().alias("id"), "seq", "ts", "sensor_id", "value", "anomaly_score", "is_anomaly", "severity", "reason", "model", "late"
    )


def table_sink(root: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink: readings and alerts, one directory per batch.

    A replayed batch overwrites its own directory, so each reading is stored once. A reading
    raises one alert at most, which takes the reading's id; alerts have the columns of the
    alerts table, so listing, acknowledging and status updates run on them.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = prediction_columns(batch).persist()
        try:
            rows.write.mode("overwrite").parquet(f"{root}/readings/batch_id={batch_id}")
            alert = {
                "reading_id": F.col("id"), "score": F.col("anomaly_score"),
                "acknowledged": F.lit(False), "status": F.lit("new"),
            }
            known = {"id", "ts", "sensor_id", "severity", "reason"}
            hits = rows.where("is_anomaly").select(
                *[
                    alert.get(f.name, F.col(f.name) if f.name in known else F.lit(None)).cast(f.dataType).alias(f.name)
                    for f in ALERTS.fields
                ]
            )
            hits.write.mode("overwrite").parquet(f"{root}/alerts/batch_id={batch_id}")
        finally:
            rows.unpersist()

    return write


def run_available(
    stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None] | str, mode: str = "append"
) -> StreamingQuery:
    """Process what is there and stop. A second call with the same checkpoint goes on
    where the first one ended. sink: a foreachBatch function or a parquet path."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query = writer.format("parquet").start(sink) if isinstance(sink, str) else writer.foreachBatch(sink).start()
    query.awaitTermination()
    return query


def running_kpis(
    readings: DataFrame, width: str = "1 minute", slide: str | None = None, lateness: str = "10 minutes", hit: Column | None = None
) -> DataFrame:
    """Per time window: readings, anomalies, mean value. Rows later than the watermark
    are dropped by the engine and counted in its progress metrics."""
    hit = F.lit(False) if hit is None else hit
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return (
        readings.withWatermark("ts", lateness)
        .groupBy(window.alias("w"))
        .agg(F.count("*").alias("n"), F.count_if(hit).alias("anomalies"), F.avg("value").alias("mean_value"))
        .select(F.col("w.start").alias("window_start"), "n", "anomalies", "mean_value")
    )


def dropped_late(query: StreamingQuery) -> int:
    """Rows dropped by the watermark over the life of the query."""
    total = 0
    for progress in query.recentProgress:
        for operator in progress.stateOperators:
            total += operator.numRowsDroppedByWatermark
    return total


def read_sink(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}")
