"""Online features of a micro-batch by (sensor, chunk of rows), for sensors that are too hot for one task.

`buffer.py` hands a sensor's rows of a micro-batch to one stateful call. Here a micro-batch is a
table like any other: its rows get dense positions behind the sensor's newest 64 stored ones,
counted by stretches of time, and go through the batch features, whose groups are chunks of
bounded size with a halo and a carried mean. State is those 64 rows per sensor, written as a new version by each micro-batch, so a
replayed batch reads what it read before and writes the same again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.operators.clean import floor_div
from tidewatch.operators.drift import live_window
from tidewatch.operators.features import BUFFER, FEATURES, rolling_features
from tidewatch.operators.scan import running_total
from tidewatch.streaming.buffer import INPUT, OUTPUT

KEPT = BUFFER - 1
#: Rows of a sensor within so many seconds are numbered together.
SPAN_SECONDS = 6 * 3600
STATE = T.StructType([f for f in OUTPUT.fields if f.name in ("sensor_id", "ts", "seq", "value_scaled")])


def features_of_batch(rows: DataFrame, old: DataFrame, span_seconds: int = SPAN_SECONDS) -> tuple[DataFrame, DataFrame]:
    """(OUTPUT rows, new state) of new readings behind stored ones (STATE, at most 64 a sensor).

    Rows go by (ts, seq). A row older than its sensor's newest stored one is late: it leaves
    unused. A missing value gets its row but is not buffered."""
    last = old.groupBy("sensor_id").agg(F.max("ts").alias("_last"), F.count("*").alias("_n_old"))
    marked = rows.select(*INPUT).join(last, "sensor_id", "left")
    marked = marked.withColumn("late", F.coalesce(F.col("ts") < F.col("_last"), F.lit(False)))
    usable = ~F.col("late") & F.col("value_scaled").isNotNull()

    fresh = marked.where(usable).withColumn("_us", F.unix_micros("ts"))
    fresh = fresh.withColumn("_span", floor_div(F.col("_us"), span_seconds * 1_000_000)).repartition("sensor_id", "_span")
    fresh = running_total(fresh, ["sensor_id"], "_span", [F.col("_us"), F.col("seq")], {"_n": F.lit(1)})
    place = F.col("_n") - 1 + F.coalesce("_n_old", F.lit(0))
    fresh = fresh.select(*INPUT, place.cast("bigint").alias("pos"), F.lit(True).alias("_new"))
    in_order = W.partitionBy("sensor_id").orderBy("ts", "seq")  # 64 rows at most
    before = old.select(
        "sensor_id", "ts", "seq", F.lit(None).cast("double").alias("value"), "value_scaled",
        (F.row_number().over(in_order) - 1).cast("bigint").alias("pos"), F.lit(False).alias("_new"),
    )
    series = before.unionByName(fresh)
    table = rolling_features(series, online=True).where("_new").withColumn("late", F.lit(False))
    names = [f.name for f in OUTPUT.fields]
    unused = marked.where(~usable).select(*INPUT, "late", *[F.lit(None).cast("double").alias(c) for c in FEATURES])
    state = live_window(series.select(*STATE.names, "pos"), ["sensor_id"], [F.col("pos")], KEPT).select(*STATE.names)
    return table.select(*names).unionByName(unused.select(*names)), state


class ChunkedFeatures:
    """A foreachBatch function: features under root/features, versions of the state under root/state."""

    def __init__(self, spark: SparkSession, root: str, warm: DataFrame | None = None):
        self.root = root
        start = warm.select(*STATE.names) if warm is not None else spark.createDataFrame([], STATE)
        start = live_window(start, ["sensor_id"], [F.col("ts"), F.col("seq")], KEPT)
        try:
            start.write.parquet(f"{root}/state/batch_id=-1")
        except Exception as error:  # a restarted query finds its first version
            if "PATH_ALREADY_EXISTS" not in str(error):
                raise

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        versions = spark.read.schema(T.StructType([*STATE.fields, T.StructField("batch_id", T.LongType())])).parquet(f"{self.root}/state")
        newest = self._newest(spark, batch_id)
        old = versions.where(F.col("batch_id") == newest).drop("batch_id")
        rows = batch.persist()
        try:
            features, state = features_of_batch(rows, old)
            features.write.mode("overwrite").parquet(f"{self.root}/features/batch_id={batch_id}")
            state.write.mode("overwrite").parquet(f"{self.root}/state/batch_id={batch_id}")
        finally:
            rows.unpersist()

    def _newest(self, spark: SparkSession, before: int) -> int:
        """The newest version that an earlier batch has finished."""
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/state")
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        names = [status.getPath() for status in files.listStatus(path)]
        done = [int(p.getName().split("=")[1]) for p in names if files.exists(p.suffix("/_SUCCESS"))]
        return max(number for number in done if number < before)


def read_features(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(OUTPUT).parquet(f"{root}/features").select(*OUTPUT.names)
