"""Stream sources of readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.schemas import READING_REQUEST
from tidewatch.session import pin

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> SparkSession:
    """Keyed state lives off-heap and is checkpointed as change logs."""
    pin(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    return spark


def reading_stream(
    spark: SparkSession, path: str, schema: T.StructType = READING_REQUEST, files_per_trigger: int | None = None, glob: str | None = None
) -> DataFrame:
    """Readings as parquet files; a Kafka topic of the same schema takes its place in production.

    files_per_trigger bounds a micro-batch, and with it the rows that one sensor can
    bring into one stateful call.
    """
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path)


def requests(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid readings, rejected rows): a reading needs a time and a sensor; a missing
    value is allowed and handled by the scoring rules."""
    ok = F.col("ts").isNotNull() & F.col("sensor_id").isNotNull()
    return df.where(ok), df.where(~ok)
