"""Scoring with the model that is in production now, looked up by every micro-batch.

The registry is a versioned table: each change is a new version below its root. A micro-batch
reads the newest finished version, loads the production model it names (kept until another one
is named) and writes its predictions with the model's name, the registry's version and the
threshold. Promoting a model between two deliveries therefore changes who scores, without a
restart; the state of the features goes on.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.operators import registry, scoring
from tidewatch.operators.detectors import store
from tidewatch.operators.detectors.base import Model
from tidewatch.operators.features import FEATURES


class RefusedModel(ValueError):
    """The named model may not serve: unknown, the baseline, or without an artifact."""


def _versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the finished versions below a root."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return []
    found = [s.getPath() for s in files.listStatus(path) if s.getPath().getName().startswith("version=")]
    return sorted(int(p.getName().split("=")[1]) for p in found if files.exists(p.suffix("/_SUCCESS")))


def publish(models: DataFrame, root: str) -> int:
    """The registry as its next version; a version is seen once it is written whole."""
    number = max(_versions(models.sparkSession, root), default=0) + 1
    models.write.parquet(f"{root}/version={number}")
    return number


def current(spark: SparkSession, root: str) -> tuple[int, DataFrame]:
    versions = _versions(spark, root)
    if not versions:
        raise FileNotFoundError(f"no finished registry at {root}")
    return versions[-1], spark.read.parquet(f"{root}/version={versions[-1]}")


def promote(spark: SparkSession, root: str, name: str) -> int:
    """Publishes a registry with `name` in production. Refuses what may not serve and changes nothing then."""
    _, models = current(spark, root)
    chosen = registry.select_model(models, name).first()
    if chosen is None:
        raise RefusedModel(f"unknown model {name}")
    if chosen["outcome"] != "ok":
        raise RefusedModel(f"{name}: {chosen['outcome']}")
    return publish(registry.set_production(models, name), root)


@dataclass
class Serving:
    """What scores at present."""

    name: str
    version: int
    threshold: float
    model: Model


class ModelServer:
    """A foreachBatch function over rows with features: predictions under root/predictions, by batch.

    A replayed batch may find a newer registry; its directory is written anew as a whole, so no
    batch is ever scored by two models."""

    def __init__(self, registry_root: str, root: str, features: list[str] = FEATURES):
        self.registry_root, self.root, self.features = registry_root, root, features
        self.serving: Serving | None = None

    def lookup(self, spark: SparkSession) -> Serving:
        version, models = current(spark, self.registry_root)
        if self.serving is not None and self.serving.version == version:
            return self.serving
        rows = models.where("is_production").join(registry.select_model(models).withColumnRenamed("threshold", "limit"), "name")
        row = rows.select("name", "artifact_path", "limit", "outcome").orderBy("name").first()
        if row is None:
            raise RefusedModel("no model is in production")
        if row["outcome"] != "ok":
            raise RefusedModel(f"{row['name']}: {row['outcome']}")
        same = self.serving is not None and self.serving.name == row["name"]
        model = self.serving.model if same else store.load(spark, row["artifact_path"])
        self.serving = Serving(row["name"], version, row["limit"], model)
        return self.serving

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        now = self.lookup(batch.sparkSession)
        scored = now.model.transform(batch.na.fill(0.0, self.features))
        out = scored.select(
            "sensor_id", "ts", "seq", "score",
            F.lit(now.threshold).alias("threshold"),
            (F.col("score") > now.threshold).alias("is_anomaly"),
            scoring.severity(F.col("score"), F.lit(now.threshold)).alias("severity"),
            F.lit(now.name).alias("model"),
            F.lit(now.version).alias("registry_version"),
        )
        out.write.mode("overwrite").parquet(f"{self.root}/predictions/batch_id={batch_id}")


PREDICTIONS = T.StructType(
    [
        T.StructField("sensor_id", T.StringType()), T.StructField("ts", T.TimestampType()), T.StructField("seq", T.LongType()),
        T.StructField("score", T.DoubleType()), T.StructField("threshold", T.DoubleType()), T.StructField("is_anomaly", T.BooleanType()),
        T.StructField("severity", T.StringType()), T.StructField("model", T.StringType()), T.StructField("registry_version", T.IntegerType()),
    ]
)


def read_predictions(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(PREDICTIONS).parquet(f"{root}/predictions").select(*PREDICTIONS.names)
