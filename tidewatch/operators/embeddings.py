"""Image embeddings: fit on good images, midpoint threshold, verdicts, gallery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewatch.operators.detectors import isolation
from tidewatch.operators.thresholds import midpoint

GALLERY_SIZE = 5


def fit_good(good: DataFrame, vector: str, keys: list[str], seed: int = 42) -> isolation.ForestModel:
    return isolation.fit(good, vector, keys, trees=100, seed=seed, contamination=0.01)


def with_decision(df: DataFrame, model: isolation.ForestModel) -> DataFrame:
    """Adds `raw`, the decision value: lower is more anomalous."""
    return model.transform(df, "_score").withColumn("raw", model.decision("_score")).drop("_score")


def midpoint_threshold(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Class means of `raw` and the threshold halfway between them."""
    return midpoint(scored.withColumn("score", F.col("raw")), keys)


def verdict(df: DataFrame, threshold: Column) -> DataFrame:
    """Defect when raw < threshold; the shown score is -raw."""
    bad = F.col("raw") < threshold
    return df.withColumns(
        {
            "is_anomaly": bad,
            "anomaly_score": -F.col("raw"),
            "message": F.when(bad, "Defect detected").otherwise("Normal"),
        }
    )


def mime_type(path: Column) -> Column:
    return F.when(F.lower(path).rlike(r"\.(jpg|jpeg)$"), "image/jpeg").otherwise("image/png")


def data_uri(path: Column, content: Column) -> Column:
    return F.concat(F.lit("data:"), mime_type(path), F.lit(";base64,"), F.regexp_replace(F.base64(content), r"\s", ""))


def decode_data_uri(text: Column) -> Column:
    """Bytes after the first comma; the header may be missing."""
    body = F.when(F.instr(text, ",") > 0, F.regexp_replace(text, "^[^,]*,", "")).otherwise(text)
    return F.unbase64(body)


def gallery(images: DataFrame, seed: int = 42, size: int = GALLERY_SIZE) -> DataFrame:
    """`size` images per class in a random but repeatable order. images: (path, label, content).

    Names are ranked first, without reading any bytes; the row_number limit acts in
    each task before the shuffle. The picked names (size per class) are then
    broadcast to fetch their content.
    """
    order = W.partitionBy("label").orderBy(F.md5(F.concat("path", F.lit(str(seed)))), "path")
    picked = (
        images.select("path", "label").withColumn("place", F.row_number().over(order)).where(F.col("place") <= size)
    )
    rows = images.select("path", "content").join(F.broadcast(picked), "path")
    name = F.element_at(F.split("path", "/"), -1)
    return rows.select("label", "place", name.alias("filename"), data_uri(F.col("path"), F.col("content")).alias("data"))
