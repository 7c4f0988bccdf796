"""Sequence windows and their reconstruction by a linear autoencoder (PCA)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewatch.operators.clean import CHUNK, floor_div
from tidewatch.operators.detectors.base import as_vector, matrix

LENGTH = 15


def sequences(
    df: DataFrame, features: list[str], keys: list[str], pos: str = "pos", length: int = LENGTH, pad: str = "repeat"
) -> DataFrame:
    """Adds `sequence`: the last `length` rows as one ARRAY, oldest first, features inside.

    pad="repeat" puts copies of the first row in front; pad="zeros" puts zeros.
    Rows are chunked by position with a halo of length - 1 rows; `pos` may start
    anywhere but must not have holes, and `start_pos` is where it starts.
    """
    start = df.groupBy(*keys).agg(F.min(pos).alias("_start"))
    placed = df.join(start, keys).withColumn("_home", floor_div(F.col(pos) - F.col("_start"), CHUNK))
    at = (F.col(pos) - F.col("_start")) % CHUNK
    copies = F.when(at >= CHUNK - (length - 1), F.array(F.col("_home"), F.col("_home") + 1)).otherwise(
        F.array(F.col("_home"))
    )
    haloed = placed.withColumn("_chunk", F.explode(copies)).withColumn("_x", as_vector(features))
    frame = W.partitionBy(*keys, "_chunk").orderBy(pos).rowsBetween(-(length - 1), 0)
    seen = haloed.withColumn("_seen", F.collect_list("_x").over(frame)).where(F.col("_chunk") == F.col("_home"))
    lead = F.element_at("_seen", 1) if pad == "repeat" else F.transform(F.element_at("_seen", 1), lambda v: v * 0.0)
    padded = F.concat(F.array_repeat(lead, F.lit(length) - F.size("_seen")), F.col("_seen"))
    return seen.withColumn("sequence", F.flatten(padded)).drop("_start", "_home", "_chunk", "_x", "_seen")


def reconstruction_error(sequence: Column, mean: np.ndarray, basis: np.ndarray, width: int) -> Column:
    """Mean squared error of the last step after projection on `basis`."""
    to_last = basis @ basis[-width:].T

    @F.pandas_udf("double")
    def error(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series(np.zeros(0))
        centred = matrix(vectors) - mean
        return pd.Series(((centred[:, -width:] - centred @ to_last) ** 2).mean(1))

    return error(sequence)


@dataclass
class SequenceModel:
    mean: np.ndarray
    basis: np.ndarray
    width: int

    def transform(self, df: DataFrame, name: str = "score") -> DataFrame:
        return df.withColumn(name, reconstruction_error(F.col("sequence"), self.mean, self.basis, self.width))


def fit(df: DataFrame, width: int, hidden: int = 16) -> SequenceModel:
    """Principal components of the training sequences (distributed in MLlib).

    width = features per step; hidden = size of the code.
    """
    vectors = df.select(array_to_vector("sequence").alias("v"))
    model = PCA(k=hidden, inputCol="v", outputCol="code").fit(vectors)
    mean = vectors.select(Summarizer.mean(F.col("v")).alias("m")).first()["m"].toArray()
    return SequenceModel(mean, model.pc.toArray(), width)
