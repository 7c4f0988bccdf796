"""Fitted models as versioned tables.

A version is a folder with one table of fields, a row for each number array, number or
text of the model, and one table for each DataFrame it refers to. The fields' table
is written last, so a version without it was not finished and is never loaded.
"""

from __future__ import annotations

import dataclasses
import json

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from tidewatch.operators.detectors import autoencoder, envelope, halfspace, isolation, neighbours, oneclass, probing, sequence
from tidewatch.operators.detectors.base import Model
from tidewatch.sources.files import version_path

KINDS = {
    kind.__name__: kind
    for kind in (
        isolation.ForestModel, halfspace.HalfSpaceModel, halfspace.Trees, envelope.EnvelopeModel,
        oneclass.OneClassModel, neighbours.LofModel, probing.Index, sequence.SequenceModel,
        autoencoder.AutoencoderModel,
    )
}
FIELDS = "field string, kind string, shape array<int>, numbers array<double>, text string"


def _rows(value, field: str, tables: dict[str, DataFrame]) -> list[tuple]:
    if isinstance(value, DataFrame):
        tables[field] = value
        return [(field, "table", None, None, None)]
    if isinstance(value, np.ndarray):
        return [(field, f"array:{value.dtype}", list(value.shape), value.ravel().astype(float).tolist(), None)]
    if isinstance(value, tuple):
        parts = [row for i, part in enumerate(value) for row in _rows(part, f"{field}.{i}", tables)]
        return [(field, "tuple", [len(value)], None, None), *parts]
    if dataclasses.is_dataclass(value):
        parts = [
            row
            for own in dataclasses.fields(value)
            for row in _rows(getattr(value, own.name), f"{field}.{own.name}", tables)
        ]
        return [(field, f"model:{type(value).__name__}", None, None, None), *parts]
    plain = value.item() if isinstance(value, np.generic) else value
    return [(field, "json", None, None, json.dumps(plain))]


def save(model: Model, spark: SparkSession, root: str) -> str:
    """Write a new version under `root` and return its path. Earlier versions stay."""
    tables: dict[str, DataFrame] = {}
    rows = _rows(model, "model", tables)
    path = version_path(root)
    for field, table in tables.items():
        table.write.parquet(f"{path}/{field}")
    # Arrays are whole rows: a model is bounded by its parameters.
    spark.createDataFrame(rows, FIELDS).coalesce(1).write.parquet(f"{path}/fields")
    return path


def load(spark: SparkSession, path: str) -> Model:
    """The model of a version's path; an error if there is no finished version."""
    try:
        rows = {r["field"]: r for r in spark.read.parquet(f"{path}/fields").collect()}
    except AnalysisException as missing:
        raise FileNotFoundError(f"no finished model at {path}") from missing

    def build(field: str):
        row = rows[field]
        kind, _, name = row["kind"].partition(":")
        if kind == "table":
            return spark.read.parquet(f"{path}/{field}")
        if kind == "array":
            return np.array(row["numbers"], float).astype(name).reshape(row["shape"])
        if kind == "tuple":
            return tuple(build(f"{field}.{i}") for i in range(row["shape"][0]))
        if kind == "model":
            own = dataclasses.fields(KINDS[name])
            return KINDS[name](**{f.name: build(f"{field}.{f.name}") for f in own})
        return json.loads(row["text"])

    return build("model")
