"""Hyper-parameter choice on a validation split: a loop over a few settings only."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.detectors.base import Model
from tidewatch.operators.thresholds import best_linear
from tidewatch.session import materialize


def tune(
    fit: Callable[[float], Model], values: Iterable[float], validation: DataFrame, points: int = 100
) -> tuple[Model, float, float]:
    """(model, parameter, threshold) with the best validation F1; the first wins on ties.

    `validation` has a label; every candidate contributes its scores to one long
    table, which is written once and swept in one pass.
    """
    values = list(values)
    models = [fit(v) for v in values]
    long = reduce(
        DataFrame.unionByName,
        [m.transform(validation).select(F.lit(i).alias("setting"), "label", "score") for i, m in enumerate(models)],
    )
    rows = best_linear(materialize(long, "tuning-scores"), ["setting"], points).collect()  # one row per setting
    top = max(rows, key=lambda r: (r["f1"], -r["setting"]))
    return models[top["setting"]], values[top["setting"]], top["threshold"]
