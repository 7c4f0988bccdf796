"""All registered queries with their SQL twins."""

from __future__ import annotations

from tidewatch.plans import detector_queries, evaluation_queries, operations_queries, series_queries, streaming_queries

AREAS = [series_queries, evaluation_queries, operations_queries, detector_queries, streaming_queries]

QUERIES, ORACLES = {}, {}
for _area in AREAS:
    overlap = QUERIES.keys() & _area.QUERIES.keys()
    if overlap:
        raise ValueError(f"registered twice: {sorted(overlap)}")
    QUERIES.update(_area.QUERIES)
    ORACLES.update(_area.ORACLES)


def flagship(spark, sf_dir):
    """Raw events to explained anomalies: clean, label, split, scale, features, rule."""
    table = evaluation_queries.feature_store(spark, sf_dir)
    return evaluation_queries.anomalous_readings(table, evaluation_queries.stats_list(spark, sf_dir))
