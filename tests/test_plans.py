import re

import pytest

import __spark_entry__ as contract
from tests.conftest import SF
from tidewatch.operators import drift, evaluate
from tidewatch.plans import base, evaluation_queries, operations_queries
from pyspark.sql import functions as F


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_contract_names():
    queries, oracles = contract.queries(), contract.oracle_sql()
    assert set(oracles) <= set(queries) and len(oracles) > 90


def test_entry(spark):
    assert contract.entry(spark).count() > 0


PLAIN = [
    "fill_gaps", "label_from_table", "split_off_grid", "rolling_features", "online_features", "threshold_linear",
    "rank_metrics", "window_metrics_legacy", "exact_quantiles", "derive_alerts", "replay_alerts_by_sensor",
    "inject_faults", "replay_start", "append_experiments", "vibration_snapshot_features", "sequence_windows",
]


@pytest.mark.parametrize("name", PLAIN)
def test_no_window_over_a_single_partition_and_no_cross_join(spark, name):
    """The one thing that may meet in a single task is the table of bucket totals."""
    plan = plan_of(contract.queries()[name](spark, SF))
    single = re.findall(r"Window \[[^\n]*\n[^\n]*Sort [^\n]*\n[^\n]*Exchange SinglePartition[^\n]*\n([^\n]*)", plan)
    assert all(re.search(r"HashAggregate\(keys=\[(bucket|_part)#\d+\]", child) for child in single), single
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_live_window_limits_before_the_shuffle(spark):
    df = base.grid(spark, SF)
    assert plan_of(drift.live_window(df, ["sensor_id"], [F.col("pos")])).count("WindowGroupLimit") == 2


def test_time_filter_reaches_the_scan(spark):
    from tidewatch.operators import alerts

    rows = operations_queries.readings_table(spark, SF)
    plan = plan_of(alerts.stream_rate(rows, "2024-01-20 00:00:00"))
    assert "GreaterThanOrEqual(ts" in plan and "ReadSchema: struct<ts:timestamp>" in plan


def test_split_is_a_partition_filter(spark):
    plan = plan_of(evaluate.confusion(evaluation_queries.validation(spark, SF).withColumn("pred", F.lit(1))))
    assert "PartitionFilters: [isnotnull(split" in plan


def test_bucket_aggregate_combines_before_the_shuffle(spark):
    plan = plan_of(base.slots(spark, SF))
    assert plan.count("partial_max_by") >= 1
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_all_detectors_are_ranked_on_the_same_rows(spark):
    from tidewatch.plans.store import stored

    ranked = contract.queries()["evaluation_all_detectors"](spark, SF).collect()
    names = {
        "Rolling Z-score (Baseline)", "Isolation Forest", "Half-space Trees (Online)", "Elliptic Envelope",
        "One-class SVM", "Local Outlier Factor", "Sequence Reconstruction",
    }
    assert len(ranked) == 7 and {r["model"] for r in ranked} == names
    scores = stored(spark, SF, "detector_scores", None)
    counts = scores.groupBy("model").agg(F.count("score"), F.countDistinct("sensor_id", "pos")).collect()
    assert len({tuple(r)[1:] for r in counts}) == 1 and counts[0][1] == counts[0][2] > 0


def test_prequential_query_reads_every_feature(spark, monkeypatch):
    from tidewatch.operators import features
    from tidewatch.plans import detector_queries

    seen = []
    monkeypatch.setattr(detector_queries.halfspace, "prequential", lambda rows, names, keys: seen.append(names) or rows)
    detector_queries.QUERIES["half_space_trees_prequential"](spark, SF)
    assert seen == [features.FEATURES]
