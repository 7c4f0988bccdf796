"""Connected components of a table of links, by label spreading with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidewatch.llm.common import checkpointed


def connected(links: DataFrame) -> DataFrame:
    """(node, label) of every node in `links` (a, b); label is the component's smallest node.

    Each round a node takes the smallest label among its neighbours and then its label's
    label, so a chain of n links needs about log n rounds. Rounds are cut by reliable
    checkpoints; only a count of changed labels reaches the driver. Joins read stored
    rows on both sides, so that a hub's rows can be split at run time."""
    back = links.select(F.col("b").alias("src"), F.col("a").alias("dst"))
    edges = checkpointed(links.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(back))
    labels = checkpointed(
        edges.groupBy("src").agg(F.min("dst").alias("least")).select(
            F.col("src").alias("node"), F.least("src", "least").alias("label")
        )
    )
    while True:
        seen = edges.join(labels, edges["dst"] == labels["node"]).groupBy("src").agg(F.min("label").alias("got"))
        spread = labels.join(seen, labels["node"] == seen["src"]).select(
            "node", F.col("label").alias("old"), F.least("label", "got").alias("label")
        )
        spread = checkpointed(spread)
        up = spread.select(F.col("node").alias("via"), F.col("label").alias("further"))
        jumped = spread.join(up, spread["label"] == up["via"]).select(
            "node", "old", F.least("label", "further").alias("label")
        )
        jumped = checkpointed(jumped)
        labels = jumped.select("node", "label")
        if jumped.where("label < old").isEmpty():
            return labels
