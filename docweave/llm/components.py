"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from docweave.runtime import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of (a, b) links; the component is its smallest node.

    Labels start at the smallest neighbour; each round takes the smallest label around and then the label of
    that label, so distances halve. Minima combine before the shuffle, so a hub costs no more than its links;
    every round is a written table.
    """
    both = materialize(links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a")).where("u <> v").distinct())
    labels = materialize(both.groupBy("u").agg(F.min("v").alias("least")).select(F.col("u").alias("node"), F.least("u", "least").alias("component")))
    while True:
        around = (both.join(labels.withColumnsRenamed({"node": "v", "component": "reached"}), "v").groupBy(F.col("u").alias("node"))
                  .agg(F.min("reached").alias("reached")))
        lower = labels.join(around, "node").select("node", F.col("component").alias("before"), F.least("component", "reached").alias("component"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("further"))
        rows = materialize(lower.join(jump, "component", "left").select("node", "before", F.least("component", F.coalesce("further", "component")).alias("component")))
        labels = rows.select("node", "component")
        if rows.where("before <> component").limit(1).count() == 0:
            return labels
