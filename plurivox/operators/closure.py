"""Connected components by rounds of smallest-neighbour labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def components(links: DataFrame, checkpoint) -> DataFrame:
    """node, component (its smallest node) of links (a, b); `checkpoint(df)` cuts the lineage after each round."""
    both = checkpoint(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = checkpoint(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")))
    while True:
        around = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("c"))
        step = labels.join(around, "node").select("node", F.least("component", "c").alias("component"))
        jump = step.select(F.col("node").alias("component"), F.col("component").alias("up"))
        now = checkpoint(step.join(jump, "component").select("node", F.least("component", "up").alias("component")))
        changed = now.join(labels.withColumnRenamed("component", "old"), "node").where("component != old").limit(1).count()
        labels = now
        if not changed:
            return labels
