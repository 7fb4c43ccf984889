"""Connected components of links by alternating large-star and small-star rounds, each written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Tables


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) for every node of `links` (a long, b long)."""
    rounds = Tables(links.sparkSession, "components")
    edges = rounds.write(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        old, rounds = rounds, Tables(links.sparkSession, "components")
        edges = rounds.write(small.where("v != m").select(F.col("v").alias("x"), "m").union(least.select(F.col("u").alias("x"), "m")).where("x != m").select(F.greatest("x", "m").alias("u"), F.least("x", "m").alias("v")).distinct(), "edges")
        old.drop()
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    stars = edges.groupBy("u").agg(F.min("v").alias("component"))
    return stars.select(F.col("u").alias("node"), "component").union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct().join(stars.select(F.col("u").alias("node")), "node", "left_anti"))
