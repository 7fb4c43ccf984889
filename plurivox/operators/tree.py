"""Trees as adjacency lists: descendants, ancestors, roots, order and violations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import checkpointed
from .ordering import numbered


def _closure(nodes: DataFrame, node: str, parent: str) -> tuple[DataFrame, DataFrame]:
    """node, ancestor, distance of all nodes, and the nodes (node, far) whose way up never ends. Distances double in each
    round, so a tree of any depth takes as many rounds as its depth has binary digits."""
    rows = checkpointed(nodes.select(F.col(node).alias("node"), F.col(parent).alias("parent")).distinct())
    up = rows.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("distance")).distinct()
    # an ancestor without a row of its own ends the way
    jump = checkpointed(rows.where("parent is not null").select("node", F.col("parent").alias("far")))
    reach, count = 1, rows.select("node").distinct().count()
    while reach <= count and not jump.isEmpty():
        beyond = jump.join(up.select(F.col("node").alias("far"), "ancestor", "distance"), "far", "left")
        more = beyond.select("node", F.coalesce("ancestor", "far").alias("ancestor"), (F.coalesce("distance", F.lit(0)) + reach).alias("distance"))
        up = checkpointed(up.union(more).distinct())
        jump = checkpointed(jump.join(jump.select(F.col("node").alias("far"), F.col("far").alias("farther")), "far").select("node", F.col("farther").alias("far")).distinct())
        reach *= 2
    return up, jump


def ancestors(nodes: DataFrame, node: str, parent: str) -> DataFrame:
    """node, ancestor, distance (the shortest): every node with itself and all above it, however deep; a cycle ends where it closes."""
    return _closure(nodes, node, parent)[0].groupBy("node", "ancestor").agg(F.min("distance").alias("distance"))


def descendants(nodes: DataFrame, node: str, parent: str, root) -> DataFrame:
    """node: `root` and all below it."""
    return ancestors(nodes, node, parent).where(F.col("ancestor") == root).select("node")


def roots(nodes: DataFrame, node: str, parent: str) -> DataFrame:
    """node, root: the top of each node's tree (an ancestor without a row of its own ends the way), null for nodes on a cycle or under one.

    Every node points to its parent, then to where that one points, and so on: one row a node, and as many rounds as the depth has binary digits.
    Of several parents of a repeated node the smallest counts."""
    first = nodes.groupBy(F.col(node).alias("node")).agg(F.min(F.col(parent)).alias("at"))
    rows = checkpointed(first.select("node", F.coalesce("at", "node").alias("at"), F.col("at").isNull().alias("top")))
    reach, count = 1, rows.count()
    while reach <= count and not rows.where(~F.col("top")).isEmpty():
        there = rows.select(F.col("node").alias("at"), F.col("at").alias("next"), F.col("top").alias("ends"))
        rows = checkpointed(rows.join(there, "at", "left").select("node", F.when(F.col("top") | F.col("next").isNull(), F.col("at")).otherwise(F.col("next")).alias("at"), (F.col("top") | F.coalesce("ends", F.lit(True))).alias("top")))
        reach *= 2
    return rows.select("node", F.when(F.col("top"), F.col("at")).alias("root"))


def preorder(nodes: DataFrame, node: str, parent: str, weight: str) -> DataFrame:
    """node, id, depth: ids n0, n1, ... in the order of a walk that takes siblings (and roots) by falling weight, ties by node, each before its children.

    A node's way down from its root, as ranks among siblings, sorts as the walk does; ways are numbered over range partitions."""
    rank = F.row_number().over(W.partitionBy(parent).orderBy(F.desc(weight), node))
    ranks = nodes.select(F.col(node).alias("ancestor"), rank.alias("rank"))
    steps = ancestors(nodes, node, parent).join(ranks, "ancestor").groupBy("node").agg(F.array_sort(F.collect_list(F.struct((-F.col("distance")).alias("o"), "rank"))).alias("ss"))
    ways = steps.select("node", F.transform("ss", lambda s: s["rank"]).alias("way"))
    return numbered(ways, ["way", "node"], "place", checkpointed).select("node", F.concat(F.lit("n"), F.col("place").cast("string")).alias("id"), (F.size("way") - 1).alias("depth"))


def distinct_below(nodes: DataFrame, members: DataFrame, node: str, parent: str, member: str, owner: str) -> DataFrame:
    """node, n: different owners of the members (member, owner) of each node and all below it; nodes without any have 0."""
    up = ancestors(nodes, node, parent).withColumnRenamed("node", "_at")
    pairs = members.select(F.col(member).alias("_at"), F.col(owner).alias("_owner")).distinct().join(up, "_at").select(F.col("ancestor").alias("node"), "_owner").distinct()
    counts = pairs.groupBy("node").agg(F.count("*").alias("n"))
    return nodes.select(F.col(node).alias("node")).distinct().join(counts, "node", "left").select("node", F.coalesce("n", F.lit(0)).alias("n"))


def violations(nodes: DataFrame, members: DataFrame, node: str, parent: str, member: str) -> DataFrame:
    """problem, node: parents that do not exist, members whose node does not, repeated nodes, and nodes that lie on a cycle or under one."""
    ids = nodes.select(F.col(node).alias("node"))
    orphans = nodes.where(F.col(parent).isNotNull()).select(F.col(parent).alias("node")).join(ids, "node", "left_anti").select(F.lit("missing parent").alias("problem"), "node")
    lost = members.select(F.col(member).alias("node")).join(ids, "node", "left_anti").select(F.lit("lost member").alias("problem"), "node")
    twice = ids.groupBy("node").agg(F.count("*").alias("c")).where("c > 1").select(F.lit("repeated node").alias("problem"), "node")
    endless = _closure(nodes, node, parent)[1].select(F.lit("cycle").alias("problem"), "node").distinct()
    return orphans.unionByName(lost).unionByName(twice).unionByName(endless)
