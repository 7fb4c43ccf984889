"""Arguments of themes: groups of claims by stance, the claims that stand for each group, their support, and their merger under a parent theme.

Cosines are compared at six digits. Vectors are taken at length 1; a zero vector is near to nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .vector import dot, matrix, normalised, unit

#: Claims of the smallest group, and of the smallest support.
LEAST = 3
#: Arguments of a group, of a parent, and sources kept of a merged argument.
MOST, PARENT_MOST, SOURCES = 5, 7, 5

Checkpoint = Callable[[DataFrame], DataFrame]


def groups(claims: DataFrame, divided: DataFrame, least: int = LEAST) -> DataFrame:
    """`claims` (leaf, stance, ...) with `side`: for and against in the leaves of `divided` (leaf), where other stances are left out; `neutral`
    for all claims of the other leaves. Groups of fewer than `least` claims are left out."""
    marked = claims.join(divided.select("leaf", F.lit(True).alias("_divided")).distinct(), "leaf", "left")
    side = F.when(F.col("_divided").isNull(), "neutral").when(F.col("stance").isin("for", "against"), F.col("stance"))
    marked = marked.withColumn("side", side).where("side is not null").drop("_divided")
    big = marked.groupBy("leaf", "side").agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select("leaf", "side")
    return marked.join(big, ["leaf", "side"], "left_semi")


def cover(claims: DataFrame, keys: list[str], similar: float, most: int, checkpoint: Checkpoint) -> DataFrame:
    """keys, pick, id: the claims (keys, id, vector) that stand for each group: the most central one not covered yet is picked and covers those at `similar` or
    above, until `most` are picked or all are covered. Ties go to the smaller id.

    All groups go through one pick at a time, as a grouped maximum and a join, so no group is held by one task; covered claims leave the table."""
    rows = claims.select(*keys, "id", normalised(F.col("vector")).alias("v"))
    parts = rows.select(*keys, F.posexplode("v").alias("pos", "x")).groupBy(*keys, "pos").agg(F.sum("x").alias("s"))
    centres = parts.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda x: x["s"]).alias("c"))
    open_ = checkpoint(rows.join(centres, keys).select(*keys, "id", "v", F.round(dot(F.col("v"), normalised(F.col("c"))), 6).alias("central")))
    picked: DataFrame | None = None
    for pick in range(most):
        seeds = checkpoint(open_.groupBy(*keys).agg(F.max_by(F.struct("id", "v"), F.struct("central", -F.col("id"))).alias("s")).select(*keys, F.lit(pick).alias("pick"), F.col("s.id").alias("id"), F.col("s.v").alias("seed")))
        if seeds.isEmpty():
            break
        chosen = seeds.select(*keys, "pick", "id")
        picked = chosen if picked is None else picked.unionByName(chosen)
        if pick < most - 1:
            left = open_.join(seeds.select(*keys, F.col("id").alias("seed_id"), "seed"), keys)
            open_ = checkpoint(left.where((F.round(dot(F.col("v"), F.col("seed")), 6) < similar) & (F.col("id") != F.col("seed_id"))).select(*keys, "id", "v", "central"))
    return claims.select(*keys, F.lit(0).alias("pick"), "id").limit(0) if picked is None else picked


def support(claims: DataFrame, picks: DataFrame, keys: list[str], similar: float, least: int = LEAST, sources: int = SOURCES) -> DataFrame:
    """keys, pick, id, vector, n_support, weight, sources of the picks (keys, pick, id): each claim (keys, id, vector, weight) of the group supports the pick it is nearest
    to, the first of equals, if at `similar` or above. Picks with fewer than `least` are left out; sources are the nearest supporters."""
    rows = claims.select(*keys, "id", "weight", normalised(F.col("vector")).alias("v"))
    chosen = picks.join(rows.select(*keys, "id", "v"), [*keys, "id"])
    few = chosen.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pick", "id", "v"))).alias("picks"))  # `most` picks at most
    sims = F.transform("picks", lambda p: F.struct(F.round(dot(F.col("v"), p["v"]), 6).alias("s"), (-p["pick"]).alias("at")))
    best = rows.join(few, keys).select(*keys, "id", "weight", F.array_max(sims).alias("b")).where(F.col("b.s") >= similar).select(*keys, (-F.col("b.at")).alias("pick"), "id", "weight", F.col("b.s").alias("s"))
    rank = F.row_number().over(W.partitionBy(*keys, "pick").orderBy(F.desc("s"), "id"))
    near = best.withColumn("rank", rank).where(F.col("rank") <= sources).groupBy(*keys, "pick").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id", "s"))), lambda x: F.struct(x["id"].alias("id"), x["s"].alias("similarity"))).alias("sources"))
    sums = best.groupBy(*keys, "pick").agg(F.count("*").alias("n_support"), F.round(F.sum("weight"), 3).alias("weight")).where(F.col("n_support") >= least)
    return sums.join(near, [*keys, "pick"]).join(chosen.withColumnRenamed("v", "vector"), [*keys, "pick"]).select(*keys, "pick", "id", "vector", "n_support", "weight", "sources")


def homes(entries: DataFrame, keys: list[str], similar: float) -> DataFrame:
    """keys, id, home of `entries` (keys, id, vector, n_support): by falling support (ties to the smaller id) each entry joins the first home at `similar` or
    above, or becomes a home. A group streams through one task in that order, which holds the homes alone; these are unlike each other."""
    rows = entries.select(*keys, "id", "n_support", F.col("vector").cast("array<double>").alias("vector"))
    ordered = rows.repartition(*keys).sortWithinPartitions(*keys, F.desc("n_support"), "id")
    schema = T.StructType([*(rows.schema[k] for k in keys), rows.schema["id"], T.StructField("home", rows.schema["id"].dataType)])
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, names = None, []
        held = np.zeros((0, 0))
        for batch in batches:
            of = list(zip(*(batch.column(k).to_pylist() for k in range(n))))
            ids, vectors, home = batch.column(n).to_pylist(), unit(matrix(batch.column(n + 2))), []
            for k, v in enumerate(vectors):
                if of[k] != group:
                    group, names, held = of[k], [], np.zeros((16, len(v)))
                near = np.flatnonzero(np.round(held[: len(names)] @ v, 6) >= similar)
                if len(near):
                    home.append(names[near[0]])
                    continue
                if len(names) == len(held):
                    held = np.vstack([held, np.zeros_like(held)])
                held[len(names)] = v
                names.append(ids[k])
                home.append(ids[k])
            if home:
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(n + 1)), pa.array(home, batch.schema.field(n).type)], names=[*keys, "id", "home"])

    return ordered.mapInArrow(run, schema)


def merged(entries: DataFrame, keys: list[str], similar: float, most: int = PARENT_MOST, sources: int = SOURCES) -> DataFrame:
    """keys, rank, id, n_support, weight, merged_from, sources: the arguments `entries` (keys, leaf, id, vector, n_support, weight, sources) of a parent's leaves, near ones
    absorbed by the better supported, their support and weight summed, and the `most` best supported of each group kept (ties to the earlier home)."""
    to = homes(entries, keys, similar).join(entries.select(*keys, "id", "leaf", "n_support", "weight", "sources"), [*keys, "id"])
    own = F.max(F.when(F.col("id") == F.col("home"), F.col("n_support")))
    sums = to.groupBy(*keys, "home").agg(
        F.sum("n_support").alias("n"), F.round(F.sum("weight"), 3).alias("weight"), F.array_sort(F.collect_set("leaf")).alias("merged_from"), own.alias("own"),
    )
    flat = to.select(*keys, "home", F.explode("sources").alias("s")).select(*keys, "home", "s.*")
    place = F.row_number().over(W.partitionBy(*keys, "home").orderBy(F.desc("similarity"), "id"))
    best = flat.withColumn("p", place).where(F.col("p") <= sources).groupBy(*keys, "home").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "id", "similarity"))), lambda x: F.struct(x["id"].alias("id"), x["similarity"].alias("similarity"))).alias("sources"))
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("n"), F.desc("own"), "home"))
    kept = sums.withColumn("rank", rank).where(F.col("rank") <= most)
    return kept.join(best, [*keys, "home"], "left").select(*keys, "rank", F.col("home").alias("id"), F.col("n").alias("n_support"), "weight", "merged_from", "sources")
