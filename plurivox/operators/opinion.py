"""Opinion splits, roll-ups over a tree, demographics and dataset indices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Fixed thresholds of the opinion profile.
MIN_CLAIMS, MIN_ENGAGEMENT, DIVIDED = 8, 0.35, 0.15


def profile(favour: Column, against: Column, n: Column) -> Column:
    polar = favour + against
    opposition = F.coalesce(F.least(favour, against) / F.nullif(polar, F.lit(0)), F.lit(0.0))
    return F.when((n < MIN_CLAIMS) | (polar / n < MIN_ENGAGEMENT), "unclear").when(opposition >= DIVIDED, "divided").otherwise("consensual")


def split(claims: DataFrame, theme: str, stance: str) -> DataFrame:
    """theme, n, favour, against, nuanced of claims with stances favour / against / anything else."""
    return claims.groupBy(theme).agg(
        F.count("*").alias("n"), F.count_if(F.col(stance) == "favour").alias("favour"), F.count_if(F.col(stance) == "against").alias("against"),
        F.count_if(F.coalesce(F.col(stance), F.lit("")).isin("favour", "against") == F.lit(False)).alias("nuanced"),
    )


def scored(counts: DataFrame) -> DataFrame:
    """Engagement, opposition, share of favour among the engaged, and the profile."""
    polar = F.col("favour") + F.col("against")
    part = lambda x: F.round(F.coalesce(x / F.nullif(polar, F.lit(0)), F.lit(0.0)), 3)
    return counts.select(
        "*", F.round(polar / F.col("n"), 3).alias("engagement"), part(F.least("favour", "against")).alias("opposition"), part(F.col("favour")).alias("pct_favour"),
        profile(F.col("favour"), F.col("against"), F.col("n")).alias("profile"),
    )


def roll_up(leaves: DataFrame, ancestors: DataFrame, key: str, measures: list[str]) -> DataFrame:
    """Sums of the leaves' measures for each ancestor; `ancestors` (key, ancestor) is any tree's bridge."""
    return leaves.join(ancestors, key).groupBy("ancestor").agg(*(F.sum(m).alias(m) for m in measures))


def counts(people: DataFrame, axes: list[str]) -> DataFrame:
    """axis, value, n over non-blank values of each axis."""
    cells = F.array(*(F.struct(F.lit(a).alias("axis"), F.nullif(F.trim(F.col(a).cast("string")), F.lit("")).alias("value")) for a in axes))
    return people.select(F.explode(cells).alias("c")).select("c.*").where("value is not null").groupBy("axis", "value").agg(F.count("*").alias("n"))


def majority(people: DataFrame, group: str, value: str) -> DataFrame:
    """group, majority (ties: the smaller value), n and share among those with a value."""
    per = people.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("n"))
    best = per.groupBy(group).agg(F.max_by(F.struct(value, "n"), F.struct("n")).alias("x"), F.sum("n").alias("total"), F.max("n").alias("top"))
    return per.join(best.select(group, "top", "total"), group).where("n = top").groupBy(group).agg(F.min(value).alias("majority"), F.max("n").alias("n"), F.round(F.max("n") / F.max("total"), 4).alias("share"))


def concentration(weights: DataFrame, weight: str, key: str) -> DataFrame:
    """One row: n, evenness (Pielou), effective number exp(H), top share and Gini of positive weights.

    The rank for Gini comes from counts and sums by distinct weight, so no window holds all rows of the table."""
    by_value = weights.where(F.col(weight) > 0).groupBy(F.col(weight).cast("double").alias("w")).agg(F.count("*").alias("c"))
    sums = by_value.agg(F.sum("c").alias("n"), F.sum(F.col("w") * F.col("c")).alias("total"), F.max("w").alias("top"))
    p = F.col("w") / F.col("total")
    ordered = by_value.crossJoin(F.broadcast(sums)).withColumn("before", F.coalesce(F.sum("c").over(W.orderBy("w").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    ranks = F.col("c") * F.col("before") + F.col("c") * (F.col("c") + 1) / 2
    return ordered.agg(F.max("n").alias("n"), F.max("total").alias("total"), F.max("top").alias("top"), F.sum(-p * F.log(p) * F.col("c")).alias("h"), F.sum(ranks * F.col("w")).alias("r")).select(
        "n", F.round(F.when(F.col("n") > 1, F.col("h") / F.log("n")).otherwise(1.0), 6).alias("evenness"), F.round(F.exp("h"), 4).alias("effective"),
        F.round(F.col("top") / F.col("total"), 6).alias("top_share"), F.round(2 * F.col("r") / (F.col("n") * F.col("total")) - (F.col("n") + 1) / F.col("n"), 6).alias("gini"),
    )
