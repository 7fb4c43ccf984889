"""Statistics of groups of unit vectors from their sum alone: no pair is formed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sum_norms(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """key, n, ss: rows, and squared norm of the sum of the vectors. One shuffle of partial sums by (key, position)."""
    parts = vectors.select(key, F.posexplode(vector).alias("pos", "v")).groupBy(key, "pos").agg(F.sum(F.col("v").cast("double")).alias("s"), F.count("*").alias("n"))
    return parts.groupBy(key).agg(F.max("n").alias("n"), F.sum(F.col("s") * F.col("s")).alias("ss"))


def consensus(n: str = "n", ss: str = "ss"):
    """Mean cosine over pairs: (|S|^2 - n) / (n^2 - n); one member agrees with itself."""
    return F.when(F.col(n) > 1, (F.col(ss) - F.col(n)) / (F.col(n) * (F.col(n) - 1.0))).otherwise(1.0)


def theme_cards(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """n, dispersion, consensus, share and convergence n / (n + median n) * consensus of each group."""
    stats = sum_norms(vectors, key, vector)
    whole = stats.agg(F.greatest(F.lit(1.0), F.percentile("n", 0.5)).alias("_median"), F.sum("n").alias("_total"))
    return stats.crossJoin(F.broadcast(whole)).select(
        key,
        "n",
        F.round(1 - F.sqrt("ss") / F.col("n"), 4).alias("dispersion"),
        F.round(consensus(), 4).alias("consensus"),
        F.round(F.col("n") / F.col("_total"), 4).alias("share"),
        F.round(F.col("n") / (F.col("n") + F.col("_median")) * consensus(), 4).alias("convergence"),
    )
