"""Verbatim spans: half-open offsets in code points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def locate(text: Column, part: Column) -> Column:
    """start, end of the first place of `part` in `text`, null without one."""
    at = F.position(part, text)
    return F.when(at > 0, F.struct((at - 1).cast("int").alias("start"), (at - 1 + F.length(part)).cast("int").alias("end")))


def rebuild(text: Column, spans: Column, joint: str = " ") -> Column:
    return F.array_join(F.transform(spans, lambda s: F.substr(text, s["start"] + 1, s["end"] - s["start"])), joint)


def cover(rows: DataFrame, key: str) -> DataFrame:
    """key, start, end: overlapping or touching spans as one."""
    before = W.partitionBy(key).orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1)
    upto = W.partitionBy(key).orderBy("start", "end").rowsBetween(W.unboundedPreceding, 0)
    new = rows.withColumn("new", (F.col("start") > F.coalesce(F.max("end").over(before), F.lit(-1))).cast("int"))
    return new.withColumn("g", F.sum("new").over(upto)).groupBy(key, "g").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("g")


def uncovered(rows: DataFrame, key: str, size: str, least: int) -> DataFrame:
    """key, start, end: gaps of at least `least` between and around the spans of texts of length `size`."""
    covered = cover(rows.select(key, "start", "end"), key)
    sizes = rows.select(key, size).distinct()
    marks = covered.unionByName(sizes.select(key, F.lit(-1).alias("start"), F.lit(0).alias("end"))).unionByName(sizes.select(key, F.col(size).alias("start"), F.col(size).alias("end")))
    ends = marks.withColumn("next", F.lead("start").over(W.partitionBy(key).orderBy("start", "end")))
    return ends.where(F.col("next") - F.col("end") >= least).select(key, F.col("end").alias("start"), F.col("next").alias("end"))
