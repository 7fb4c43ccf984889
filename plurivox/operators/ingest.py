"""Dedup, caps, samples, filters and roll-ups of ingestion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import lang, text


def keep_where(df: DataFrame, allowed: dict[str, list[str]]) -> DataFrame:
    """Rows whose columns all hold an allowed value; null counts as blank."""
    return reduce(lambda x, item: x.where(F.coalesce(F.col(item[0]).cast("string"), F.lit("")).isin(*item[1])), allowed.items(), df)


def exact_dedup(df: DataFrame, text: str, order: str, weight: Column) -> DataFrame:
    """One row for each text: its first row's `order` and weight, and one more weight for each further row."""
    rows = df.select(F.col(text).alias("text"), F.col(order).alias("ord"), weight.cast("double").alias("w"))
    return rows.groupBy("text").agg(F.min("ord").alias(order), (F.min_by("w", "ord") + F.count("*") - 1).alias("weight"))


def cap(df: DataFrame, group: str, order: list[str], rows: int) -> DataFrame:
    """The first `rows` rows of each group by `order`; Spark limits each partition before the shuffle."""
    rank = F.row_number().over(W.partitionBy(group).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= rows).drop("_rank")


def balanced(df: DataFrame, groups: list[str], order: Column, total: int) -> DataFrame:
    """Round robin over the groups, each in `order`, until `total` rows: no group is ahead of another by more than one."""
    turn = F.row_number().over(W.partitionBy(*groups).orderBy(order))
    return df.withColumn("turn", turn).where(F.col("turn") <= total).orderBy("turn", *groups).limit(total)


def latest(df: DataFrame, keys: list[str], updated: str, tie: str) -> DataFrame:
    """The latest row of each key, with the first `updated` of the key as created."""
    return df.groupBy(*keys).agg(F.min(updated).alias("created"), F.max_by(F.struct("*"), F.struct(updated, tie)).alias("row"))


#: Properties of an idea that a source's own never replace.
CANONICAL = ("text", "text_clean", "ts", "lang", "author_hash", "source", "weight")


def ideas(raw: DataFrame, salt: str, label_size: int = 80, min_chars: int = 0) -> DataFrame:
    """id, label, text, text_clean, ts, lang, author_hash, source, weight, props of raw contributions (source, raw_id, text, lang, author, ts, weight string,
    props map<string, string>); those that are empty or next to it once cleaned, or shorter than `min_chars`, are left out.

    The kept text is the original with personal data masked. A blank language is guessed from the clean text; a weight that is missing
    or no number is 1; a null author counts as blank; own properties never replace the canonical ones."""
    rows = raw.withColumn("text_clean", text.clean_text(F.col("text")))
    rows = rows.where(~text.empty_like(F.col("text_clean")) & (F.length("text_clean") >= min_chars))
    told = F.nullif(F.trim(F.coalesce("lang", F.lit(""))), F.lit(""))
    return rows.select(
        F.concat_ws(":", "source", F.col("raw_id").cast("string")).alias("id"), text.label(F.col("text_clean"), label_size).alias("label"), text.mask_pii(F.trim("text")).alias("text"), "text_clean",
        F.trim(F.coalesce("ts", F.lit(""))).alias("ts"), F.coalesce(told, lang.guess(F.col("text_clean"))).alias("lang"),
        text.author_hash(F.col("source"), F.coalesce("author", F.lit("")), salt).alias("author_hash"), "source", F.coalesce(F.col("weight").try_cast("double"), F.lit(1.0)).alias("weight"),
        F.map_filter(F.coalesce("props", F.create_map().cast("map<string, string>")), lambda k, v: ~k.isin(*CANONICAL)).alias("props"),
    )


def status_rollup(files: DataFrame, key: str) -> DataFrame:
    """Status of a collection from the statuses of its files."""
    n = lambda s: F.count_if(F.col("status") == s)
    counts = files.groupBy(key).agg(F.count("*").alias("files"), *(n(s).alias(s) for s in ("ok", "error", "empty", "skipped")))
    return counts.withColumn(
        "state",
        F.when(F.col("files") == 0, "no_data_files").when((F.col("ok") > 0) & (F.col("error") == 0), "ok").when(F.col("ok") > 0, "partial")
        .when(F.col("error") > 0, "error").when(F.col("skipped") > 0, "skipped").otherwise("empty"),
    )
