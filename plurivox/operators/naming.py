"""Names of themes: document frequencies, corpus stop words, weighted terms and keyword picks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import let, tokens


def term_documents(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, term: the distinct tokens of each document."""
    return docs.select(key, F.explode(F.array_distinct(tokens(F.col(text)))).alias("term"))


def frequencies(docs: DataFrame, text: str) -> DataFrame:
    """term, df: documents that hold each token."""
    return docs.select(F.explode(F.array_distinct(tokens(F.col(text)))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def idf(df: DataFrame, documents: int) -> DataFrame:
    return df.select("term", "df", F.log(1 + F.lit(documents) / F.col("df")).alias("idf"))


def stop_words(df: DataFrame, sigmas: float = 3.0, gap: float = 1.3) -> DataFrame:
    """term, df of the terms above mean + sigmas * std of df, down to the largest relative gap of at least `gap` among them.

    Above mean + 3 std stand at most a ninth of all terms; the gap is found over their distinct frequencies."""
    bound = df.agg((F.avg("df") + sigmas * F.stddev_pop("df")).alias("bound"))
    high = df.join(F.broadcast(bound), F.col("df") > F.col("bound")).select("term", "df")
    levels = high.select("df").distinct().withColumn("below", F.lead("df").over(W.orderBy(F.desc("df"))))
    cut = levels.where(F.col("df") / F.col("below") >= gap).agg(F.max_by("df", F.struct(F.col("df") / F.col("below"), "df")).alias("cut"))
    return high.join(F.broadcast(cut), (F.col("cut").isNull()) | (F.col("df") >= F.col("cut"))).select("term", "df")


def class_terms(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, term, tf, weight: class TF-IDF of tokens, tf * ln(1 + A / f) with A the mean tokens of a class and f the term's tokens."""
    counts = docs.select(key, F.explode(tokens(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))
    totals = counts.groupBy("term").agg(F.sum("tf").alias("f"))
    mean = counts.groupBy(key).agg(F.sum("tf").alias("n")).agg(F.avg("n").alias("a"))
    return counts.join(totals, "term").crossJoin(F.broadcast(mean)).select(key, "term", "tf", (F.col("tf") * F.log(1 + F.col("a") / F.col("f"))).alias("weight"))


def top_terms(weights: DataFrame, key: str, k: int) -> DataFrame:
    """The k heaviest terms of each class; ties by term, weights compared at six digits."""
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc(F.round("weight", 6)), "term"))
    return weights.withColumn("rank", rank).where(F.col("rank") <= k)


def pick_keywords(terms: DataFrame, key: str, k: int) -> DataFrame:
    """Greedy picks from ranked 1- and 2-grams: a term is left out when a kept one holds it, or it holds a kept one."""
    schema = f"{key} {dict(terms.dtypes)[key]}, pick int, term string"

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list[str] = []
        for term in pdf.sort_values("rank")["term"]:
            words = set(term.split())
            if len(kept) < k and not any(words <= set(x.split()) or words >= set(x.split()) for x in kept):
                kept.append(term)
        return pd.DataFrame({key: pdf[key].iloc[0], "pick": range(1, len(kept) + 1), "term": kept})

    return terms.groupBy(key).applyInPandas(pick, schema)


def _neighbours(ts: Column) -> Column:
    """Each token with its next; null where either is null."""
    return F.zip_with(F.slice(ts, 1, F.greatest(F.size(ts) - 1, F.lit(0))), F.slice(ts, 2, F.size(ts)), lambda a, b: F.concat(a, F.lit(" "), b))


def with_bigrams(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, term of 1- and 2-grams of tokens within a document."""
    return docs.select(key, F.explode(let(tokens(F.col(text)), lambda ts: F.concat(ts, _neighbours(ts)))).alias("term"))


def token_counts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, term, n, docs, f: how often a class has each token, in how many texts, and how often all classes have it; the empty term stands for texts with tokens, once in each.

    Tokens are counted batch by batch, so what meets by term is a row for each token of a batch and class."""
    of = docs.schema[key].dataType.simpleString()

    def count(batches):
        for batch in batches:
            keys, texts = pc.dictionary_encode(batch.column(0), null_encoding="encode"), batch.column(1)
            sizes = pc.fill_null(pc.list_value_length(texts), 0).to_numpy().astype(np.int64)
            terms = texts.flatten().dictionary_encode()
            words, held = len(terms.dictionary) + 1, np.flatnonzero(sizes)
            # the last code is the empty term
            code = np.concatenate([terms.indices.to_numpy(), np.full(len(held), words - 1)])
            pairs, n = np.unique(np.concatenate([np.repeat(np.arange(len(sizes)), sizes), held]) * words + code, return_counts=True)
            classes = keys.indices.to_numpy().astype(np.int64)
            found = pa.table({"c": classes[pairs // words] * words + pairs % words, "n": n}).group_by("c", use_threads=False).aggregate([("n", "sum"), ("n", "count")])
            c = found["c"].to_numpy()
            spelt = pa.concat_arrays([terms.dictionary, pa.array([""], terms.dictionary.type)])
            yield pa.RecordBatch.from_arrays([keys.dictionary.take(pa.array(c // words)), spelt.take(pa.array(c % words)), *(found[x].combine_chunks() for x in ("n_sum", "n_count"))], ["key", "term", "n", "docs"])

    rows = docs.select(key, tokens(F.col(text)).alias("ts")).mapInArrow(count, f"key {of}, term string, n long, docs long").withColumnRenamed("key", key)
    counts = rows.repartition("term").groupBy(key, "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    return counts.withColumn("f", F.sum("n").over(W.partitionBy("term")))


#: Bits of `among`, as many for any table.
SLOTS = 1 << 20


def among(terms: DataFrame) -> Callable[[Column], Column]:
    """Whether a string is one of `terms` (term); also true of the few others that share a bit with one."""
    place = lambda t: F.pmod(F.xxhash64(t), F.lit(SLOTS))
    slots = terms.select(place(F.col("term")).alias("slot")).groupBy(F.expr("CAST(slot DIV 64 AS INT)").alias("at")).agg(F.expr("bit_or(shiftleft(1L, CAST(slot % 64 AS INT)))").alias("bits"))
    held = {r["at"]: r["bits"] for r in slots.collect()}
    bits = F.split(F.lit(",".join(str(held.get(at, 0)) for at in range(SLOTS // 64))), ",").cast("array<bigint>")
    return lambda t: F.getbit(F.get(bits, F.shiftright(place(t), 6).cast("int")), (place(t) % 64).cast("int")) == 1


def heavy_grams(docs: DataFrame, counts: DataFrame, key: str, text: str, k: int, checkpoint: Callable[[DataFrame], DataFrame], stop: DataFrame | None = None) -> DataFrame:
    """key, term, tf, weight of 1- and 2-grams within documents, with `counts` those of `token_counts`: tf the term's share of its class's grams, weight (of nine digits)
    tf * ln(1 + A / f) with A the mean grams of a class and f the term's own. Of each class come its grams, without those that hold a word of `stop` (term), down to the
    weight of its k-th heaviest token, or all where it has fewer tokens.

    A term that a class has n times weighs n / size * ln(1 + A / n) at most, as f is n or more; that grows with n, and no 2-gram is more frequent than its words.
    So only 2-grams of words that could weigh enough are counted."""
    words = counts.where(F.col("term") != "").select(key, "term", "n", "f")
    sizes = checkpoint(counts.groupBy(key).agg(F.sum(F.when(F.col("term") == "", -F.col("n")).otherwise(2 * F.col("n"))).alias("size")))
    mean = sizes.agg(F.avg("size").alias("a"))
    tf = F.col("n") / F.col("size")

    def weighed(rows: DataFrame, f: str) -> DataFrame:
        return rows.join(sizes, key).crossJoin(F.broadcast(mean)).select(key, "term", "n", "f", tf.alias("tf"), (tf * F.log(1 + F.col("a") / F.col(f))).alias("weight"))

    place = F.row_number().over(W.partitionBy(key).orderBy(F.desc("weight")))
    named = words if stop is None else words.join(stop, "term", "left_anti")
    floors = checkpoint(weighed(named, "f").withColumn("place", place).where(F.col("place") == k).select(key, F.round("weight", 9).alias("floor")))
    floor = F.coalesce("floor", F.lit(0.0))
    # far more than what rounding adds to a weight
    able = weighed(words, "n").join(floors, key, "left").where(F.col("weight") + 1e-8 >= floor).select("term").distinct()
    able = checkpoint(able if stop is None else able.join(stop, "term", "left_anti"))
    able_to = among(able)
    twos = let(F.transform(tokens(F.col(text)), lambda t: F.when(able_to(t), t)), lambda ts: F.array_compact(_neighbours(ts)))
    pairs = checkpoint(docs.select(key, F.explode(twos).alias("term")).groupBy(key, "term").agg(F.count("*").alias("n")))
    if stop is not None:  # `among` lets a few pass
        parts = pairs.select("term", F.explode(F.split("term", " ")).alias("w"))
        pairs = pairs.join(parts.join(stop.select(F.col("term").alias("w")), "w", "left_semi").select("term").distinct(), "term", "left_anti")
    pairs = pairs.join(pairs.groupBy("term").agg(F.sum("n").alias("f")), "term")
    grams = weighed(words.join(able, "term", "left_semi").unionByName(pairs), "f").join(floors, key, "left")
    return grams.select(key, "term", "tf", F.round("weight", 9).alias("weight"), "floor").where(F.col("weight") >= floor).drop("floor")


#: Ranked terms of a class that the first pick reads; a class that they do not fill is read four times deeper, and so on.
DEPTH = 64


def keywords(weights: DataFrame, stop: DataFrame, key: str, k: int, checkpoint) -> DataFrame:
    """key, pick, term: the heaviest terms of each class (weights compared at nine digits, ties by term) without those that hold a word of `stop` (term), and
    without a word of a 2-gram picked before it or a 2-gram with a word picked before it; at most `k`.

    Picking goes term by term, but a class sends only its heaviest terms to it; those it leaves open are read deeper, until all
    classes have `k` picks or no terms left."""
    words = weights.where(F.col("weight") > 0).select(key, "term", F.round("weight", 9).alias("weight"), F.split("term", " ").alias("ws"))
    # stop words are few beside the grams, which do not move to meet them where Spark can broadcast these
    held = words.select("term", F.explode("ws").alias("w")).join(stop.select(F.col("term").alias("w")), "w", "left_semi").select("term").distinct()
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc("weight"), "term"))
    ranked = words.join(held, "term", "left_anti").select(key, "term", "weight")
    sizes = checkpoint(ranked.groupBy(key).agg(F.count("*").alias("size")))
    schema = f"{key} {dict(weights.dtypes)[key]}, picks array<string>"

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list[str] = []
        for term in pdf.sort_values("rank")["term"]:
            if len(kept) < k and not any(term in x.split() or x in term.split() for x in kept):
                kept.append(term)
        return pd.DataFrame({key: pdf[key].iloc[:1], "picks": [kept]})

    depth, done, open_ = DEPTH, None, sizes.select(key)
    while True:
        terms = ranked.join(open_, key, "left_semi").withColumn("rank", rank).where(F.col("rank") <= depth)
        found = checkpoint(terms.groupBy(key).applyInPandas(pick, schema).join(sizes, key))
        full = (F.size("picks") >= k) | (F.col("size") <= depth)
        done = found.where(full) if done is None else done.unionByName(found.where(full))
        open_ = found.where(~full).select(key)
        if open_.isEmpty():
            return done.select(key, F.posexplode("picks").alias("pick", "term")).select(key, (F.col("pick") + 1).alias("pick"), "term")
        depth *= 4
