"""Benchmark decontamination: a prefix-filtered containment join, in DataFrame functions only.

Words are runs of [0-9a-z] and non-ASCII characters after lower-casing A-Z. Windows are `width` consecutive words of
an item; a shorter item is one window. The tokens of all windows are ordered by how rare they are in the documents
(counts over all of them, ties by the token). Containment of a whole window needs a prefix of one token, so each
window is indexed by its rarest token alone. Document words meet the index by an equi-join; the token's place in the
window gives the only possible start (positional bound), the start must leave room for the whole window (length
bound), and the words there must equal the window (exact verification, in the same stage as the join: neither texts
nor candidates are shuffled). Only verified hits and one row per document are grouped by document.

The index is broadcast in blocks of at most `BLOCK` windows, so what is broadcast has a fixed bound whatever the
benchmark's size.

Defined cases: null, empty and wordless texts have no words and no hits; wordless items have no window; repeated
items count by their item_id; rows that share a doc_id are judged together, each word position once, and the
longest text gives n_words; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import lower_ascii

WIDTH = 10
#: Windows in one broadcast.
BLOCK = 200_000
_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Stands after the last word of each document and matches its own index row, so that every document emits a row.
_LAST = "\x00"


def words(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), _NOT_WORD), "")


def windows(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """item_id, win array<string>: every distinct window of every item."""
    items = benchmark.select("item_id", words(F.col("text")).alias("ws")).where(F.size("ws") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("ws") - (width - 1), F.lit(1)))
    return items.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("ws", i, width))).alias("win")).distinct()


def _indexed(docs: DataFrame, wins: DataFrame) -> DataFrame:
    """item_ids, win, token, place: each distinct window under its rarest token in `docs`."""
    distinct = wins.groupBy("win").agg(F.collect_set("item_id").alias("items"))
    places = distinct.select("win", "items", F.posexplode("win").alias("place", "token"))
    vocabulary = places.select("token").distinct()
    counts = docs.select(F.explode(words(F.col("text"))).alias("token")).join(F.broadcast(vocabulary), "token").groupBy("token").agg(F.count("*").alias("n"))
    ranked = places.join(counts, "token", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return ranked.groupBy("win").agg(F.first("items").alias("items"), F.min_by(F.struct("token", "place"), F.struct("n", "token", "place")).alias("rare")).select("win", "items", "rare.token", "rare.place")


def hits(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, pos, len, items: verified windows, len 0 in each document's own row, where pos is its number of words."""
    wins = windows(benchmark, width).withColumn("block", F.lit(0))
    n = wins.count()
    blocks = max(1, -(-n // BLOCK))
    out = None
    rows = docs.select("doc_id", words(F.col("text")).alias("ws"))
    for k in range(blocks):
        part = wins if blocks == 1 else wins.where(F.pmod(F.xxhash64("win"), F.lit(blocks)) == k)
        index = _indexed(docs, part.drop("block"))
        if k == 0:
            own = docs.sparkSession.range(1).select(F.array(F.lit(_LAST)).alias("win"), F.array().cast(index.schema["items"].dataType).alias("items"), F.lit(_LAST).alias("token"), F.lit(0).alias("place"))
            index = index.unionByName(own)
        at = F.col("pos") - F.col("place")
        found = (
            rows.select("doc_id", "ws", F.posexplode(F.concat("ws", F.array(F.lit(_LAST)))).alias("pos", "token"))
            .join(F.broadcast(index), "token")
            .where((F.col("token") == _LAST) | ((at >= 0) & (at + F.size("win") <= F.size("ws")) & (F.slice("ws", F.greatest(at + 1, F.lit(1)), F.size("win")) == F.col("win"))))
            .select("doc_id", at.alias("pos"), F.when(F.col("token") == _LAST, 0).otherwise(F.size("win")).alias("len"), "items")
        )
        out = found if out is None else out.unionByName(found)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, item_ids, contaminated."""
    found = hits(docs, benchmark, width)
    by_place = found.groupBy("doc_id", "pos", "len").agg(F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    before = W.partitionBy("doc_id").orderBy("pos", "len").rowsBetween(W.unboundedPreceding, -1)
    covered = F.max(F.when(F.col("len") > 0, F.col("pos") + F.col("len"))).over(before)
    new = F.when(F.col("len") > 0, F.greatest(F.lit(0), F.col("pos") + F.col("len") - F.greatest(F.col("pos"), F.coalesce(covered, F.col("pos"))))).otherwise(0)
    return (
        by_place.withColumn("new", new)
        .groupBy("doc_id")
        .agg(
            F.max(F.when(F.col("len") == 0, F.col("pos"))).cast("long").alias("n_words"),
            F.sum("new").cast("long").alias("n_hit"),
            F.array_sort(F.transform(F.array_distinct(F.flatten(F.collect_list("items"))), lambda i: i.cast("string"))).alias("item_ids"),
        )
        .select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), "item_ids", (F.col("n_hit") > 0).alias("contaminated"))
    )


def digest(scored: DataFrame) -> DataFrame:
    """The columns of op4."""
    return scored.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


ORACLE = """
    WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
    b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark),
    bi AS (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0),
    bw AS (SELECT DISTINCT item_id, array_to_string(list_slice(ws, i, i + 9), ' ') AS win, len(list_slice(ws, i, i + 9)) AS n FROM bi),
    lens AS (SELECT DISTINCT n FROM bw),
    di AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM d),
    dw AS (SELECT doc_id, i, n, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS win FROM di, lens WHERE i + n - 1 <= len(ws)),
    h AS (SELECT DISTINCT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
    pos AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM h),
    np AS (SELECT doc_id, count(*) AS n_hit FROM pos GROUP BY doc_id),
    it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM h GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
           sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN np USING (doc_id) LEFT JOIN it USING (doc_id)"""
