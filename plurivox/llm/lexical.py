"""Ranked lexical search: the best documents for each item, by windowed bucket scoring.

First pass: documents become postings of the items' terms, packed by windows of `WINDOW` doc_ids; their sums give the
number of documents, all terms, and how many documents hold a term. Second pass: the packed windows, in doc_id order
over range partitions, are traversed one bucket after the other. A bucket is a window, or as many neighbouring windows as
fill `SLOTS` documents where ids are sparse; a fuller window (repeated ids) is several buckets. An item's terms are
scattered into an array of one score a slot that fits the cache, beside a bitset of the slots touched; only those are harvested,
and what beats the item's tenth so far enters its heap. A task hands on its heaps: ten rows an item.

Items are taken in blocks of at most about `PAIRS` terms (an item at least), so what is broadcast is bounded whatever the number of
items. Words are compared byte by byte, never by their hash alone.

Defined cases: null, empty and wordless texts are no documents and give no rows; rows of one doc_id are documents of
their own; a null doc_id counts in all statistics and stands behind all others of an equal score; rows of one item_id
are one item, and so are those without one; items without terms or without a matching document give no rows; terms
in all but every document may have weight 0; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import Tables, Words, hash_spans, lower_ascii, steps, utf8, written

TOP = 10
#: Ids of one window, and documents of one bucket.
WINDOW = SLOTS = 4096
#: (item, term) pairs of one pass.
PAIRS = 1_000_000
_BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TERM = np.ones(256, dtype=bool)
_TERM[[*range(0, 48), *range(58, 65), *range(91, 97), *range(123, 128)]] = False
_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [(1 << 64) - 1], dtype=np.uint64)

_SEGMENT = "window long, docs long, tokens long, ids binary, sizes binary, terms binary, counts binary, slots binary, tfs binary"


def terms(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), _BREAK), "")


def _eight(buf: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The next eight bytes of spans as one number each, zeros beyond the span; `buf` has eight bytes more than its spans."""
    rows = np.lib.stride_tricks.as_strided(buf, shape=(len(buf) - 7, 8), strides=(1, 1))
    return np.ascontiguousarray(rows[at]).view(np.uint64).ravel() & _MASKS[np.minimum(left, 8)]


class Terms:
    """The terms of one pass, found by hash and confirmed by their bytes."""

    def __init__(self, names: pa.Array):
        raw, offsets = utf8(names)
        starts, ends = offsets[:-1], offsets[1:]
        h = hash_spans(raw, starts, ends)
        self.id = np.argsort(h, kind="stable")
        self.hash, self.starts, self.lens = h[self.id], starts[self.id], (ends - starts)[self.id]
        self.buf = np.concatenate([raw, np.zeros(8, np.uint8)])
        same = np.r_[False, self.hash[1:] == self.hash[:-1]]
        #: the most terms that share a hash
        self.run = 1 + max((len(s) for s in "".join("x" if x else " " for x in same).split()), default=0) if same.any() else 1

    def find(self, words: Words) -> np.ndarray:
        """The number of each word's term, -1 without one."""
        out = np.full(len(words.starts), -1)
        if not len(self.hash):
            return out
        buf = np.concatenate([words.buf, np.zeros(8, np.uint8)])
        lens = words.ends - words.starts
        first = np.searchsorted(self.hash, words.hash)
        for step in range(self.run):
            at = np.minimum(first + step, len(self.hash) - 1)
            live = np.flatnonzero((self.hash[at] == words.hash) & (self.lens[at] == lens) & (out < 0))
            mine = at[live]
            ok, done = np.ones(len(live), bool), 0
            part = np.arange(len(live))
            while len(part):
                left = lens[live[part]] - done
                ok[part] &= _eight(buf, words.starts[live[part]] + done, left) == _eight(self.buf, self.starts[mine[part]] + done, left)
                part, done = part[(left > 8) & ok[part]], done + 8
            out[live[ok]] = self.id[mine[ok]]
        return out


def _segments(step: pa.RecordBatch, found: Terms, number: int) -> Iterator[tuple]:
    """The packed windows of a slice of rows (doc_id, text)."""
    words = Words(step.column(1), chars=_TERM)
    sizes = np.diff(words.first)
    term = found.find(words)
    hit = term >= 0
    pair, tf = np.unique(words.doc[hit] * number + term[hit], return_counts=True)
    doc, term = pair // max(1, number), pair % max(1, number)
    null = np.asarray(step.column(0).is_null())
    ids = step.column(0).fill_null(0).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(sizes)
    rows = rows[np.lexsort((ids[rows], null[rows]))]
    window = ids // WINDOW
    new = np.r_[True, (window[rows[1:]] != window[rows[:-1]]) | (null[rows[1:]] != null[rows[:-1]])] if len(rows) else np.zeros(0, bool)
    run = np.cumsum(new) - 1
    inside = np.arange(len(rows)) - np.flatnonzero(new)[run]
    cuts = np.flatnonzero(new | (inside % SLOTS == 0))
    piece, slot = np.full(len(sizes), -1), np.zeros(len(sizes), np.int64)
    piece[rows] = np.searchsorted(cuts, np.arange(len(rows)), side="right") - 1
    slot[rows] = inside % SLOTS
    order = np.lexsort((slot[doc], term, piece[doc]))
    doc, term, tf = doc[order], term[order], tf[order]
    edges = np.searchsorted(piece[doc], np.arange(len(cuts) + 1))
    for k, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(rows)])):
        part, (p, q) = rows[a:b], edges[k : k + 2]
        t, counts = np.unique(term[p:q], return_counts=True)
        yield (
            None if null[part[0]] else int(window[part[0]]), len(part), int(sizes[part].sum()), ids[part].astype(np.int64).tobytes(), sizes[part].astype(np.int64).tobytes(),
            t.astype(np.int32).tobytes(), counts.astype(np.int32).tobytes(), slot[doc[p:q]].astype(np.uint16).tobytes(), tf[p:q].astype(np.int32).tobytes(),
        )


def postings(docs: DataFrame, names: pa.Array) -> DataFrame:
    """The packed windows of `docs` for the terms `names`."""
    held = docs.sparkSession.sparkContext.broadcast(Terms(names))
    number = len(names)
    kinds = [pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * 6]
    columns = [c.split()[0] for c in _SEGMENT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps(batches, 1):
            rows = list(_segments(step, held.value, number))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=columns)

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(run, _SEGMENT)


def frequencies(segments: DataFrame, number: int) -> np.ndarray:
    """How many documents hold each of the `number` terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(number, np.int64)
        for batch in batches:
            for t, c in zip(batch.column(0), batch.column(1)):
                total[np.frombuffer(t.as_buffer(), np.int32)] += np.frombuffer(c.as_buffer(), np.int32)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["term", "df"])

    sums = segments.select("terms", "counts").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    out = np.zeros(number, np.int64)
    out[sums["term"].to_numpy()] = sums["df"].to_numpy()
    return out


class Bucket:
    """Up to `SLOTS` documents in doc_id order: ids, and postings by term with their scores."""

    def __init__(self, parts: list[dict], weight: np.ndarray, docs: int, tokens: int):
        take = lambda name, kind: [np.frombuffer(p[name], kind) for p in parts]
        ids = take("ids", np.int64)
        base = np.cumsum([0, *map(len, ids)])
        self.ids, sizes = np.concatenate(ids), np.concatenate(take("sizes", np.int64))
        self.null = np.repeat([p["window"] is None for p in parts], np.diff(base))
        term = np.concatenate([np.repeat(t, c) for t, c in zip(take("terms", np.int32), take("counts", np.int32))]).astype(np.int64)
        slot = np.concatenate([s + b for s, b in zip(take("slots", np.uint16), base)]).astype(np.int64)
        tf = np.concatenate(take("tfs", np.int32)).astype(np.int64)
        order = np.lexsort((slot, term))
        term, self.slot, tf = term[order], slot[order], tf[order]
        self.terms, first = np.unique(term, return_index=True)
        self.cuts = np.r_[first, len(term)]
        m = 100 - 90 + (90 * sizes * docs) // tokens
        self.score = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[self.slot]))
        # each term's slots as words of a bitset
        word, bit = self.slot >> 6, np.uint64(1) << (self.slot & 63).astype(np.uint64)
        runs = np.flatnonzero(np.r_[True, (word[1:] != word[:-1]) | (term[1:] != term[:-1])]) if len(term) else np.zeros(0, np.int64)
        self.words = word[runs]
        self.bits = np.bitwise_or.reduceat(bit, runs) if len(runs) else np.zeros(0, np.uint64)
        self.word_cuts = np.searchsorted(runs, self.cuts)


class Ranking:
    """The heaps of all items of a pass: (score, -1 for a null id, -id), the worst first."""

    def __init__(self, item_terms: list[np.ndarray], weight: np.ndarray):
        self.items = [t[weight[t] > 0] for t in item_terms]
        self.weight = weight
        self.heaps: list[list[tuple[int, int, int]]] = [[] for _ in item_terms]
        self.at = np.full(len(weight), -1)

    def take(self, b: Bucket) -> None:
        self.at[b.terms] = np.arange(len(b.terms))
        slots = -(-len(b.ids) // 64) * 64
        scores, touched = np.zeros(slots, np.int64), np.zeros(slots // 64, np.uint64)
        for item, heap in zip(self.items, self.heaps):
            here = self.at[item]
            here = here[here >= 0]
            if not len(here):
                continue
            for k in here.tolist():
                p, q = b.cuts[k], b.cuts[k + 1]
                scores[b.slot[p:q]] += b.score[p:q]
                p, q = b.word_cuts[k], b.word_cuts[k + 1]
                touched[b.words[p:q]] |= b.bits[p:q]
            live = np.flatnonzero(np.unpackbits(touched.view(np.uint8), bitorder="little"))
            got = scores[live]
            least = heap[0][0] if len(heap) == TOP else 1
            if len(live) > TOP:
                least = max(least, int(np.partition(got, -TOP)[-TOP]))
            ok = live[got >= least]
            for s in ok.tolist():
                entry = (int(scores[s]), -int(b.null[s]), -int(b.ids[s]))
                if len(heap) < TOP:
                    heapq.heappush(heap, entry)
                elif entry > heap[0]:
                    heapq.heapreplace(heap, entry)
            scores[live] = 0
            touched[:] = 0
        self.at[b.terms] = -1


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Neighbouring packed windows, up to `SLOTS` documents together."""
    held, size = [], 0
    for batch in batches:
        for row in batch.to_pylist():
            n = len(row["ids"]) // 8
            if held and size + n > SLOTS:
                yield held
                held, size = [], 0
            held.append(row)
            size += n
    if held:
        yield held


def _pass(docs: DataFrame, pairs: pa.Table, tables: Tables, out: T.StructType, sums: tuple[int, int] | None) -> tuple[DataFrame | None, tuple[int, int]]:
    """item_id, doc_id, score of the heaps of all tasks for the items of `pairs` (item_id, term); documents and terms in all."""
    item, term = pairs["item_id"].combine_chunks().dictionary_encode(null_encoding="encode"), pairs["term"].combine_chunks().dictionary_encode()
    names, ids = term.dictionary, item.dictionary
    owner, of = item.indices.to_numpy(zero_copy_only=False), term.indices.to_numpy(zero_copy_only=False)
    order = np.lexsort((of, owner))
    item_terms = np.split(of[order].astype(np.int64), np.flatnonzero(np.diff(owner[order])) + 1)
    segments = tables.write(postings(docs, names), "postings")
    if sums is None:
        row = segments.agg(F.sum("docs"), F.sum("tokens")).first()
        sums = (row[0] or 0, row[1] or 0)
    n_docs, n_tokens = sums
    if not n_docs:
        return None, sums
    df = frequencies(segments, len(names))
    weight = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
    held = docs.sparkSession.sparkContext.broadcast((item_terms, weight, ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item_terms, weight, ids = held.value
        ranking = Ranking(item_terms, weight)
        for parts in _buckets(batches):
            ranking.take(Bucket(parts, weight, n_docs, n_tokens))
        rows = [(k, None if e[1] else -e[2], e[0]) for k, heap in enumerate(ranking.heaps) for e in heap]
        if rows:
            k, doc, score = zip(*rows)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(k)), pa.array(doc, pa.int64()), pa.array(score, pa.int64())], names=["item_id", "doc_id", "score"])

    # a window that many rows share is spread by its content
    spread = segments.where(F.length("terms") > 0).withColumn("part", F.xxhash64("ids", "slots"))
    ordered = spread.repartitionByRange("window", "part").sortWithinPartitions("window", "part").drop("part", "docs", "tokens")
    return ordered.mapInArrow(run, out), sums


def search(docs: DataFrame, items: DataFrame) -> DataFrame:
    """item_id, rank, doc_id, score: the `TOP` best documents of each item."""
    tables = Tables(docs.sparkSession, "lexical", small=True)
    pairs = tables.write(items.select("item_id", F.explode(F.array_distinct(terms(F.col("text")))).alias("term")).distinct(), "pairs")
    blocks = max(1, -(-pairs.count() // PAIRS))
    out = T.StructType([pairs.schema["item_id"], T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])
    best, sums = docs.sparkSession.createDataFrame([], out), None
    for k in range(blocks):
        part = pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).toArrow()
        if part.num_rows:
            found, sums = _pass(docs, part, tables, out, sums)
            if found is not None:
                best = best.unionByName(tables.write(found, "heaps"))
    rank = F.row_number().over(W.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    ranked = written(best.withColumn("rank", rank).where(F.col("rank") <= TOP).select("item_id", "rank", "doc_id", "score"), "ranked")
    tables.drop()
    return ranked


_SQL_TERMS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
ORACLE = f"""
    WITH d AS (SELECT doc_id, {_SQL_TERMS} AS ts FROM documents), s AS (SELECT doc_id, len(ts)::BIGINT AS n, ts FROM d WHERE len(ts) > 0),
    tot AS (SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS big_l FROM s),
    q AS (SELECT DISTINCT item_id, unnest({_SQL_TERMS}) AS term FROM benchmark),
    p AS (SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, n, unnest(ts) AS term FROM s) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
    w AS (SELECT term, floor(1000 * ln((2 * any_value(big_n) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, tot GROUP BY term),
    r AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * big_n) // big_l)))))::BIGINT AS score FROM q JOIN p USING (term) JOIN w USING (term), tot GROUP BY ALL)
    SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0) WHERE rank <= 10"""
