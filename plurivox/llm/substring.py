"""Substring dedup by difference-cover anchors.

A word is removed where it lies in a window of `WINDOW` words whose word sequence also starts in a document with a
smaller doc_id. Windows are hashed only at cover positions: places p with p mod 7 in {0, 1, 3}, a difference cover, so
for any two places i, j of one repeated window there is an offset below 7 at which both i + offset and j + offset are
cover positions. An anchor of WINDOW - 6 = 7 words at that offset lies inside the window, so any repeated window
shares an aligned anchor.

1. Anchors travel through the packed exchange; those found in two documents or more come back to their places.
2. Each shared anchor extends to the windows that hold it: these candidate windows, a small part of all, are hashed
   whole, and the exchange finds the smallest document of each.
3. Words covered by windows with a smaller document are removed.

Each step settles what it can by itself (an anchor of two documents of the step is shared; a window of the step's
larger documents is repeated) and sends one document's entry for a key, so hot passages are pre-aggregated.

Defined cases: null, empty and wordless texts have no words and keep the empty text; rows without a doc_id take no part
and keep all words; rows that share a doc_id are repeats of one document and get one row each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import exchange, shared

WINDOW = 13
PERIOD = 7
COVER = (0, 1, 3)
ANCHOR = WINDOW - PERIOD + 1
#: Documents whose ids are broadcast at most; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000

_COVER = np.isin(np.arange(PERIOD), COVER)
_PACKED = "bucket int, hash binary, doc binary, pos binary, many binary"
_PLACES = "doc_id long, pos int"


def _settle(h: np.ndarray, doc: np.ndarray, pos: np.ndarray, mode: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a step's entries: which are settled here, which travel, and which of these stand for two documents or more."""
    order = np.lexsort((pos, doc, h))
    hs, ds = h[order], doc[order]
    first = np.r_[True, hs[1:] != hs[:-1]]
    group = np.cumsum(first) - 1
    least = ds[np.flatnonzero(first)][group]
    last = ds[np.r_[np.flatnonzero(first)[1:] - 1, len(ds) - 1]][group]
    settled, sent, many = np.zeros(len(h), bool), np.zeros(len(h), bool), np.zeros(len(h), bool)
    settled[order] = (last != least) if mode == "shared" else ds != least
    sent[order] = ds == least
    many[order] = last != least
    return settled, sent, many


def _send(h: np.ndarray, doc: np.ndarray, pos: np.ndarray, buckets: int, mode: str) -> Iterator[pa.RecordBatch]:
    if not len(h):
        return
    settled, sent, many = _settle(h, doc, pos, mode)
    names = ["bucket", "hash", "doc", "pos", "many"]
    full, _, blobs = exchange.pack(h[sent], buckets, h[sent], doc[sent], pos[sent].astype(np.int32), many[sent].astype(np.uint8))
    yield pa.RecordBatch.from_arrays([pa.array(full), *blobs], names=names)
    if settled.any():
        cuts = np.array([0, int(settled.sum())])
        none = exchange.blob(np.zeros(0, np.uint8), np.array([0, 0]))
        # a negative bucket passes through; any will do
        yield pa.RecordBatch.from_arrays([pa.array([-1 - int(h[0] % np.uint64(buckets))], pa.int32()), none, exchange.blob(doc[settled], cuts), exchange.blob(pos[settled].astype(np.int32), cuts), none], names=names)


def _answer(mode: str):
    """Places that a bucket settles: in shared mode those of keys with two documents, in smaller mode those above their key's smallest document."""

    def run(part: pa.Table) -> pa.Table:
        doc, pos = exchange.joined(part["doc"], np.int64), exchange.joined(part["pos"], np.int32)
        if part["bucket"][0].as_py() >= 0:
            h, many = exchange.joined(part["hash"], np.uint64), exchange.joined(part["many"], np.uint8)
            order = np.lexsort((doc, h))
            hs, ds = h[order], doc[order]
            start = np.flatnonzero(np.r_[True, hs[1:] != hs[:-1]])
            group = np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(hs)]))
            if mode == "shared":
                # what stands for many was settled in its step
                hit = (ds[start] != ds[np.r_[start[1:] - 1, len(ds) - 1]])[group] | (np.maximum.reduceat(many[order], start)[group] > 0)
                hit &= many[order] == 0
            else:
                hit = ds != ds[start][group]
            doc, pos = ds[hit], pos[order][hit]
        return pa.table({"doc_id": doc, "pos": pos})

    return run


def _places(sent: DataFrame, mode: str, name: str) -> DataFrame:
    """doc_id, places binary (sorted int32): what the exchange settles, by document."""
    found = sent.groupBy("bucket").applyInArrow(_answer(mode), _PLACES)
    return shared.written(found.groupBy("doc_id").agg(F.sort_array(F.collect_set("pos")).alias("places")), name)


def _with_ids(docs: DataFrame, marks: DataFrame, how: str) -> DataFrame:
    """Join by doc_id; the marked ids are broadcast only while few."""
    ids = marks.select("doc_id")
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", how)


def anchors(docs: DataFrame, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in shared.steps(batches):
            ids = step.column(0).to_numpy(zero_copy_only=False)
            words = shared.Words(step.column(1), lower=False)
            place = np.arange(len(words.starts)) - words.first[words.doc]
            at = np.flatnonzero(shared.window_ok(words, ANCHOR) & _COVER[place[: max(0, len(place) - ANCHOR + 1)] % PERIOD])
            # an anchor serves only a document long enough for a whole window
            at = at[np.diff(words.first)[words.doc[at]] >= WINDOW]
            yield from _send(shared.window_hash(words.hash, ANCHOR)[at], ids[words.doc[at]].astype(np.int64), place[at], buckets, "shared")

    return docs.select("doc_id", "text").where("doc_id is not null").mapInArrow(run, _PACKED)


def _candidates(n_words: int, places: np.ndarray) -> np.ndarray:
    """Starts of the windows that hold one of the anchors at `places`."""
    mark = np.zeros(n_words + 1, np.int32)
    np.add.at(mark, np.maximum(places - (PERIOD - 1), 0), 1)
    np.add.at(mark, places + 1, -1)
    starts = np.flatnonzero(np.cumsum(mark)[:n_words] > 0)
    return starts[starts <= n_words - WINDOW]


def candidate_windows(docs: DataFrame, marked: DataFrame, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in shared.steps(batches):
            ids = step.column(0).to_numpy(zero_copy_only=False)
            words = shared.Words(step.column(1), lower=False)
            hashes, out = shared.window_hash(words.hash, WINDOW), []
            for k in range(len(ids)):
                a, b = words.first[k], words.first[k + 1]
                starts = _candidates(b - a, np.array(step.column(2)[k].values, dtype=np.int64)) if b - a >= WINDOW else []
                if len(starts):
                    out.append((hashes[a + starts], np.full(len(starts), ids[k], np.int64), starts))
            if out:
                yield from _send(*(np.concatenate(c) for c in zip(*out)), buckets, "smaller")

    few = _with_ids(docs.select("doc_id", "text").where("doc_id is not null"), marked, "left_semi")
    return few.join(marked, "doc_id").select("doc_id", "text", "places").mapInArrow(run, _PACKED)


def _kept(docs: DataFrame, columns: list[T.StructField], pack) -> DataFrame:
    """Runs `pack(kept bytes, n_words, n_removed)` over rows of doc_id, text and places of repeated windows."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), *columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in shared.steps(batches):
            raw, offsets = shared.utf8(step.column(1))
            data, n_words, n_removed, kept = raw.tobytes(), [], [], []
            for k in range(len(offsets) - 1):
                words = data[offsets[k] : offsets[k + 1]].split()
                n_words.append(len(words))
                places = step.column(2)[k].values if step.column(2)[k].is_valid else None
                if places is not None and len(places):
                    mark = np.zeros(len(words) + WINDOW + 1, np.int32)
                    places = np.array(places, dtype=np.int64)
                    places = places[places < len(words)]
                    mark[places] += 1
                    mark[places + WINDOW] -= 1
                    stay = np.cumsum(mark)[: len(words)] == 0
                    words = list(compress(words, stay.tolist()))
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([step.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pack(kept)], names=schema.names)

    return docs.mapInArrow(run, schema)


def _marked(docs: DataFrame) -> DataFrame:
    """doc_id, text, places: the starts of the windows to remove, null where there is none."""
    buckets = exchange.buckets_for(docs)
    shared_anchors = _places(anchors(docs, buckets), "shared", "substring-anchors")
    repeated = _places(candidate_windows(docs, shared_anchors, buckets), "smaller", "substring-windows")
    rows = docs.select("doc_id", "text")
    few = _with_ids(rows, repeated, "left_semi").join(repeated, "doc_id")
    rest = _with_ids(rows, repeated, "left_anti").withColumn("places", F.lit(None).cast("array<int>"))
    return few.unionByName(rest)


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, text: the kept words joined by one space."""
    return _kept(_marked(docs), [T.StructField("text", T.StringType())], lambda kept: pa.array([k.decode("utf-8") for k in kept], pa.string()))


def digest(docs: DataFrame) -> DataFrame:
    """The columns of op10."""
    return _kept(_marked(docs), [T.StructField("kept_sha256", T.StringType())], lambda kept: pa.array([shared.sha(k) for k in kept], pa.string()))


ORACLE = """
    WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
    w AS (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 12), ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM d WHERE len(ws) >= 13)),
    m AS (SELECT win, min(doc_id) AS least FROM w GROUP BY win),
    r AS (SELECT doc_id, i FROM w JOIN m USING (win) WHERE doc_id > least),
    p AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM r),
    t AS (SELECT doc_id, ws[i] AS word, i FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM d)),
    k AS (SELECT t.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS kept FROM t LEFT JOIN p USING (doc_id, i) WHERE p.i IS NULL GROUP BY t.doc_id)
    SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
    FROM d LEFT JOIN k USING (doc_id)"""
