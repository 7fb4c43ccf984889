"""Approximate nearest neighbours by an inverted multi-index.

Vectors are cut into halves and each half is quantised by its own codebook of `CENTROIDS` centroids (k-means in numpy over
at most `SAMPLE` vectors, those of the smallest hashed ids). A cell is a pair of centroids; every vector is indexed.
A query visits cells by rising sum of the two half distances, with a heap over the two sorted centroid lists,
until the visited cells hold the share `VISIT` of all entries (and `LEAST` entries at least). The entries of visited
cells are reranked by their exact distance in double precision.

Of equal vectors only the `k + 1` smallest ids can be among the nearest of any query, so only these become
entries: a hot vector adds a few rows. Entries are dealt by cell: blocks of bounded size hold neighbouring cells, and a
larger cell is dealt over several blocks. A query goes only to the blocks that hold cells of its traversal, in chunks of
bounded size, and reads only the entries of those cells; only each block's nearest go on.

Random high-dimensional vectors have no close neighbours, so the visited share is high; it is a parameter.

Defined cases: vectors that are null, zero, of another length than most, or hold null or non-finite components take no
part; null ids take no part; repeated rows of one id and vector count once as a candidate and as a query; an id with several
vectors counts once in a ranking, by its nearest vector, and asks with all of them; other columns are ignored; an empty table
returns no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import written

CENTROIDS = 64
SAMPLE = 8192
VISIT = 0.55
LEAST = 400
BLOCK_ROWS = 4096
QUERY_ROWS = 2048
EVERY = 100


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding of the vectors that take part, each id and vector once."""
    ok = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & ok).distinct()
    size = rows.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "d").first()
    return rows.where(F.size("embedding") == (size["d"] if size else 0))


def _kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(3)
    distinct = np.unique(x, axis=0)
    c = distinct[rng.permutation(len(distinct))[:k]].copy()
    for _ in range(rounds):
        at = ((c * c).sum(1) - 2 * x @ c.T).argmin(1)
        size = np.bincount(at, minlength=len(c))
        for j in np.flatnonzero(size):
            c[j] = x[at == j].mean(0)
    return c


class Index:
    def __init__(self, sample: np.ndarray, centroids: int):
        self.half = sample.shape[1] // 2
        self.books = [_kmeans(part, centroids) if part.shape[1] else np.zeros((1, 0)) for part in (sample[:, : self.half], sample[:, self.half :])]

    def distances(self, x: np.ndarray) -> list[np.ndarray]:
        parts = (x[:, : self.half], x[:, self.half :])
        return [(p * p).sum(1)[:, None] - 2 * p @ b.T + (b * b).sum(1) for p, b in zip(parts, self.books)]

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = self.distances(x)
        return (a.argmin(1) * len(self.books[1]) + b.argmin(1)).astype(np.int32)

    def visit(self, q: np.ndarray, sizes: np.ndarray, enough: int) -> np.ndarray:
        """Cells by rising summed distance until `enough` entries."""
        a, b = (d[0] for d in self.distances(q[None]))
        ra, rb = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
        a, b, ra, rb = a[ra].tolist(), b[rb].tolist(), ra.tolist(), rb.tolist()
        heap, reached, out, n, width = [(a[0] + b[0], 0, 0)], [0] * len(a), [], 0, len(b)
        while heap and n < enough:
            _, i, j = heapq.heappop(heap)
            cell = ra[i] * width + rb[j]
            if sizes[cell]:
                out.append(cell)
                n += sizes[cell]
            reached[i] = j + 1
            # a pair is next once its neighbours in both lists are done
            if i + 1 < len(a) and reached[i + 1] == j:
                heapq.heappush(heap, (a[i + 1] + b[j], i + 1, j))
            if j + 1 < width and (i == 0 or reached[i - 1] > j + 1):
                heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
        return np.array(out, dtype=np.int32)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def _places(sizes: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """First block and number of blocks of each cell: neighbouring cells share a block of up to `rows` entries, larger cells have blocks of their own."""
    base, parts = np.zeros(len(sizes), dtype=np.int32), np.maximum(1, -(-sizes // rows)).astype(np.int32)
    block, held = 0, 0
    for cell in np.flatnonzero(sizes):
        if held and held + sizes[cell] > rows:
            block, held = block + 1, 0
        base[cell] = block
        held += sizes[cell]
        if parts[cell] > 1:
            block, held = block + int(parts[cell]), 0
    return base, parts


def search(vectors: DataFrame, k: int = 10, every: int = EVERY, visit: float = VISIT, centroids: int = CENTROIDS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each vector whose id is divisible by `every`."""
    spark = vectors.sparkSession
    rows = written(usable(vectors), "multiindex-vectors")
    ids = rows.select("vec_id").distinct().orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE)
    sample = [r[1] for r in sorted(rows.join(F.broadcast(ids), "vec_id", "left_semi").groupBy("vec_id").agg(F.min("embedding")).collect())]
    out = "query_id long, rank int, vec_id long, score double"
    if not sample:
        return spark.createDataFrame([], out)
    held = spark.sparkContext.broadcast(Index(np.array(sample, dtype=np.float64), centroids))

    def assign(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(held.value.cells(_matrix(batch.column(1))))], names=["vec_id", "embedding", "cell"])

    same = F.row_number().over(W.partitionBy("embedding").orderBy("vec_id"))
    entries = rows.withColumn("same", same).where(F.col("same") <= k + 1).drop("same")
    entries = written(entries.mapInArrow(assign, "vec_id long, embedding array<double>, cell int"), "multiindex-entries")
    sizes = np.zeros(centroids * centroids, dtype=np.int64)  # at most so many cells
    for cell, n in entries.groupBy("cell").count().collect():
        sizes[cell] = n
    total = int(sizes.sum())
    base, parts = _places(sizes, min(BLOCK_ROWS, -(-total // 16)))
    enough = max(int(visit * total) + 1, LEAST)
    known = spark.sparkContext.broadcast((sizes, base, parts))

    def plan(batches):
        """A row for each query and run of blocks, with the cells to read there."""
        names = ["query_id", "q", "base", "parts", "cells"]
        for batch in batches:
            for at in range(batch.num_rows):
                sizes, base, parts = known.value
                q = batch.slice(at, 1)
                cells = np.sort(held.value.visit(_matrix(q.column(1))[0], sizes, enough))
                first = np.flatnonzero(np.r_[True, base[cells[1:]] != base[cells[:-1]]])
                n = len(first)
                columns = [q.column(c).take(pa.array(np.zeros(n, np.int64))) for c in (0, 1)]
                columns += [pa.array(v[cells[first]]) for v in (base, parts)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([c.tobytes() for c in np.split(cells, first[1:])], pa.binary())], names=names)

    queries = rows.where(F.pmod("vec_id", F.lit(every)) == 0).select("vec_id", "embedding")
    visits = written(queries.mapInArrow(plan, "query_id long, q array<double>, base int, parts int, cells binary"), "multiindex-visits")
    # one row a run of blocks, so no more than there are cells
    load = visits.groupBy("base").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("chunks"))
    places = spark.createDataFrame([(int(c), int(base[c]), int(parts[c])) for c in np.flatnonzero(sizes)], "cell int, base int, parts int")
    asked = visits.join(F.broadcast(load), "base").withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.col("chunks")).cast("int"))
    asked = asked.withColumn("block", F.explode(F.sequence("base", F.col("base") + F.col("parts") - 1))).select("block", "chunk", "query_id", "q", "cells")
    dealt = entries.join(F.broadcast(places), "cell").join(F.broadcast(load), "base").withColumn("block", (F.col("base") + F.pmod(F.xxhash64("vec_id", F.lit(7)), F.col("parts"))).cast("int"))
    dealt = dealt.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select("block", "chunk", "vec_id", "embedding", "cell")

    def rerank(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if left.num_rows and right.num_rows:
            left = left.sort_by("cell")
            x, ids, cell = _matrix(left["embedding"]), left["vec_id"].to_numpy(), left["cell"].to_numpy()
            for qid, q, cells in zip(right["query_id"].to_pylist(), _matrix(right["q"]), right["cells"].to_pylist()):
                cells = np.frombuffer(cells, dtype=np.int32)
                start = np.searchsorted(cell, cells)
                n = np.searchsorted(cell, cells, "right") - start
                at = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())
                at = at[ids[at] != qid]
                d = x[at] - q
                d = np.sqrt((d * d).sum(1))
                order = np.lexsort((ids[at], d))
                best = order[np.sort(np.unique(ids[at][order], return_index=True)[1])[:k]]
                found.append((np.full(len(best), qid), ids[at][best], d[best]))
        cols = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), cols)))

    near = dealt.groupBy("block", "chunk").cogroup(asked.groupBy("block", "chunk")).applyInArrow(rerank, "query_id long, vec_id long, score double")
    near = near.repartition("query_id").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
