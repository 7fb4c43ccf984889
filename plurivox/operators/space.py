"""The space of vectors as a whole: principal components taken out, exact silhouettes, and thresholds for a wanted degree."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .vector import matrix, normalised, unit

#: Rows of the matrix of second moments that travel together.
CHUNK = 64
#: Clusters whose sums one pass over the vectors holds.
CLUSTERS = 4096


def moments(vectors: DataFrame, vector: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Number, mean and covariance of the vectors: each task adds up its own products, chunks of their rows are summed by chunk in streams, and only d * d
    numbers reach the driver. Null vectors do not count."""

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sums, n = None, None, 0
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(0))
                total = x.T @ x if total is None else total + x.T @ x
                sums, n = (x.sum(axis=0) if sums is None else sums + x.sum(axis=0)), n + len(x)
        if n:
            parts = [np.r_[n, sums], *(total[a : a + CHUNK].ravel() for a in range(0, len(total), CHUNK))]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([p.tobytes() for p in parts])], names=["chunk", "data"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks: list[int] = []
        sums: list[np.ndarray] = []
        for batch in batches:
            for k, cell in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = np.frombuffer(cell.as_buffer(), np.float64)
                if chunks and chunks[-1] == k:
                    sums[-1] = sums[-1] + x
                else:
                    chunks.append(k)
                    sums.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.int32()), pa.array([s.tobytes() for s in sums], pa.binary())], names=["chunk", "data"])

    parts = vectors.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>")).mapInArrow(products, "chunk int, data binary")
    rows = {r["chunk"]: np.frombuffer(r["data"], np.float64) for r in parts.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(added, "chunk int, data binary").collect()}
    if not rows:
        return 0, np.zeros(0), np.zeros((0, 0))
    n, mean = int(rows[0][0]), rows[0][1:] / rows[0][0]
    second = np.concatenate([rows[k] for k in range(1, len(rows))]).reshape(len(mean), -1) / n
    return n, mean, second - np.outer(mean, mean)


def without_components(vectors: DataFrame, vector: str, components: int) -> DataFrame:
    """`vectors` less their mean and their projection on the `components` directions of largest variance, of length 1 again; what is zero then stays zero."""
    _, mean, cov = moments(vectors, vector)
    top = np.linalg.eigh(cov)[1][:, ::-1][:, :components].T if len(mean) else np.zeros((0, 0))
    held = vectors.sparkSession.sparkContext.broadcast((mean, top))
    kept = [c for c in vectors.columns if c != vector]
    rows = vectors.select(*kept, F.col(vector).cast("array<double>").alias(vector))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, top = held.value
        for batch in batches:
            cells = batch.column(len(kept))
            some = cells.is_valid().to_numpy(zero_copy_only=False)
            if some.any():
                x = matrix(cells.drop_null()) - mean
                x = unit(x - (x @ top.T) @ top)
                found: list = [None] * len(some)
                for k, row in zip(np.flatnonzero(some), x):
                    found[k] = row
                cells = pa.array(found, pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(kept))), cells], names=[*kept, vector])

    return rows.mapInArrow(run, rows.schema)


def silhouettes(vectors: DataFrame, key: str, label: str, vector: str, checkpoint: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """key, label, silhouette by cosine distance, exact: the mean distance to a cluster follows from the sum of its unit vectors, so the cost is vectors times
    clusters, not vectors times vectors. Clusters are taken `CLUSTERS` at a time. A lone member has 0; with fewer than two clusters there are no rows. Null labels and
    vectors take no part."""
    rows = checkpoint(vectors.where(F.col(label).isNotNull() & F.col(vector).isNotNull()).select(key, label, normalised(F.col(vector)).alias("v")))
    parts = rows.select(label, F.posexplode("v").alias("pos", "x")).groupBy(label, "pos").agg(F.sum("x").alias("s"))
    sums = parts.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda x: x["s"]).alias("s")).join(rows.groupBy(label).agg(F.count("*").alias("n")), label)
    place = F.row_number().over(W.orderBy(label)) - 1  # one row a cluster
    sums = checkpoint(sums.withColumn("at", place))
    clusters = sums.count()
    if clusters < 2:
        return rows.select(key, label, F.lit(0.0).alias("silhouette")).limit(0)
    marked = checkpoint(rows.join(F.broadcast(sums.select(label, "at", "n")) if clusters <= 100_000 else sums.select(label, "at", "n"), label).select(key, label, "v", "at", "n"))
    schema = marked.select(key, label, "n").schema.simpleString()[len("struct<") : -1].replace(",", ", ") + ", inner double, outer double"
    found = None
    for first in range(0, clusters, CLUSTERS):
        block = sums.where((F.col("at") >= first) & (F.col("at") < first + CLUSTERS)).orderBy("at").select("s", "n").toArrow()
        held = vectors.sparkSession.sparkContext.broadcast((matrix(block["s"]), block["n"].to_numpy().astype(np.float64), first))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            s, n, first = held.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                dots = matrix(batch.column(2)) @ s.T
                far = 1 - dots / n
                at = batch.column(3).to_numpy(zero_copy_only=False) - first
                own = np.flatnonzero((at >= 0) & (at < len(n)))
                inner = np.full(len(far), np.nan)
                mine = n[at[own]]
                # the member itself is left out of its own cluster's mean
                inner[own] = np.where(mine > 1, (mine * far[own, at[own]] - (1 - (matrix(batch.column(2))[own] ** 2).sum(axis=1))) / np.maximum(mine - 1, 1), 0.0)
                far[own, at[own]] = np.inf
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(4), pa.array(inner, from_pandas=True), pa.array(far.min(axis=1))], names=[key, label, "n", "inner", "outer"])

        part = marked.mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    if clusters > CLUSTERS:
        found = found.groupBy(key, label, "n").agg(F.max("inner").alias("inner"), F.min("outer").alias("outer"))
    a, b = F.col("inner"), F.col("outer")
    score = F.when((F.col("n") == 1) | (F.greatest(a, b) == 0), 0.0).otherwise((b - a) / F.greatest(a, b))
    return found.select(key, label, score.alias("silhouette"))


def degree_threshold(neighbours: DataFrame, nodes: int, degree: float) -> DataFrame:
    """One row, threshold and edges: the lowest weight at which the undirected graph of `neighbours` (a, b, w) has at most `degree` edge ends a node on average.

    Weights count at six digits, so at most two million of them differ; these, not the edges, are ranked."""
    levels = neighbours.groupBy(F.round("w", 6).alias("threshold")).agg(F.count("*").alias("n"))
    above = levels.withColumn("edges", F.sum("n").over(W.orderBy(F.desc("threshold")).rowsBetween(W.unboundedPreceding, 0)))
    return above.where(2 * F.col("edges") <= F.lit(degree) * nodes).agg(F.min("threshold").alias("threshold"), F.max("edges").alias("edges"))
