"""Windows over events, the same for a batch and for a stream, and the submission stream.

Submissions arrive as JSON files; a store keeps the seed and all batches received.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SUBMISSION = T.StructType([T.StructField("text", T.StringType()), T.StructField("ts", T.TimestampType()), T.StructField("vec", T.ArrayType(T.FloatType()))])


def _late(events: DataFrame, ts: str, late: str | None) -> DataFrame:
    return events.withWatermark(ts, late) if late and events.isStreaming else events


def tumbling(events: DataFrame, ts: str, keys: list[str], size: str, late: str | None = None) -> DataFrame:
    w = _late(events, ts, late).groupBy(F.window(ts, size).alias("w"), *keys).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"))
    return w.select(F.col("w.start").alias("start"), *keys, "n", "value")


def sliding(events: DataFrame, ts: str, keys: list[str], size: str, step: str, late: str | None = None) -> DataFrame:
    w = _late(events, ts, late).groupBy(F.window(ts, size, step).alias("w"), *keys).agg(F.count("*").alias("n"))
    return w.select(F.col("w.start").alias("start"), *keys, "n")


def sessions(events: DataFrame, ts: str, keys: list[str], gap: str, late: str | None = None) -> DataFrame:
    w = _late(events, ts, late).groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count("*").alias("n"))
    return w.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_seen(events: DataFrame, ts: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Each key once: within the watermark on a stream, over all rows on a batch."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def over_rate(events: DataFrame, ts: str, key: str, seconds: int, most: int) -> DataFrame:
    """Rows with more than `most` rows of their key in the `seconds` up to them."""
    from pyspark.sql import Window as W

    w = W.partitionBy(key).orderBy(F.unix_micros(F.col(ts).cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn("in_window", F.count("*").over(w)).where(F.col("in_window") > most)


def submissions(spark: SparkSession, folder: str) -> DataFrame:
    """The stream of submissions; rows without a vector are kept."""
    return spark.readStream.schema(SUBMISSION).json(folder)


#: Submissions compared with the store in one pass over it.
BLOCK_ROWS = 2048


def correlate(batch: DataFrame, before: DataFrame, bound: float = 0.68) -> DataFrame:
    """For each submission of a batch: how many came before, how many of them are close, and the closest cosine. Only aggregates leave.

    Rows of a batch meet each other in the order of (ts, text); equal rows count as one after the other. The store is read once for each `BLOCK_ROWS` new vectors,
    which travel to its rows; no row of the store moves. Vectors are taken as they are (unit length is the sender's part); null ones are close
    to nothing, and so are those of another length."""
    spark = batch.sparkSession
    new = batch.select("ts", "text", "vec").orderBy("ts", "text").toArrow()  # a micro-batch is bounded by its trigger
    stored = before.count()
    rows = new.to_pylist()
    out: list[tuple] = []
    for at in range(0, len(rows), BLOCK_ROWS):
        block = rows[at : at + BLOCK_ROWS]
        close, top = _against(before, [r["vec"] for r in block], bound)
        inner, inner_top = _earlier([r["vec"] for r in rows[: at + len(block)]], at, bound)
        for k, r in enumerate(block):
            best = max((t for t in (top[k], inner_top[k]) if t is not None), default=None)
            out.append((r["ts"], stored + at + k, int(close[k] + inner[k]), None if best is None else round(best, 6)))
    return spark.createDataFrame(out, "ts timestamp, before long, close long, top double")


def _against(before: DataFrame, vectors: list[list[float] | None], bound: float) -> tuple[list[int], list[float | None]]:
    """For each vector: how many of the store are at `bound` or above, and the highest cosine."""
    close, top = [0] * len(vectors), [None] * len(vectors)
    for size in {len(v) for v in vectors if v}:
        at = [k for k, v in enumerate(vectors) if v and len(v) == size]
        x = np.array([vectors[k] for k in at], np.float64)

        def run(batches: Iterator[pa.RecordBatch], x: np.ndarray = x) -> Iterator[pa.RecordBatch]:
            n, best = np.zeros(len(x), np.int64), np.full(len(x), -np.inf)
            for batch in batches:
                for a in range(0, batch.num_rows, 4096):
                    y = np.array(batch.column(0)[a : a + 4096].to_pylist(), np.float64)
                    c = x @ y.T
                    n += (c >= bound).sum(axis=1)
                    best = np.maximum(best, c.max(axis=1))
            seen = np.flatnonzero(np.isfinite(best))
            yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(n[seen]), pa.array(best[seen])], names=["k", "n", "best"])

        known = before.where(F.size("vec") == size).select("vec").mapInArrow(run, "k long, n long, best double")
        for r in known.groupBy("k").agg(F.sum("n").alias("n"), F.max("best").alias("best")).collect():
            close[at[r["k"]]], top[at[r["k"]]] = r["n"], r["best"]
    return close, top


def _earlier(vectors: list[list[float] | None], at: int, bound: float) -> tuple[list[int], list[float | None]]:
    """The same for the vectors from `at` on, each against those before it in the list."""
    close, top = [0] * (len(vectors) - at), [None] * (len(vectors) - at)
    for size in {len(v) for v in vectors if v}:
        places = np.array([k for k, v in enumerate(vectors) if v and len(v) == size])
        x, new = np.array([vectors[k] for k in places], np.float64), np.flatnonzero(places >= at)
        for a in range(0, len(new), 256):
            own = new[a : a + 256]
            c = np.where(places[None, :] < places[own][:, None], x[own] @ x.T, -np.inf)
            for k, row in zip(places[own], c):
                best = row.max()
                if np.isfinite(best):
                    close[k - at], top[k - at] = int((row >= bound).sum()), float(best)
    return close, top


class Store:
    """An append-only table of batches in a folder: run=<stream>/epoch=<n>. A batch that is written again replaces itself, so a replay appends nothing."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType = SUBMISSION):
        self.spark, self.path, self.schema = spark, path, schema

    def append(self, batch: DataFrame, run: str, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.path}/run={run}/epoch={epoch}")

    def read(self) -> DataFrame:
        """All rows with run and epoch; empty where nothing was appended yet."""
        schema = T.StructType([*self.schema.fields, T.StructField("run", T.StringType()), T.StructField("epoch", T.LongType())])
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not root.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(root):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.path)

    def before(self, run: str, epoch: int) -> DataFrame:
        """All rows but those of this batch and later ones of its run."""
        return self.read().where((F.col("run") != run) | (F.col("epoch") < epoch))

    def count(self) -> int:
        return self.read().count()


def run_submissions(stream: DataFrame, store: Store, sink, checkpoint: str, run: str = "live", bound: float = 0.68):
    """Start the stream: each micro-batch is correlated with the store, handed to `sink(df, epoch)`, then appended to the store under its epoch. A replayed
    epoch sees the store as it was and replaces what it appended; `sink` gets the epoch to do likewise."""

    def each(batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()
        try:
            sink(correlate(batch, store.before(run, epoch), bound), epoch)
            store.append(batch, run, epoch)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()
