"""Helpers shared by the operators of this package: tables in the shared folder, and words as numpy arrays."""

from __future__ import annotations

import ctypes
import hashlib
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one numpy step holds; a longer single text is a step of its own.
STEP_BYTES = 2 << 20
#: Bytes of an Arrow batch between Spark and Python.
BATCH_BYTES = 8 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new temporary one where it is unset and Spark is local."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="plurivox-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of at most about BATCH_BYTES for what runs inside: rows are long here, and Spark's own bound is 64 MB a task and side."""
    before = spark.conf.get(_BATCH_CONF, None)
    spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_BATCH_CONF)
        else:
            spark.conf.set(_BATCH_CONF, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written once to the shared folder and read back: cuts lineage, survives lost executors."""
    return Tables(df.sparkSession, name).write(df, "table")


class Tables:
    """Tables of one job in a folder of the shared folder, which `drop` deletes with all of them; `small`: written with small Arrow batches."""

    def __init__(self, spark: SparkSession, name: str, small: bool = False):
        self.spark, self.count, self.small = spark, 0, small
        self.folder = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str, **options: object) -> DataFrame:
        self.count += 1
        path = f"{self.folder}/{self.count}-{name}"
        with small_batches(self.spark) if self.small else nullcontext():
            df.write.options(**options).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets the driver drop what ended jobs have left: Spark deletes shuffle files and broadcasts when their plans are collected."""
    spark._jvm.System.gc()


#: Ids that are broadcast at most; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000


def unused(columns: list[str], name: str) -> str:
    """`name` with as many lines before it as it takes to be none of `columns`, in whatever case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def without_ids(docs: DataFrame, ids: DataFrame, name: str = "doc_id") -> DataFrame:
    """The rows of `docs` whose id (column `name` of both) is none of `ids`; a null id is an id here."""
    gone = unused(docs.columns, "_gone")
    ids = ids.select(F.col(name).alias(gone))
    side = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return docs.join(side, docs[name].eqNullSafe(F.col(gone)), "left_anti")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---- words of Arrow batches as numpy arrays -------------------------------------------------

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of words [^\x20\x09-\x0D]+; UTF-8 keeps every byte of longer characters above 0x7F.
NON_SPACE = np.ones(256, dtype=bool)
NON_SPACE[[9, 10, 11, 12, 13, 32]] = False
_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [(1 << 64) - 1], dtype=np.uint64)
_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _K[1]
    h = (h ^ (h >> np.uint64(27))) * _K[2]
    return h ^ (h >> np.uint64(31))


def steps(batches: Iterator[pa.RecordBatch], text: str | int = "text", size: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of `batches` in slices of at most about `size` bytes of text."""
    for batch in batches:
        col = batch.column(text)
        if not len(col):
            continue
        sizes = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes, dtype=np.int64) // size
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(col)]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)
    trim()


def trim() -> None:
    """Gives freed memory back to the system, for Spark keeps idle Python workers beside the next stages."""
    pa.default_memory_pool().release_unused()
    give = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give:
        give(0)


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows; a null row is empty."""
    if pa.types.is_large_string(col.type):
        width = np.int64
    else:
        width = np.int32
        if not pa.types.is_string(col.type):
            col = col.cast(pa.string())
    if col.null_count:
        col = pc.fill_null(col, "")
    _, offs, data = col.buffers()
    offsets = np.frombuffer(offs, dtype=width)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """Words of a slice of rows. `buf` bytes, `starts` and `ends` of each word, `first` n + 1 word offsets of the rows, `hash` 64 bits a word."""

    def __init__(self, col: pa.Array, lower: bool = True, chars: np.ndarray = NON_SPACE):
        raw, offsets = utf8(col)
        self.buf = buf = _LOWER[raw] if lower else raw
        self.offsets = offsets
        inside = chars[buf]
        s, e = inside.copy(), inside.copy()
        if len(buf):
            s[1:] &= ~inside[:-1]
            e[:-1] &= ~inside[1:]
            edge = offsets[offsets < len(buf)]
            s[edge] = inside[edge]
            edge = offsets[offsets > 0] - 1
            e[edge] = inside[edge]
        self.starts, self.ends = np.flatnonzero(s), np.flatnonzero(e) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))

    @property
    def hash(self) -> np.ndarray:
        if not hasattr(self, "_hash"):
            self._hash = hash_spans(self.buf, self.starts, self.ends)
        return self._hash


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, eight bytes at a time for all spans together."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.as_strided(padded.view(), shape=(len(buf) + 1, 8), strides=(1, 1))
    lens = ends - starts
    h = lens.astype(np.uint64) * _K[0] + _K[3]
    live, at, left = None, starts, lens
    while len(at):
        part = np.ascontiguousarray(eight[at]).view(np.uint64).ravel() & _MASKS[np.minimum(left, 8)]
        if live is None:
            h = mix(h ^ (part * _K[3] + _K[0]))
            live = np.flatnonzero(left > 8)
        else:
            h[live] = mix(h[live] ^ (part * _K[3] + _K[0]))
            live = live[left > 8]
        more = left > 8
        at, left = at[more] + 8, left[more] - 8
    return h


_SPREAD = mix(np.arange(1, 65, dtype=np.uint64) * _K[0]) | np.uint64(1)


def window_hash(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of `width` consecutive word hashes, for each start; the caller keeps starts whose window stays in one row."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n] * _SPREAD[0]
    for j in range(1, width):
        out += h[j : j + n] * _SPREAD[j % 64] + np.uint64(j)
    return mix(out)


def window_ok(words: Words, width: int) -> np.ndarray:
    """Which starts of window_hash stay in one row."""
    n = len(words.starts) - width + 1
    return words.doc[:n] == words.doc[width - 1 :] if n > 0 else np.zeros(0, bool)


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
