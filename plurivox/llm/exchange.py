"""Packed exchange: many (64-bit key, columns) entries of one numpy step travel as a few rows.

A step packs its entries by bucket: one row for each bucket with its entries' columns as binary blobs. Spark shuffles the
rows by bucket, and a grouped task answers all entries of its bucket with numpy. The number of buckets grows with the
number of input partitions, so a bucket's size stays bounded as the input grows; each step sends a key once (or once
for each holder that the operator needs), so a hot key brings a bucket at most that much from each step.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Buckets for each input partition.
PER_PARTITION = 8


def buckets_for(docs: DataFrame) -> int:
    return max(16, PER_PARTITION * docs.rdd.getNumPartitions())


def blob(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Slices values[cuts[i]:cuts[i + 1]] as binary cells, without a copy of each."""
    data = np.ascontiguousarray(values)
    return pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * data.itemsize).astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())]).cast(pa.binary())


def pack(keys: np.ndarray, buckets: int, *columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[pa.Array]]:
    """Bucket numbers that have entries, the order of entries by bucket, and the blobs of each column in that order."""
    at = (keys % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(at, kind="stable")
    sizes = np.bincount(at, minlength=buckets)
    full = np.flatnonzero(sizes)
    cuts = np.r_[0, np.cumsum(sizes[full])]
    return full.astype(np.int32), order, [blob(c[order], cuts) for c in columns]


def narrow(h: np.ndarray) -> np.ndarray:
    """The low 48 bits of hashes as six bytes each."""
    return np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8)[:, :6].copy().view("V6").ravel()


def wide(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def joined(cells: pa.ChunkedArray, dtype) -> np.ndarray:
    """All blobs of a column, one after the other."""
    return np.frombuffer(b"".join(c.as_py() or b"" for c in cells), dtype=dtype)
