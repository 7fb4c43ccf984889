"""Segmentation of texts into stretches about one thing, from the vectors of their units (words, lines, turns).

A text is one row with its units' vectors in order, so no step shuffles anything: signals and segmenters run over Arrow batches, one text after
the other, and only what calibrates them (means and deviations over all texts) is aggregated. A boundary p stands between the units p - 1 and p.
Similarities are compared at nine digits, so that equal ones tie everywhere. Texts with fewer than two least segments have no boundary; null or
empty unit lists count as texts without units.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import community

#: Units of the shortest segment.
LEAST = 3


# ---- one text as a numpy matrix --------------------------------------------------------------


def _unit(rows: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(size == 0, 1.0, size)


def _means(u: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Means of the units lo..hi - 1, from prefix sums."""
    sums = np.vstack([np.zeros((1, u.shape[1])), np.cumsum(u, axis=0)])
    return (sums[hi] - sums[lo]) / (hi - lo)[:, None]


def _cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row; 1 where a row is zero."""
    size = np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1)
    return np.round(np.where(size > 0, (a * b).sum(axis=1) / np.where(size > 0, size, 1.0), 1.0), 9)


def smooth(u: np.ndarray, width: int) -> np.ndarray:
    """Centred means over `width` units, of length 1; as it is for a width of 1 or at most two units."""
    n, half = len(u), width // 2
    if width <= 1 or n <= 2:
        return u
    at = np.arange(n)
    return _unit(_means(u, np.maximum(0, at - half), np.minimum(n, at + half + 1)))


def block_similarity(u: np.ndarray, width: int) -> np.ndarray:
    """Cosine of the `width` units before each boundary and those after it."""
    p, n = np.arange(1, len(u)), len(u)
    return _cosine(_means(u, np.maximum(0, p - width), p), _means(u, p, np.minimum(n, p + width))) if n > 1 else np.zeros(0)


def novelty(u: np.ndarray, width: int) -> np.ndarray:
    """Cosine of each smoothed unit from the second on and the centroid of all before it."""
    s = _unit(smooth(u, width))
    n = len(s)
    if n < 2:
        return np.zeros(0)
    centre = np.cumsum(s, axis=0)[:-1] / np.arange(1, n)[:, None]
    size = np.linalg.norm(centre, axis=1)
    return np.round(np.where(size > 0, (s[1:] * centre).sum(axis=1) / np.where(size > 0, size, 1.0), 1.0), 9)


def spaced(places: np.ndarray, scores: np.ndarray, n: int, least: int) -> list[int]:
    """Boundaries by falling score (ties by place), each at least `least` units from the ends and from those taken before it."""
    taken: list[int] = []
    for k in np.lexsort((places, -scores)):
        p = int(places[k])
        if least <= p <= n - least and all(abs(p - q) >= least for q in taken):
            taken.append(p)
    return sorted(taken)


def tiling(u: np.ndarray, width: int, cut: float, mean: float, least: int = LEAST) -> list[int]:
    """Spaced local minima of the block similarity below `cut`."""
    n = len(u)
    if n < 2 * least:
        return []
    s = block_similarity(u, width)
    low = (s <= np.r_[np.inf, s[:-1]]) & (s <= np.r_[s[1:], np.inf]) & (s < cut)
    at = np.flatnonzero(low)
    return spaced(at + 1, np.round(mean - s[at], 9), n, least)


def live(u: np.ndarray, width: int, cut: float, least: int = LEAST) -> list[int]:
    """A boundary where a unit's cosine with the centroid of its segment so far falls below `cut`, at least `least` units after the last and before the end."""
    n = len(u)
    if n < 2 * least:
        return []
    s, out, begin = _unit(smooth(u, width)), [], 0
    total = s[0].copy()
    for i in range(1, n):
        centre = total / (i - begin)
        size = np.linalg.norm(centre)
        near = round(float(s[i] @ centre / size), 9) if size else 1.0
        if near < cut and i - begin >= least and n - i >= least:
            out.append(i)
            begin, total = i, s[i].copy()
        else:
            total += s[i]
    return out


def change_points(u: np.ndarray, width: int, penalty: float, least: int = LEAST) -> list[int]:
    """The segments of least summed squared distance to their means plus `penalty` for each boundary, none shorter than `least`; fewer and earlier
    boundaries at equal cost. Dynamic programming over prefix sums; beginnings that can no longer win are dropped."""
    n = len(u)
    if n < 2 * least:
        return []
    s = smooth(u, width)
    sums = np.vstack([np.zeros((1, s.shape[1])), np.cumsum(s, axis=0)])
    squares = np.r_[0.0, np.cumsum((s * s).sum(axis=1))]

    def cost(begins: np.ndarray, end: int) -> np.ndarray:
        d = sums[end] - sums[begins]
        return squares[end] - squares[begins] - (d * d).sum(axis=1) / (end - begins)

    best, back = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
    best[0] = -penalty
    begins = np.array([0])
    for end in range(least, n + 1):
        through = best[begins] + cost(begins, end) + penalty
        k = int(np.argmin(np.round(through, 9)))
        best[end], back[end] = through[k], begins[k]
        begins = np.append(begins[through - penalty <= best[end] + 1e-9], end - least + 1)
        begins = begins[np.isfinite(best[begins])]
    out, at = [], int(back[n])
    while at > 0:
        out.append(at)
        at = int(back[at])
    return out[::-1]


def runs_merged(labels: np.ndarray, least: int = LEAST) -> list[int]:
    """Boundaries between runs of equal labels once each run shorter than `least` has joined its longer neighbour (the left of equals), the shortest and
    first run at a time."""
    n = len(labels)
    if n < 2 * least:
        return []
    starts = [0, *(np.flatnonzero(np.diff(labels)) + 1).tolist()]
    runs = [[a, b, labels[a]] for a, b in zip(starts, [*starts[1:], n])]
    while len(runs) > 1:
        k = min(range(len(runs)), key=lambda i: (runs[i][1] - runs[i][0], i))
        a, b, _ = runs[k]
        if b - a >= least:
            break
        to = k + 1 if k == 0 else k - 1 if k == len(runs) - 1 else max(k - 1, k + 1, key=lambda i: (runs[i][1] - runs[i][0], -i))
        lo, hi = min(k, to), max(k, to)
        runs[lo : hi + 1] = [[runs[lo][0], runs[hi][1], runs[to][2]]]
        for i in (lo, lo - 1):  # neighbours of one label are one run now
            if 0 <= i < len(runs) - 1 and runs[i][2] == runs[i + 1][2]:
                runs[i : i + 2] = [[runs[i][0], runs[i + 1][1], runs[i][2]]]
    return [r[0] for r in runs[1:]]


def neighbours(u: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """a < b, cosine: each unit with its k nearest others (ties to the earlier), each pair once."""
    s, n = _unit(u), len(u)
    found: dict[tuple[int, int], float] = {}
    for at in range(0, n, 256):
        c = np.round(s[at : at + 256] @ s.T, 9)
        c[np.arange(len(c)), np.arange(at, at + len(c))] = -np.inf
        near = np.argsort(-c, axis=1, kind="stable")[:, : min(k, n - 1)]
        for i, row in enumerate(near):
            for j in row.tolist():
                found[min(at + i, j), max(at + i, j)] = float(c[i, j])
    pairs = sorted(found)
    a, b = np.array(pairs, np.int64).reshape(-1, 2).T
    return a, b, np.array([found[p] for p in pairs])


def unit_graph(n: int, links: tuple[np.ndarray, np.ndarray, np.ndarray], cut: float, alpha: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links at `cut` or above, and `alpha` more between neighbours in the text."""
    a, b, w = links
    kept = w >= cut
    pair = np.r_[a[kept] * n + b[kept], np.arange(n - 1) * n + np.arange(1, n)]
    pairs, at = np.unique(pair, return_inverse=True)
    total = np.bincount(at, np.r_[w[kept], np.full(n - 1, alpha)], len(pairs))
    some = total > 0
    return pairs[some] // n, pairs[some] % n, total[some]


def by_graph(u: np.ndarray, k: int, cut: float, alpha: float, gamma: float, least: int = LEAST) -> list[int]:
    """Boundaries between the communities of the unit graph, short runs merged."""
    n = len(u)
    if n < 2 * least:
        return []
    a, b, w = unit_graph(n, neighbours(u, k), cut, alpha)
    x, y, z = np.r_[a, b], np.r_[b, a], np.r_[w, w]
    order = np.lexsort((y, x))
    degree = np.bincount(x, z, n)
    return runs_merged(community.multilevel(x[order], y[order], z[order], degree, gamma / max(z.sum(), 1e-300)), least)


# ---- all texts -------------------------------------------------------------------------------


def _each(texts: DataFrame, key: str, units: str, out: str, kind: str, body: Callable[[np.ndarray], list]) -> DataFrame:
    """key, `out`: `body` of each text's unit vectors."""
    schema = T.StructType([texts.schema[key], T.StructField(out, T._parse_datatype_string(kind))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = batch.column(1)
            flat = cells.flatten()
            width = len(flat.flatten()) // max(1, len(flat))
            rows = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), max(1, width) if len(flat) else 1)
            ends = np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(cells), 0).to_numpy(zero_copy_only=False))
            found = [body(rows[a:b]) for a, b in zip(np.r_[0, ends[:-1]], ends)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32() if "int" in kind else pa.float64()))], names=[key, out])

    return texts.select(key, F.col(units).cast("array<array<double>>").alias(units)).mapInArrow(run, schema)


def similarities(texts: DataFrame, key: str, units: str, width: int) -> DataFrame:
    """key, similarity array<double>: the block similarity at each boundary."""
    return _each(texts, key, units, "similarity", "array<double>", lambda u: block_similarity(u, width).tolist())


def novelties(texts: DataFrame, key: str, units: str, width: int) -> DataFrame:
    """key, novelty array<double>: each unit against all before it, the units smoothed over half of `width`."""
    return _each(texts, key, units, "novelty", "array<double>", lambda u: novelty(u, max(1, width // 2)).tolist())


def calibration(signals: DataFrame, signal: str) -> tuple[float, float]:
    """Mean and standard deviation of a signal over all texts; 1 and a little where there is none or it never differs."""
    row = signals.select(F.explode(signal).alias("x")).agg(F.avg("x"), F.stddev_pop("x")).first()
    return (1.0 if row[0] is None else row[0]), row[1] or 1e-6


def by_tiling(texts: DataFrame, key: str, units: str, width: int, depth: float, least: int = LEAST) -> DataFrame:
    """key, boundaries: minima of the block similarity more than `depth` deviations below the mean over all texts."""
    mean, deviation = calibration(similarities(texts, key, units, width), "similarity")
    return _each(texts, key, units, "boundaries", "array<int>", lambda u: tiling(u, width, round(mean - depth * deviation, 9), mean, least))


def by_centroid(texts: DataFrame, key: str, units: str, width: int, depth: float, least: int = LEAST) -> DataFrame:
    """key, boundaries: units more than `depth` deviations less like their segment so far than units are like what precedes them."""
    mean, deviation = calibration(novelties(texts, key, units, width), "novelty")
    return _each(texts, key, units, "boundaries", "array<int>", lambda u: live(u, max(1, width // 2), round(mean - depth * deviation, 9), least))


def by_change(texts: DataFrame, key: str, units: str, width: int, penalty: float, least: int = LEAST) -> DataFrame:
    """key, boundaries: the segmentation of least squared distance with a penalty for each boundary, over units of length 1."""
    return _each(texts, key, units, "boundaries", "array<int>", lambda u: change_points(_unit(u), max(1, width // 2), penalty, least))


def by_communities(texts: DataFrame, key: str, units: str, k: int, alpha: float, gamma: float, depth: float = 1.0, least: int = LEAST) -> DataFrame:
    """key, boundaries: runs of the communities of each text's unit graph, whose links are at least `depth` deviations below the mean of all texts' links."""
    pool = _each(texts, key, units, "w", "array<double>", lambda u: neighbours(u, k)[2].tolist() if len(u) > 1 else [])
    mean, deviation = calibration(pool, "w")
    return _each(texts, key, units, "boundaries", "array<int>", lambda u: by_graph(u, k, mean - depth * deviation, alpha, gamma, least))


def matched(truth: list[int], found: list[int], tolerance: int = 1) -> tuple[int, int, int]:
    """Boundaries hit, found in vain and missed: each true one takes the nearest unused one within `tolerance` (the earlier of equals)."""
    left, hit = sorted(set(found)), 0
    for t in sorted(set(truth)):
        near = [f for f in left if abs(f - t) <= tolerance]
        if near:
            left.remove(min(near, key=lambda f: (abs(f - t), f)))
            hit += 1
    return hit, len(left), len(set(truth)) - hit


def scorecard(rows: DataFrame, truth: str, found: str, tolerance: int = 1) -> DataFrame:
    """One row over texts with true and found boundaries: precision, recall, f1 within `tolerance`, the share of texts without a true boundary that got one, and
    the mean number of boundaries found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [matched(t or [], f or [], tolerance) for t, f in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([g[k] for g in got], pa.int64()) for k in range(3)], names=["hit", "vain", "missed"])

    counts = rows.select(F.col(truth).cast("array<int>").alias("t"), F.col(found).cast("array<int>").alias("f")).mapInArrow(run, "hit long, vain long, missed long")
    plain = (F.col("hit") + F.col("missed")) == 0
    s = counts.agg(F.sum("hit").alias("h"), F.sum("vain").alias("v"), F.sum("missed").alias("m"), F.count_if(plain).alias("plain"), F.count_if(plain & (F.col("vain") > 0)).alias("cut"), F.avg(F.col("hit") + F.col("vain")).alias("mean"))
    ratio = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    h, v, m = F.col("h"), F.col("v"), F.col("m")
    return s.select(ratio(h, h + v).alias("precision"), ratio(h, h + m).alias("recall"), ratio(2 * h, 2 * h + v + m).alias("f1"), ratio(F.col("cut"), F.col("plain")).alias("whole_cut"), F.round("mean", 6).alias("mean_cuts"))
