"""Coarsening of root themes: the nearest pair merges while its similarity is above one bar and the union's cohesion reaches it.

More than MAX_ROOTS themes are left as they are; `roots` then warns."""

from __future__ import annotations

import warnings

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Roots beyond this number are left as they are; at most so many sums meet in one task.
MAX_ROOTS = 512


def cohesion(total: np.ndarray, n: float) -> float:
    """Mean cosine of n unit vectors with the sum `total` to their centroid."""
    return float(np.linalg.norm(total)) / n if n else 0.0


def merge(sums: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Group number of each root. The bar is mean + std of the pair similarities of the centroids; a pair whose union is too
    loose is not tried again; fewer than two groups is no merge at all."""
    k = len(sums)
    apart = np.arange(k)
    if k < 3:
        return apart
    unit = lambda s: s / max(float(np.linalg.norm(s)), 1e-12)
    totals, n, group = [s.astype(float) for s in sums], [float(x) for x in sizes], apart.copy()
    sim = np.stack([unit(s) for s in totals])
    sim = sim @ sim.T
    upper = np.triu_indices(k, 1)
    bar = float(sim[upper].mean() + sim[upper].std())
    open_ = np.triu(np.ones((k, k), bool), 1)  # pairs of living groups that were not refused
    while True:
        a, b = divmod(int(np.argmax(np.where(open_, sim, -2.0))), k)
        if not open_[a, b] or sim[a, b] <= bar:
            break
        if cohesion(totals[a] + totals[b], n[a] + n[b]) < bar:
            open_[a, b] = False
            continue
        totals[a], n[a] = totals[a] + totals[b], n[a] + n[b]
        group[group == b] = a
        open_[b, :] = open_[:, b] = False
        sim[a, :] = sim[:, a] = [float(unit(totals[a]) @ unit(s)) for s in totals]
    found, number = np.unique(group, return_inverse=True)
    return number if len(found) > 1 else apart


def roots(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """key, root: the group of each theme, named by its smallest key; more than MAX_ROOTS themes stay apart."""
    sums = vectors.select(key, F.posexplode(vector).alias("pos", "v")).groupBy(key, "pos").agg(F.sum(F.col("v").cast("double")).alias("s"), F.count("*").alias("n"))
    rows = sums.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda x: x["s"]).alias("total"), F.max("n").alias("n"))
    if rows.count() > MAX_ROOTS:
        warnings.warn(f"more than {MAX_ROOTS} themes are not merged", stacklevel=2)
        return rows.select(key, F.col(key).alias("root"))
    kind = dict(rows.dtypes)[key]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key).reset_index(drop=True)
        group = merge(np.stack(pdf["total"].to_numpy()), pdf["n"].to_numpy())
        return pd.DataFrame({key: pdf[key], "root": pdf.groupby(group)[key].transform("min")})

    return rows.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(one, f"{key} {kind}, root {kind}")
