"""How far partitions hold: resamples against each other, levels against chance, and shapes of trees after deletions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import community
from .ordering import numbered

Checkpoint = Callable[[DataFrame], DataFrame]
#: Shuffles of a partition that stand for chance.
SHUFFLES = 3


def sampled(node: str, seed: int, share: float):
    """Whether a node is in the resample `seed`: by a hash, so alike on every cluster and in every pass."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col(node)), F.lit(1 << 20)) < int(share * (1 << 20))


def resampled(links: DataFrame, share: float, seeds: range, checkpoint: Checkpoint, gamma: float = 1.0) -> DataFrame:
    """run, node, label: communities of the subgraphs induced by resamples of the nodes, all in one go."""
    runs = F.filter(F.array(*(F.when(sampled("a", s, share) & sampled("b", s, share), F.lit(s).cast("long")) for s in seeds)), lambda x: x.isNotNull())
    graphs = links.select("a", "b", "w", F.explode(runs).alias("run"))
    return community.partition(graphs.select("run", "a", "b", "w", F.lit(float(gamma)).alias("gamma")), checkpoint)


def agreement(labels: DataFrame) -> DataFrame:
    """one, other, common, ari of every two runs of `labels` (run, node, label) on the nodes they share: one contingency count over all pairs of runs.
    Pairs of runs that share fewer than two nodes are left out; two partitions that leave nothing to chance agree (1)."""
    each = labels.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("run", "label"))).alias("ls"))  # as many as there are runs
    firsts = each.select("ls", F.posexplode("ls").alias("i", "x"))
    cells = firsts.select(F.col("x.run").alias("one"), F.col("x.label").alias("p"), F.explode(F.slice("ls", F.col("i") + 2, F.size("ls"))).alias("y"))
    table = cells.groupBy("one", F.col("y.run").alias("other"), "p", F.col("y.label").alias("q")).agg(F.count("*").alias("n"))
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    keys = ["one", "other"]
    both = table.groupBy(*keys).agg(pairs("n").alias("both"), F.sum("n").alias("common"))
    rows = table.groupBy(*keys, "p").agg(F.sum("n").alias("n")).groupBy(*keys).agg(pairs("n").alias("rows"))
    cols = table.groupBy(*keys, "q").agg(F.sum("n").alias("n")).groupBy(*keys).agg(pairs("n").alias("cols"))
    s = both.join(rows, keys).join(cols, keys).where("common >= 2")
    expected = F.col("rows") * F.col("cols") / (F.col("common") * (F.col("common") - 1) / 2)
    most = (F.col("rows") + F.col("cols")) / 2
    return s.select(*keys, "common", F.round(F.when(most == expected, 1.0).otherwise((F.col("both") - expected) / (most - expected)), 6).alias("ari"))


def nestedness(fine: DataFrame, coarse: DataFrame) -> float:
    """Share of nodes (node, label) whose fine community's nodes mostly lie in one coarse community with them."""
    table = fine.select("node", F.col("label").alias("f")).join(coarse.select("node", F.col("label").alias("c")), "node").groupBy("f", "c").agg(F.count("*").alias("n"))
    row = table.groupBy("f").agg(F.max("n").alias("m"), F.sum("n").alias("n")).agg(F.sum("m"), F.sum("n")).first()
    return row[0] / row[1] if row[1] else 0.0


def shuffles(labels: DataFrame, seeds: range, checkpoint: Checkpoint) -> list[DataFrame]:
    """node, label of each seed, the labels dealt to other nodes: the k-th node gets the label of the k-th in the order of a hash. The nodes are numbered once."""
    places = numbered(labels.select("node"), ["node"], "place", checkpoint)
    dealt = (numbered(labels.select("node", "label"), [F.xxhash64(F.lit(seed), F.col("node")), F.col("node")], "place", checkpoint) for seed in seeds)
    return [places.join(d.select("place", "label"), "place").select("node", "label") for d in dealt]


def shuffled(labels: DataFrame, seed: int, checkpoint: Checkpoint) -> DataFrame:
    return shuffles(labels, range(seed, seed + 1), checkpoint)[0]


def cleanliness(fine: DataFrame, coarse: DataFrame, checkpoint: Checkpoint, chances: list[DataFrame] | None = None) -> float:
    """Nestedness as the share of what chance leaves: 1 for a clean nesting, 0 for that of shuffled labels (`chances`: of `coarse`, where they are at hand)."""
    seen = nestedness(fine, coarse)
    chances = chances or shuffles(coarse, range(SHUFFLES), checkpoint)
    chance = sum(nestedness(fine, c) for c in chances) / len(chances)
    return (seen - chance) / max(1 - chance, 1e-9)


def chain(neighbours: DataFrame, ks: list[int], threshold: float, checkpoint: Checkpoint, step: float = 2.0, gamma: float = 1.0) -> DataFrame:
    """level, k, n_communities, cleanliness from fine to coarse. `neighbours` (src, dst, cosine, rank) hold the largest k: the graphs of smaller ones are its
    prefixes, and all are clustered in one go. Of the partitions of equal size that of the smallest k stands; each level is followed by the
    cleanest of those with at least `step` times fewer communities (of equals the finer one)."""
    runs = F.filter(F.array(*(F.when(F.col("rank") <= k, F.lit(k).cast("long")) for k in ks)), lambda x: x.isNotNull())
    kept = neighbours.where(F.col("cosine") >= threshold).select("src", "dst", "cosine", F.explode(runs).alias("run"))
    graphs = kept.groupBy("run", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.max("cosine").alias("w"))
    labels = checkpoint(community.partition(graphs.select("run", "a", "b", "w", F.lit(float(gamma)).alias("gamma")), checkpoint))
    counts = {r["run"]: r["n"] for r in labels.groupBy("run").agg(F.count_distinct("label").alias("n")).collect()}
    sizes: dict[int, int] = {}
    for k in sorted(counts):
        sizes.setdefault(counts[k], k)
    part = lambda k: labels.where(F.col("run") == k).select("node", "label")
    levels = sorted(sizes.items(), reverse=True)
    rows = [(0, levels[0][1], levels[0][0], 1.0)] if levels else []
    chances: dict[int, list[DataFrame]] = {}
    while rows:
        _, k, n, _ = rows[-1]
        below = [(size, q) for size, q in levels if size <= n / step]
        for _, q in below:
            if q not in chances:  # once a partition, whichever finer ones it meets
                chances[q] = [checkpoint(c) for c in shuffles(part(q), range(SHUFFLES), checkpoint)]
        options = [(round(cleanliness(part(k), part(q), checkpoint, chances[q]), 6), size, q) for size, q in below]
        if not options:
            break
        clean, size, q = max(options, key=lambda o: (o[0], o[1]))
        rows.append((len(rows), q, size, clean))
    return neighbours.sparkSession.createDataFrame(rows, "level int, k long, n_communities long, cleanliness double")


def shape(nodes: DataFrame, orphan: int = 5) -> DataFrame:
    """One row over `nodes` (node, macro, leaf): macros, leaves, depth, the share of macros with several leaves, the median leaf, and leaves of fewer than `orphan`."""
    leaves = nodes.groupBy("macro", "leaf").agg(F.count("*").alias("n"))
    macros = leaves.groupBy("macro").agg(F.count("*").alias("k")).agg(F.count("*").alias("macros"), F.round(F.avg((F.col("k") > 1).cast("double")), 6).alias("structured"), F.max(F.when(F.col("k") > 1, 2).otherwise(1)).alias("depth"))
    sizes = leaves.agg(F.count("*").alias("leaves"), F.percentile("n", 0.5).alias("median_leaf"), F.count_if(F.col("n") < orphan).alias("orphans"))
    return macros.crossJoin(F.broadcast(sizes))  # two single rows
