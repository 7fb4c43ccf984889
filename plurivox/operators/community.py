"""Communities of weighted graphs by modularity with a resolution: local moving, contraction, repetition.

Many graphs (`run`) are clustered at once: the resolutions of a sweep, or the induced subgraphs of all macro communities. A node moves to
the neighbouring community of largest gain w(node, c) - gamma * k(node) * K(c) / 2m. A graph of at most `BLOCK_ARCS` arcs is
clustered whole by one task. A larger one first goes through distributed levels: its nodes are dealt to blocks of
bounded size, each block settles its nodes in turn against frozen labels outside, three of four nodes a round, and nodes with more than
`HUB` arcs move by grouped sums instead of in a block, half of them a round; when modularity hardly rises the graph is contracted to its communities,
and so on until it fits a block or nothing merges; at the end the nodes themselves go through such rounds again. Each round and level is a table in the shared folder.

Results depend on the graph alone, not on the order of its rows: nodes are visited in an order drawn from a fixed seed. Labels are the
smallest node of each community. Nodes are longs; links are a < b with w > 0, each pair once; nodes without links are not in the result.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vector

#: Arcs (two a link) that one task clusters, and about as many a block of a larger graph holds.
BLOCK_ARCS = 1_000_000
#: Arcs beyond which a node of a large graph moves by grouped sums.
HUB = 20_000
#: Distributed rounds of one level; the best labels so far are kept.
MOST_ROUNDS = 24
#: Share of the modularity that a round must add, or else, the second time in a row, the level ends and its contracted graph goes on.
ENOUGH = 0.01
#: Orders of the nodes that a whole graph is clustered from.
STARTS = 2
#: Resolutions of a sweep.
GAMMAS = (0.2, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 3.0)

Checkpoint = Callable[[DataFrame], DataFrame]


# ---- numpy, inside one task ------------------------------------------------------------------


def settle(first: np.ndarray, near: np.ndarray, w: np.ndarray, k: np.ndarray, scale: float, label: np.ndarray, total: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Labels after local moving: the nodes of `order` move while one gains. `near` are places in `label`, which may go beyond the nodes
    of `first`: those are frozen. `total` holds the summed degrees by label. Equal gains go to the smaller label."""
    first, near, w, k, label, total = first.tolist(), near.tolist(), w.tolist(), k.tolist(), label.tolist(), total.tolist()
    movable = [False] * len(label)
    for i in order:
        movable[i] = True
    queue, waiting = deque(order.tolist()), list(movable)
    ends = [near[a:b] for a, b in zip(first, first[1:])]
    weights = [w[a:b] for a, b in zip(first, first[1:])]
    while queue:
        i = queue.popleft()
        waiting[i] = False
        own, pull = label[i], k[i] * scale
        sums = {own: 0.0}
        for j, x in zip(ends[i], weights[i]):
            c = label[j]
            if c in sums:
                sums[c] += x
            else:
                sums[c] = x
        best, most = own, sums[own] - pull * (total[own] - k[i])
        floor = most + 1e-12
        for c, s in sums.items():
            gain = s - pull * total[c]
            if c != own and (gain > max(most, floor) or (gain == most > floor and c < best)):
                best, most = c, gain
        if best != own:
            total[own] -= k[i]
            total[best] += k[i]
            label[i] = best
            for j in ends[i]:
                if movable[j] and not waiting[j] and label[j] != best:
                    waiting[j] = True
                    queue.append(j)
    return np.array(label[: len(first) - 1])


def _rows(a: np.ndarray, n: int) -> np.ndarray:
    return np.searchsorted(a, np.arange(n + 1))


def contract(a: np.ndarray, b: np.ndarray, w: np.ndarray, k: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Arcs and degrees of the communities (labels from 0 without gaps); arcs inside a community live on in its degree."""
    n = int(label.max()) + 1
    pair = label[a] * n + label[b]
    kept = label[a] != label[b]
    pairs, at = np.unique(pair[kept], return_inverse=True)
    return pairs // n, pairs % n, np.bincount(at, w[kept], len(pairs)), np.bincount(label, k, n)


def quality(a: np.ndarray, b: np.ndarray, w: np.ndarray, k: np.ndarray, label: np.ndarray, scale: float) -> float:
    """Modularity times 2m: weight of the arcs inside communities, less what their degrees let expect; arcs of a node with itself are left out."""
    return float(w[label[a] == label[b]].sum() - scale * (np.bincount(label, k) ** 2).sum())


def _dense(label: np.ndarray) -> np.ndarray:
    return np.unique(label, return_inverse=True)[1]


def _cycle(a: np.ndarray, b: np.ndarray, w: np.ndarray, k: np.ndarray, scale: float, start: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Labels after moving, refining and contracting until nothing merges. Each community is first split into parts that hold together
    on their own, and the parts, not the communities, become the nodes of the next level; so a level can still take a community apart."""
    at, label = np.arange(len(k)), start
    while True:
        n = len(k)
        label = _dense(settle(_rows(a, n), b, w, k, scale, label, np.bincount(label, k, n), rng.permutation(n)))
        inner = label[a] == label[b]
        part = _dense(settle(_rows(a[inner], n), b[inner], w[inner], k, scale, np.arange(n), k, rng.permutation(n)))
        if part.max() + 1 == n:
            return label[at]
        over = np.zeros(part.max() + 1, np.int64)
        over[part] = label
        a, b, w, k = contract(a, b, w, k, part)
        at, label = part[at], over


def multilevel(a: np.ndarray, b: np.ndarray, w: np.ndarray, k: np.ndarray, scale: float, starts: range = range(STARTS)) -> np.ndarray:
    """Labels (from 0 without gaps) of a graph of arcs sorted by (a, b): from each of the orders `starts` of the nodes, cycles while modularity rises; the
    best of them."""
    best, most = np.arange(len(k)), quality(a, b, w, k, np.arange(len(k)), scale)
    for seed in starts:
        rng, label, had = np.random.default_rng(seed), np.arange(len(k)), -np.inf
        while True:
            label = _cycle(a, b, w, k, scale, label, rng)
            now = quality(a, b, w, k, label, scale)
            if now > most + 1e-12:
                best, most = label, now
            if now <= had + 1e-9 * max(1.0, abs(had)):
                break
            had = now
    return _dense(best)


# ---- one task a graph or block ---------------------------------------------------------------

_MOVED = "run long, node long, label long"


def _column(t: pa.Table, name: str) -> np.ndarray:
    return t[name].combine_chunks().to_numpy(zero_copy_only=False)


def _meet(df: DataFrame, other: DataFrame, on: list[str] | str, how: str = "inner") -> DataFrame:
    """A join of two tables that grow with the graph: by a shuffle, so that neither goes through the driver."""
    return df.join(other.hint("merge"), on, how)


def _apart(df: DataFrame) -> DataFrame:
    """`df` with columns of its own, so that it can meet a frame it shares an ancestor with."""
    return df.select(*(F.col(c).alias(c) for c in df.columns))


def _result(run: int, node: np.ndarray, label: np.ndarray) -> pa.Table:
    return pa.table({"run": np.full(len(node), run, np.int64), "node": node, "label": label.astype(np.int64)})


def _whole(nodes: pa.Table, arcs: pa.Table) -> pa.Table:
    """A whole graph from one order of its nodes, and the quality of what was found; labels are its own nodes."""
    order = np.argsort(_column(nodes, "node"), kind="stable")
    ids, k = _column(nodes, "node")[order], _column(nodes, "k")[order]
    if not len(ids):
        return _found(_result(0, ids.astype(np.int64), ids), 0, 0.0)
    a, b = np.searchsorted(ids, _column(arcs, "a")), np.searchsorted(ids, _column(arcs, "b"))
    by = np.lexsort((b, a))
    a, b, w, scale, start = a[by], b[by], _column(arcs, "w")[by], float(nodes["scale"][0].as_py()), nodes["start"][0].as_py()
    label = multilevel(a, b, w, k, scale, range(start, start + 1))
    least = np.full(label.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, label, ids)
    return _found(_result(nodes["run"][0].as_py(), ids, least[label]), start, quality(a, b, w, k, label, scale))


def _found(labels: pa.Table, start: int, value: float) -> pa.Table:
    n = labels.num_rows
    return labels.append_column("start", pa.array(np.full(n, start, np.int32))).append_column("quality", pa.array(np.full(n, value)))


_CELL = "run long, block int, scale double, double_m double, ids binary, k binary, outside binary, first binary, near binary, w binary"
_SENT = "run long, block int, nodes binary, labels binary, totals binary, lone binary"


def _cell(nodes: pa.Table, arcs: pa.Table) -> pa.Table:
    """A block of a larger graph as one row: its nodes, those outside that they touch, and its arcs as places in both."""
    order = np.argsort(_column(nodes, "node"), kind="stable")
    ids, k = _column(nodes, "node")[order], _column(nodes, "k")[order]
    by = np.lexsort((_column(arcs, "b"), _column(arcs, "a")))
    a, b, w = (_column(arcs, c)[by] for c in ("a", "b", "w"))
    own = np.isin(b, ids)
    outside, at = np.unique(b[~own], return_inverse=True)
    near = np.zeros(len(b), np.int64)
    near[own], near[~own] = np.searchsorted(ids, b[own]), len(ids) + at
    first = _rows(np.searchsorted(ids, a), len(ids))
    cells = {c: pa.array([x.tobytes()], pa.binary()) for c, x in {"ids": ids, "k": k, "outside": outside, "first": first, "near": near.astype(np.int32), "w": w}.items()}
    one = {c: nodes[c][:1] for c in ("run", "block", "scale", "double_m")}
    return pa.table(one | cells).slice(0, nodes.num_rows)


def _sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes with their label, its total and whether they are alone in it, packed for each of the blocks that touch them."""
    for batch in batches:
        run, node, label, total = (batch[c].to_numpy() for c in ("run", "node", "label", "total"))
        lone = batch["k"].to_numpy() == total
        to, row = batch["to"].flatten().to_numpy(), np.repeat(np.arange(batch.num_rows), pc.list_value_length(batch["to"]).to_numpy())
        order = np.lexsort((to, run[row]))
        to, row = to[order], row[order]
        cuts = np.flatnonzero(np.append(True, (np.diff(to) != 0) | (np.diff(run[row]) != 0)))
        parts = np.split(row, cuts[1:]) if len(row) else []
        yield pa.RecordBatch.from_arrays(
            [pa.array([int(run[p[0]]) for p in parts], pa.int64()), pa.array([int(to[c]) for c in cuts[: len(parts)]], pa.int32()), *(pa.array([x[p].tobytes() for p in parts], pa.binary()) for x in (node, label, total, lone))],
            names=["run", "block", "nodes", "labels", "totals", "lone"],
        )


def _unpacked(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in column])


def _moves(ids: np.ndarray, turn: int) -> np.ndarray:
    """Whose turn it is: three of four nodes, others each time."""
    x = (ids.astype(np.uint64) + np.uint64(turn + 1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(32))) & np.uint64(3) != 0


def _part(turn: int, cell: pa.Table, sent: pa.Table) -> pa.Table:
    """The nodes of a block after a round: nodes outside it, and those whose turn it is not, keep their labels. `quality` of the first
    row is the block's share of the modularity before the round."""
    if not cell.num_rows:
        return _result(0, np.zeros(0, np.int64), np.zeros(0, np.int64)).append_column("quality", pa.array(np.zeros(0)))
    ids, outside, first = (_unpacked(cell[c], np.int64) for c in ("ids", "outside", "first"))
    near, k, w = _unpacked(cell["near"], np.int32), _unpacked(cell["k"], np.float64), _unpacked(cell["w"], np.float64)
    scale = cell["scale"][0].as_py()
    nodes = _unpacked(sent["nodes"], np.int64)
    order = np.argsort(nodes)
    at = order[np.searchsorted(nodes, np.concatenate([ids, outside]), sorter=order)]
    seen = _unpacked(sent["totals"], np.float64)[at]
    labels, dense = np.unique(_unpacked(sent["labels"], np.int64)[at], return_inverse=True)
    total = np.zeros(len(labels))
    total[dense] = seen
    inside = w[np.repeat(dense[: len(ids)], np.diff(first)) == dense[near]].sum()
    value = np.zeros(len(ids))
    value[0] = (inside - scale * (k * seen[: len(ids)]).sum()) / cell["double_m"][0].as_py()
    moved = settle(first, near, w, k, scale, dense, total, np.random.default_rng(42).permutation(np.flatnonzero(_moves(ids, turn))))
    # two lone nodes of different blocks must not swap labels: only the one of the larger label goes
    alone, ours, had = np.zeros(len(labels), bool), np.zeros(len(labels), bool), dense[: len(ids)]
    alone[dense], ours[had] = _unpacked(sent["lone"], np.bool_)[at], True
    moved = np.where(alone[had] & alone[moved] & ~ours[moved] & (moved > had), had, moved)
    return _result(cell["run"][0].as_py(), ids, labels[moved]).append_column("quality", pa.array(value))


# ---- distributed levels ----------------------------------------------------------------------


def _sizes(arcs: DataFrame) -> dict[int, int]:
    """Arcs of the graphs that do not fit one task; their number is at most the number of arcs over `BLOCK_ARCS`."""
    return {r["run"]: r["n"] for r in arcs.groupBy("run").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK_ARCS).collect()}


def _block(node: str, blocks: dict[int, int]) -> Column:
    out = F.lit(1)
    for r, n in blocks.items():
        out = F.when(F.col("run") == r, n).otherwise(out)
    return F.pmod(F.xxhash64(node), out).cast("int")


def _round(cells: DataFrame, hub_arcs: DataFrame | None, nodes: DataFrame, turn: int) -> DataFrame:
    """run, node, label after one round of all blocks, and `quality`, whose sum is that of the modularities before it."""
    totals = nodes.groupBy("run", "label").agg(F.sum("k").alias("total"))
    full = _meet(nodes, totals, ["run", "label"])
    sent = full.select("run", "node", "k", "label", "total", "to").mapInArrow(_sent, _SENT)
    moved = cells.groupBy("run", "block").cogroup(sent.groupBy("run", "block")).applyInArrow(partial(_part, turn), _MOVED + ", quality double")
    if hub_arcs is None:
        return moved
    votes = _meet(hub_arcs, full.select("run", F.col("node").alias("b"), F.col("label").alias("c"), F.col("total").alias("t")), ["run", "b"])
    own = _apart(full.where("hub").select("run", F.col("node").alias("a"), "label", "k", "scale", "double_m", "total"))
    sums = votes.groupBy("run", "a", "c").agg(F.sum("w").alias("w"), F.first("t").alias("t"))
    sums = sums.unionByName(own.select("run", "a", F.col("label").alias("c"), F.lit(0.0).alias("w"), F.col("total").alias("t"))).groupBy("run", "a", "c").agg(F.sum("w").alias("w"), F.first("t").alias("t"))
    stays = F.col("c") == F.col("label")
    gain = F.col("w") - F.col("scale") * F.col("k") * (F.col("t") - F.when(stays, F.col("k")).otherwise(0.0))
    best = _apart(sums).join(own, ["run", "a"]).groupBy("run", F.col("a").alias("node")).agg(F.max_by("c", F.struct(gain, stays, -F.col("c"))).alias("next"), F.first("label").alias("label"), F.sum(F.when(stays, (F.col("w") - F.col("scale") * F.col("k") * F.col("t")) / F.col("double_m"))).alias("quality"))
    half = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(2)) == 0
    return moved.unionByName(best.select("run", "node", F.when(half, F.col("next")).otherwise(F.col("label")).alias("label"), "quality"))


def _packed(arcs: DataFrame, nodes: DataFrame, sizes: dict[int, int], checkpoint: Checkpoint) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """The graphs of `sizes` for the rounds of a level: arcs packed by block, those of hubs, and the nodes, each its own label and with the blocks that touch it."""
    big = F.col("run").isin(*sizes)
    arcs, blocks = arcs.where(big), {r: -(-n // BLOCK_ARCS) for r, n in sizes.items()}
    touched = arcs.groupBy("run", F.col("a").alias("node")).agg(F.count("*").alias("arcs"), F.collect_set(_block("b", blocks)).alias("to"))
    own, hub = _block("node", blocks), F.coalesce(F.col("arcs") > HUB, F.lit(False))
    to = F.array_union(F.coalesce("to", F.array().cast("array<int>")), F.array(own))
    state = checkpoint(_meet(nodes.where(big), touched, ["run", "node"], "left").select("run", "node", "k", "scale", "double_m", hub.alias("hub"), own.alias("block"), to.alias("to"), F.col("node").alias("label")))
    hubs, hub_arcs, light = state.where("hub").select("run", F.col("node").alias("a")), None, arcs
    if not hubs.isEmpty():
        hub_arcs, light = checkpoint(arcs.join(hubs, ["run", "a"])), arcs.join(hubs, ["run", "a"], "left_anti")
    cells = state.where(~F.col("hub")).select("run", "block", "node", "k", "scale", "double_m")
    cells = checkpoint(cells.groupBy("run", "block").cogroup(light.select("run", _block("a", blocks).alias("block"), "a", "b", "w").groupBy("run", "block")).applyInArrow(_cell, _CELL))
    return cells, hub_arcs, state


def _level(cells: DataFrame, hub_arcs: DataFrame | None, state: DataFrame, checkpoint: Checkpoint) -> DataFrame:
    """run, node, label after rounds from the labels of `state`, each of which sends a block the labels of the nodes it touches."""
    best, most, idle = state, -np.inf, 0
    for turn in range(MOST_ROUNDS + 1):
        after = checkpoint(_meet(state.drop("label", "quality"), _round(cells, hub_arcs, state, turn), ["run", "node"]))
        now = after.agg(F.sum("quality")).first()[0]  # of the labels before the round
        idle = 0 if now > most + max(1e-6, ENOUGH * most) else idle + 1
        if now > most:
            best, most = state, now
        if idle == 2:  # what is left to gain the next level finds sooner
            break
        state = after
    return best.select("run", "node", "label")


def partition(links: DataFrame, checkpoint: Checkpoint) -> DataFrame:
    """run, node, label of the graphs `links` (run, a, b, w, gamma); gamma is the same for all links of a run."""
    both = links.select("run", "a", "b", F.col("w").cast("double").alias("w"), "gamma")
    arcs = checkpoint(both.unionByName(both.select("run", F.col("b").alias("a"), F.col("a").alias("b"), "w", "gamma")))
    degree = arcs.groupBy("run", F.col("a").alias("node")).agg(F.sum("w").alias("k"), F.first("gamma").alias("gamma"))
    whole = degree.groupBy("run").agg(F.sum("k").alias("double_m"))
    nodes = degree.join(whole, "run").select("run", "node", "k", (F.col("gamma") / F.col("double_m")).alias("scale"), "double_m")
    arcs, members, finest, first = arcs.drop("gamma"), None, None, {}

    def finished(found: DataFrame) -> DataFrame:
        """Once more rounds over the nodes themselves, from the communities of their contracted graph."""
        cells, hub_arcs, state = finest
        moved = _level(cells, hub_arcs, checkpoint(_meet(state.drop("label"), found, ["run", "node"])), checkpoint)
        return _named(checkpoint(found.where(~F.col("run").isin(*first)).unionByName(moved)))

    while True:
        sizes = _sizes(arcs)
        if not sizes:
            break
        nodes = checkpoint(nodes)
        big = F.col("run").isin(*sizes)
        packed = _packed(arcs, nodes, sizes, checkpoint)
        if finest is None:
            finest, first = packed, sizes
        labels = checkpoint(_level(*packed, checkpoint).unionByName(nodes.where(~big).select("run", "node", F.col("node").alias("label"))))
        before, after = nodes.where(big).count(), labels.where(big).select("run", "label").distinct().count()
        members = labels if members is None else checkpoint(_meet(members.withColumnRenamed("label", "via"), labels.withColumnRenamed("node", "via"), ["run", "via"]).select("run", "node", "label"))
        if after == before:
            return finished(members)
        nodes = _meet(nodes, labels, ["run", "node"]).groupBy("run", F.col("label").alias("node")).agg(F.sum("k").alias("k"), F.first("scale").alias("scale"), F.first("double_m").alias("double_m"))
        side = lambda c, to: labels.select("run", F.col("node").alias(c), F.col("label").alias(to))
        arcs = checkpoint(_meet(_meet(arcs, side("a", "la"), ["run", "a"]), side("b", "lb"), ["run", "b"]).where("la != lb").groupBy("run", F.col("la").alias("a"), F.col("lb").alias("b")).agg(F.sum("w").alias("w")))
    # a task for each order of a graph's nodes
    starts = F.explode(F.array(*map(F.lit, range(STARTS)))).alias("start")
    tried = _apart(nodes).select("*", starts).groupBy("run", "start").cogroup(arcs.select("*", starts).groupBy("run", "start")).applyInArrow(_whole, _MOVED + ", start int, quality double")
    tried = checkpoint(tried)
    # the best, of those that differ by rounding the first
    best = tried.groupBy("run").agg(F.max("quality").alias("most"))
    best = tried.join(best, "run").where(F.col("quality") >= F.col("most") - 1e-12).groupBy("run").agg(F.min("start").alias("start"))
    top = checkpoint(tried.join(best, ["run", "start"]).select("run", "node", "label"))
    if members is None:
        return top
    return finished(checkpoint(_meet(members.withColumnRenamed("label", "via"), top.withColumnRenamed("node", "via"), ["run", "via"]).select("run", "node", "label")))


def _named(members: DataFrame) -> DataFrame:
    least = members.groupBy("run", F.col("label").alias("label")).agg(F.min("node").alias("least"))
    return _meet(members, least, ["run", "label"]).select("run", "node", F.col("least").alias("label"))


def communities(links: DataFrame, gamma: float, checkpoint: Checkpoint) -> DataFrame:
    """node, label of one graph `links` (a, b, w)."""
    return partition(links.select(F.lit(0).cast("long").alias("run"), "a", "b", "w", F.lit(float(gamma)).alias("gamma")), checkpoint).select("node", "label")


def runs_of(links: DataFrame, values: tuple[float, ...]) -> DataFrame:
    """The graph once for each resolution, `run` its place in `values`."""
    each = F.explode(F.array(*(F.struct(F.lit(k).cast("long").alias("run"), F.lit(float(g)).alias("gamma")) for k, g in enumerate(values))))
    return links.select("a", "b", "w", each.alias("g")).select("g.run", "a", "b", "w", "g.gamma")


def modularities(links: DataFrame, labels: DataFrame) -> DataFrame:
    """run, modularity (of resolution 1), n_communities of the partitions `labels` (run, node, label) of graphs `links` (run, a, b, w)."""
    side = lambda c: labels.select("run", F.col("node").alias(c), F.col("label").alias("l" + c))
    both = _meet(_meet(links, side("a"), ["run", "a"]), side("b"), ["run", "b"])
    ends = both.select("run", "w", F.explode(F.array("la", "lb")).alias("label")).groupBy("run", "label").agg(F.sum("w").alias("deg"))
    m = both.groupBy("run").agg(F.sum("w").alias("m"), F.sum(F.when(F.col("la") == F.col("lb"), F.col("w")).otherwise(0.0)).alias("inside"))
    return ends.join(m, "run").groupBy("run").agg(F.round(F.max(F.col("inside") / F.col("m")) - F.sum(F.pow(F.col("deg") / (2 * F.col("m")), 2)), 6).alias("modularity"), F.count("*").alias("n_communities"))


def sweep(links: DataFrame, checkpoint: Checkpoint, gammas: tuple[float, ...] = GAMMAS) -> tuple[DataFrame, DataFrame]:
    """The curve (gamma, n_communities, modularity, kept) and the labels (node, label) of the kept resolution: the one of highest
    modularity, the smaller of equals."""
    graphs = runs_of(links, gammas)
    labels = checkpoint(partition(graphs, checkpoint))
    curve = modularities(graphs, labels).collect()  # one row a resolution
    kept = max(curve, key=lambda r: (r["modularity"], -r["run"]))["run"] if curve else -1
    rows = [(float(gammas[r["run"]]), r["n_communities"], r["modularity"], r["run"] == kept) for r in sorted(curve)]
    return links.sparkSession.createDataFrame(rows, "gamma double, n_communities long, modularity double, kept boolean"), labels.where(F.col("run") == kept).select("node", "label")


def two_level(links: DataFrame, vectors: DataFrame, checkpoint: Checkpoint, gamma: float = 1.0, sub_gamma: float = 1.0, least: int = 5) -> DataFrame:
    """node, macro, leaf of the nodes of `vectors` (node, vector): `two_levels` of one graph."""
    run = F.lit(0).cast("long").alias("run")
    return two_levels(links.select(run, "a", "b", "w"), vectors.select(run, "node"), vectors, 1, checkpoint, gamma, sub_gamma, least).drop("run")


def two_levels(links: DataFrame, nodes: DataFrame, vectors: DataFrame, runs: int, checkpoint: Checkpoint, gamma: float = 1.0, sub_gamma: float = 1.0, least: int = 5) -> DataFrame:
    """run, node, macro, leaf of the `nodes` (run, node) of graphs `links` (run, a, b, w), their runs from 0 to `runs` - 1: communities at `gamma`, and inside each its
    induced subgraph at `sub_gamma`, of all graphs at once.

    A sub-community of fewer than `least` nodes joins the one of `least` or more in its macro whose centroid (of `vectors`: node, vector) is nearest by cosine (compared at
    nine digits, ties to the smaller label); without any, the macro has one leaf. A node without links is a macro of its own; a node without links
    inside its macro is a sub-community of its own. Labels are smallest nodes."""
    at = lambda g: F.lit(float(g)).alias("gamma")
    macros = partition(links.select("run", "a", "b", "w", at(gamma)), checkpoint)
    macro = checkpoint(_meet(nodes, macros, ["run", "node"], "left").select("run", "node", F.coalesce("label", "node").alias("macro")))
    part = F.col("macro") * runs + F.col("run")  # a number for each macro of each graph
    side = lambda c, to: macro.select("run", F.col("node").alias(c), part.alias(to))
    inner = _meet(_meet(links, side("a", "part"), ["run", "a"]), side("b", "other"), ["run", "b"]).where("part = other")
    subs = partition(inner.select(F.col("part").alias("run"), "a", "b", "w", at(sub_gamma)), checkpoint).select(F.col("run").alias("part"), "node", F.col("label").alias("sub"))
    found = checkpoint(_meet(macro.withColumn("part", part), subs, ["part", "node"], "left").select("run", "node", "macro", F.coalesce("sub", "node").alias("sub")))
    keys = ["run", "macro", "sub"]
    sizes = found.groupBy(*keys).agg(F.count("*").alias("n"))
    parts = _meet(found, vectors, "node").select(*keys, F.posexplode("vector").alias("pos", "x")).groupBy(*keys, "pos").agg(F.sum(F.col("x").cast("double")).alias("s"))
    centres = checkpoint(_meet(parts.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda x: x["s"]).alias("v")), sizes, keys))

    def nearest(crumbs: pa.Table, viable: pa.Table) -> pa.Table:
        to = np.full(crumbs.num_rows, -1)
        if viable.num_rows and crumbs.num_rows:
            order = np.argsort(_column(viable, "sub"), kind="stable")
            x, y = vector.unit(vector.matrix(crumbs["v"])), vector.unit(vector.matrix(viable["v"]))[order]
            for at in range(0, len(x), 1024):
                to[at : at + 1024] = np.round(x[at : at + 1024] @ y.T, 9).argmax(axis=1)
            to = np.where(to >= 0, _column(viable, "sub")[order][to], to)
        return pa.table({"run": crumbs["run"], "macro": crumbs["macro"], "sub": crumbs["sub"], "to": to.astype(np.int64), "some": np.full(len(to), viable.num_rows > 0)})

    goes = _apart(centres.where(F.col("n") < least)).groupBy("run", "macro").cogroup(centres.where(F.col("n") >= least).groupBy("run", "macro")).applyInArrow(nearest, "run long, macro long, sub long, to long, some boolean")
    leaf = F.when(F.col("some"), F.col("to")).when(F.col("some").isNull(), F.col("sub")).otherwise(F.col("macro"))
    joined = checkpoint(_meet(found, goes, keys, "left").select("run", "node", "macro", leaf.alias("leaf")))
    names = joined.groupBy("run", "macro", "leaf").agg(F.min("node").alias("least"))
    return _meet(joined, names, ["run", "macro", "leaf"]).select("run", "node", "macro", F.col("least").alias("leaf"))
