"""Communities against a plain Louvain, planted blocks, and the same graphs split over many blocks."""

import numpy as np
import pyarrow as pa
import pytest

from plurivox.operators import community
from plurivox.sources.shared import checkpointed


def planted(blocks=4, size=25, inside=0.4, outside=0.01, seed=1):
    rng = np.random.default_rng(seed)
    n = blocks * size
    truth = np.arange(n) // size
    chance = np.where(truth[:, None] == truth[None], inside, outside)
    return [(i, j, float(rng.uniform(0.5, 1))) for i in range(n) for j in range(i + 1, n) if rng.random() < chance[i, j]], truth


def frame(spark, links):
    return spark.createDataFrame(links, "a long, b long, w double")


def modularity(links, label, gamma=1.0):
    m = sum(w for _, _, w in links)
    degree = {}
    for a, b, w in links:
        for x in (a, b):
            degree[label[x]] = degree.get(label[x], 0) + w
    return sum(w for a, b, w in links if label[a] == label[b]) / m - gamma * sum(d * d for d in degree.values()) / (2 * m) ** 2


def plain(links, gamma):
    """Textbook Louvain: every node to its best community by trying all, then contraction, until nothing moves."""
    nodes = sorted({x for a, b, _ in links for x in (a, b)})
    of = {x: x for x in nodes}
    graph = {}
    for a, b, w in links:
        graph[a, b] = graph.get((a, b), 0) + w
    while True:
        ids = sorted({x for e in graph for x in e})
        label, m = {x: x for x in ids}, sum(graph.values())
        degree = {x: sum(w * ((a == x) + (b == x)) for (a, b), w in graph.items()) for x in ids}
        near = {x: {} for x in ids}
        for (a, b), w in graph.items():
            if a != b:
                near[a][b] = near[a].get(b, 0) + w
                near[b][a] = near[b].get(a, 0) + w
        moved = again = True
        while again:
            again = False
            for x in ids:
                total = {}
                for y in ids:
                    if y != x:
                        total[label[y]] = total.get(label[y], 0) + degree[y]
                pull = {label[x]: 0.0}
                for y, w in near[x].items():
                    pull[label[y]] = pull.get(label[y], 0) + w
                gain = {c: s - gamma * degree[x] * total.get(c, 0) / (2 * m) for c, s in pull.items()}
                best = max(gain, key=lambda c: (gain[c], c == label[x], -c))
                if gain[best] > gain[label[x]] + 1e-12:
                    label[x], again = best, True
        moved = len(set(label.values())) < len(ids)
        of = {x: label[c] for x, c in of.items()}
        if not moved:
            return of
        new = {}
        for (a, b), w in graph.items():
            key = tuple(sorted((label[a], label[b])))
            new[key] = new.get(key, 0) + w
        graph = new


def labels_of(df):
    return {r["node"]: r["label"] for r in df.collect()}


def same_parts(label, truth):
    groups = {}
    for x, c in label.items():
        groups.setdefault(c, set()).add(int(truth[x]))
    return len(groups) == len(set(truth)) and all(len(g) == 1 for g in groups.values())


def test_planted_blocks_come_back(spark):
    links, truth = planted()
    label = labels_of(community.communities(frame(spark, links), 1.0, checkpointed))
    assert same_parts(label, truth)
    assert all(c == min(x for x in label if label[x] == c) for c in set(label.values()))


@pytest.mark.parametrize("gamma", [0.5, 1.0, 2.0])
def test_at_least_as_good_as_textbook(spark, gamma):
    links, _ = planted(blocks=5, size=14, inside=0.35, outside=0.08, seed=7)
    ours = labels_of(community.communities(frame(spark, links), gamma, checkpointed))
    assert modularity(links, ours, gamma) >= modularity(links, plain(links, gamma), gamma) - 1e-9


def test_order_of_rows_does_not_matter(spark):
    links, _ = planted(outside=0.06)
    one = labels_of(community.communities(frame(spark, links), 1.0, checkpointed))
    assert one == labels_of(community.communities(frame(spark, links[::-1]).repartition(5), 1.0, checkpointed))


@pytest.mark.parametrize("hub", [10_000, 12])
def test_graphs_beyond_one_block(spark, monkeypatch, hub):
    links, truth = planted(blocks=4, size=20, inside=0.5, outside=0.01, seed=3)
    whole = labels_of(community.communities(frame(spark, links), 1.0, checkpointed))
    monkeypatch.setattr(community, "BLOCK_ARCS", 250)
    monkeypatch.setattr(community, "HUB", hub)
    monkeypatch.setattr(community, "MOST_ROUNDS", 8)
    split = labels_of(community.communities(frame(spark, links), 1.0, checkpointed))
    assert split.keys() == whole.keys()
    assert modularity(links, split) >= 0.97 * modularity(links, whole)


def test_sweep_keeps_the_highest_modularity(spark):
    links, truth = planted()
    curve, labels = community.sweep(frame(spark, links), checkpointed, (0.01, 1.0, 8.0))
    rows = sorted(map(tuple, curve.collect()))
    assert [r[3] for r in rows] == [False, True, False]
    assert rows[0][1] == 1 and rows[2][1] > 4
    label = labels_of(labels)
    assert same_parts(label, truth) and abs(rows[1][2] - modularity(links, label)) < 1e-5


def test_two_levels_and_crumbs(spark):
    # a macro of two cliques and a pendant pair, a lone node, and a macro that is too small to divide
    cliques = [[0, 1, 2, 3, 4], [10, 11, 12, 13, 14]]
    links = [(a, b, 1.0) for g in cliques for a in g for b in g if a < b] + [(4, 10, 1.0), (3, 11, 0.5), (14, 20, 1.0), (20, 21, 0.9), (30, 31, 1.0)]
    at = {**dict.fromkeys(cliques[0], [1.0, 0.0]), **dict.fromkeys(cliques[1], [0.0, 1.0]), 20: [0.1, 1.0], 21: [0.9, 0.1], 30: [1.0, 1.0], 31: [1.0, -1.0], 40: [0.0, 0.0]}
    vectors = spark.createDataFrame([(k, v) for k, v in at.items()], "node long, vector array<double>")
    rows = {r["node"]: (r["macro"], r["leaf"]) for r in community.two_level(frame(spark, links), vectors, checkpointed, 0.1, 2.0, least=4).collect()}
    assert rows[0][0] == rows[14][0] == rows[21][0] == 0 and rows[30] == rows[31] == (30, 30) and rows[40] == (40, 40)
    assert len({rows[x][1] for x in cliques[0]}) == 1 and len({rows[x][1] for x in cliques[1]}) == 1 and rows[0][1] != rows[10][1]
    assert rows[20][1] in (rows[0][1], rows[10][1]) and rows[21][1] in (rows[0][1], rows[10][1])


def test_empty_graph(spark):
    empty = spark.createDataFrame([], "a long, b long, w double")
    assert community.communities(empty, 1.0, checkpointed).collect() == []
    curve, labels = community.sweep(empty, checkpointed)
    assert curve.collect() == [] and labels.collect() == []


def test_labels_meet_links_without_a_broadcast(spark):
    links = spark.createDataFrame([(0, 1, 2, 1.0), (0, 2, 3, 1.0)], "run long, a long, b long, w double")
    labels = spark.createDataFrame([(0, 1, 1), (0, 2, 1), (0, 3, 1)], "run long, node long, label long")
    found = community.modularities(links, labels)
    assert found._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin") >= 2
    assert [tuple(r) for r in found.collect()] == [(0, 0.0, 1)]


def test_two_levels_of_several_graphs_at_once(spark):
    clique = lambda at: [(at + i, at + j, 1.0) for i in range(6) for j in range(i + 1, 6)]
    graphs = [clique(0) + clique(10) + [(5, 10, 0.5)], clique(0) + clique(20)]
    vectors = spark.createDataFrame([(n, [1.0, float(n)]) for n in (*range(6), *range(10, 16), *range(20, 26))], "node long, vector array<double>")
    links = spark.createDataFrame([(r, *e) for r, g in enumerate(graphs) for e in g], "run long, a long, b long, w double")
    nodes = spark.createDataFrame([(r, n) for r, g in enumerate(graphs) for n in sorted({x for a, b, _ in g for x in (a, b)})], "run long, node long")
    got = {tuple(r) for r in community.two_levels(links, nodes, vectors, 2, checkpointed).select("run", "node", "macro", "leaf").collect()}
    assert got == {(r, n, n // 10 * 10, n // 10 * 10) for r, g in enumerate(graphs) for a, b, _ in g for n in (a, b)}


@pytest.mark.parametrize("hub", [10_000, 12])
def test_a_round_tells_the_modularity_it_began_with(spark, monkeypatch, hub):
    links, _ = planted(blocks=4, size=20, inside=0.5, outside=0.02, seed=3)
    monkeypatch.setattr(community, "BLOCK_ARCS", 250)
    monkeypatch.setattr(community, "HUB", hub)
    monkeypatch.setattr(community, "MOST_ROUNDS", 3)
    rounds = []

    def kept(df):
        out = checkpointed(df)
        if {"to", "quality"} <= set(out.columns):
            rounds.append(out.collect())
        return out

    community.communities(frame(spark, links), 1.0, kept)
    first = [r for r in rounds if len(r) == 80][:2]  # two rounds of the first level
    assert len(first) == 2 and len({r["label"] for r in first[0]}) < 80
    assert abs(sum(r["quality"] for r in first[1]) - modularity(links, {r["node"]: r["label"] for r in first[0]})) < 1e-9


def test_lone_nodes_of_two_blocks_do_not_swap():
    ids, labels = np.array([1, 2]), pa.array([np.array([1, 2]).tobytes()])
    sent = pa.table({"nodes": labels, "labels": labels, "totals": pa.array([np.ones(2).tobytes()]), "lone": pa.array([np.ones(2, bool).tobytes()])})
    went = []
    for own, other in (ids, ids[::-1]):
        nodes = pa.table({"run": [0], "block": pa.array([int(own)], pa.int32()), "node": [int(own)], "k": [1.0], "scale": [0.5], "double_m": [2.0]})
        cell = community._cell(nodes, pa.table({"a": [int(own)], "b": [int(other)], "w": [1.0]}))
        went.append({community._part(turn, cell, sent)["label"][0].as_py() for turn in range(8)})
    assert went == [{1}, {1, 2}]  # the larger label goes when it is its turn
