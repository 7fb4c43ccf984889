"""Segmenters against brute force, and planted boundaries."""

import itertools

import numpy as np
import pytest

from plurivox.operators import segment


def planted(lengths, noise=0.05, seed=0, dims=6):
    rng = np.random.default_rng(seed)
    rows = [np.eye(dims)[k % dims] + rng.normal(0, noise, dims) for k, n in enumerate(lengths) for _ in range(n)]
    return np.array(rows), np.cumsum(lengths)[:-1].tolist()


def frame(spark, texts):
    return spark.createDataFrame([(k, None if u is None else [list(map(float, r)) for r in u]) for k, u in enumerate(texts)], "doc long, units array<array<double>>")


def test_signals_equal_plain_loops():
    u = np.random.default_rng(1).normal(size=(11, 4))
    cos = lambda a, b: float(a @ b / np.linalg.norm(a) / np.linalg.norm(b))
    assert np.allclose(segment.block_similarity(u, 3), [cos(u[max(0, p - 3) : p].mean(axis=0), u[p : p + 3].mean(axis=0)) for p in range(1, 11)])
    s = np.array([u[max(0, i - 2) : i + 3].mean(axis=0) for i in range(11)])
    s /= np.linalg.norm(s, axis=1, keepdims=True)
    assert np.allclose(segment.smooth(u, 4), s)
    assert np.allclose(segment.novelty(u, 4), [cos(s[i], s[:i].mean(axis=0)) for i in range(1, 11)])
    assert segment.novelty(np.zeros((3, 2)), 1).tolist() == [1.0, 1.0] and segment.block_similarity(u[:1], 3).tolist() == []


@pytest.mark.parametrize("seed", range(8))
def test_change_points_equal_all_segmentations(seed):
    rng = np.random.default_rng(seed)
    u, penalty = rng.normal(size=(rng.integers(6, 13), 2)), float(rng.uniform(0.2, 3))
    n = len(u)

    def cost(cuts):
        edges = [0, *cuts, n]
        return sum(((u[a:b] - u[a:b].mean(axis=0)) ** 2).sum() for a, b in zip(edges, edges[1:])) + penalty * len(cuts)

    options = [c for k in range(n // 3) for c in itertools.combinations(range(3, n - 2), k) if all(b - a >= 3 for a, b in zip([0, *c], [*c, n]))]
    got = segment.change_points(u, 1, penalty)
    assert abs(cost(got) - min(map(cost, options))) < 1e-9 and tuple(got) in options


@pytest.mark.parametrize("seed", range(6))
def test_merged_runs_equal_relabelling(seed):
    labels = np.random.default_rng(seed).integers(0, 3, 20).repeat(np.random.default_rng(seed + 50).integers(1, 4, 20))
    n, want = len(labels), list(labels)
    while True:  # relabel the shortest run until all are long enough
        cuts = [0, *[i for i in range(1, n) if want[i] != want[i - 1]], n]
        runs = list(zip(cuts, cuts[1:]))
        short = [(b - a, k) for k, (a, b) in enumerate(runs) if b - a < 3]
        if len(runs) == 1 or not short:
            break
        k = min(short)[1]
        sides = [x for x in (k - 1, k + 1) if 0 <= x < len(runs)]
        to = max(sides, key=lambda x: (runs[x][1] - runs[x][0], -x))
        want[runs[k][0] : runs[k][1]] = [want[runs[to][0]]] * (runs[k][1] - runs[k][0])
    assert segment.runs_merged(labels) == [a for a, _ in runs[1:]]
    assert segment.runs_merged(labels[:5]) == []


def test_spaced_boundaries():
    assert segment.spaced(np.array([2, 5, 6, 9, 14]), np.array([9.0, 1.0, 3.0, 3.0, 2.0]), 18, 3) == [6, 9, 14]
    assert segment.spaced(np.array([3, 5]), np.array([1.0, 1.0]), 9, 3) == [3]


def test_planted_boundaries_are_found(spark):
    texts, truth = zip(*(planted([8, 10, 7], seed=k) if k % 3 else planted([20], seed=k) for k in range(12)))
    df = frame(spark, [*texts, None, [], [[1.0] * 6]])
    ways = {
        "tiling": segment.by_tiling(df, "doc", "units", 4, 1.0),
        "centroid": segment.by_centroid(df, "doc", "units", 2, 1.5),
        "change": segment.by_change(df, "doc", "units", 2, 1.5),
        "communities": segment.by_communities(df, "doc", "units", 5, 0.3, 0.4),
    }
    for name, found in ways.items():
        rows = {r["doc"]: list(r["boundaries"]) for r in found.collect()}
        assert len(rows) == 15 and rows[12] == rows[13] == rows[14] == []
        counts = np.array([segment.matched(t, rows[k]) for k, t in enumerate(truth)]).sum(axis=0)
        assert counts[0] >= 0.9 * (counts[0] + counts[2]) and counts[1] <= 2, (name, counts)


def test_matching_and_scorecard(spark):
    assert segment.matched([3, 5], [4]) == (1, 0, 1) and segment.matched([3, 5], [4, 4, 6]) == (2, 0, 0) and segment.matched([], [1]) == (0, 1, 0)
    df = spark.createDataFrame([([3, 5], [4]), ([], [2]), ([], []), (None, None)], "t array<int>, f array<int>")
    row = segment.scorecard(df, "t", "f").first()
    assert (row["precision"], row["recall"], row["f1"], row["whole_cut"], row["mean_cuts"]) == (0.5, 0.5, 0.5, round(1 / 3, 6), 0.5)


def test_unit_graph():
    a, b, w = segment.unit_graph(4, (np.array([0, 0, 1]), np.array([1, 2, 3]), np.array([0.9, 0.2, 0.7])), 0.5, 0.25)
    assert list(zip(a.tolist(), b.tolist(), w.tolist())) == [(0, 1, 1.15), (1, 2, 0.25), (1, 3, 0.7), (2, 3, 0.25)]
