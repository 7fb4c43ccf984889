"""Components, silhouettes, thresholds and stability against numpy and plain loops."""

import numpy as np
import pytest

from plurivox.operators import community, space, stability, vector
from plurivox.sources.shared import checkpointed


def frame(spark, x, labels=None):
    return spark.createDataFrame([(k, None if labels is None else labels[k], [float(c) for c in v]) for k, v in enumerate(x)], "id long, label string, v array<double>").repartition(3)


def unit(x):
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


@pytest.mark.parametrize("chunk,components", [(64, 2), (3, 0), (3, 4)])
def test_components_equal_a_decomposition(spark, monkeypatch, chunk, components):
    monkeypatch.setattr(space, "CHUNK", chunk)
    x = np.random.default_rng(0).normal(size=(80, 7)) @ np.diag([5, 4, 3, 2, 1, 0.5, 0.2]) + 3
    n, mean, cov = space.moments(frame(spark, x), "v")
    assert n == 80 and np.allclose(mean, x.mean(axis=0)) and np.allclose(cov, np.cov(x.T, bias=True))
    c = x - x.mean(axis=0)
    top = np.linalg.svd(c, full_matrices=False)[2][:components]
    got = {r["id"]: r["v"] for r in space.without_components(frame(spark, x), "v", components).collect()}
    assert np.allclose([got[k] for k in range(80)], unit(c - (c @ top.T) @ top))


def test_components_with_nulls_and_nothing(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0, 0.0])], "id long, v array<double>")
    assert sorted((r["id"], r["v"]) for r in space.without_components(df, "v", 1).collect()) == [(1, [0.0, 0.0]), (2, None), (3, [0.0, 0.0])]
    assert space.without_components(df.limit(0), "v", 1).collect() == []


@pytest.mark.parametrize("clusters", [4096, 2])
def test_silhouettes_equal_pairs(spark, monkeypatch, clusters):
    monkeypatch.setattr(space, "CLUSTERS", clusters)
    rng = np.random.default_rng(2)
    labels = [*rng.choice(list("abcd"), 40), "lone", None]
    x = rng.normal(size=(42, 5)) + np.array([ord((c or "z")[0]) % 5 for c in labels])[:, None] * np.eye(5)[0]
    got = {r["id"]: r["silhouette"] for r in space.silhouettes(frame(spark, x, [None if c is None else str(c) for c in labels]), "id", "label", "v", checkpointed).collect()}
    far = 1 - unit(x) @ unit(x).T
    assert set(got) == set(range(41))
    for i in range(41):
        own = [j for j in range(41) if labels[j] == labels[i] and j != i]
        a = far[i, own].mean() if own else 0.0
        b = min(far[i, [j for j in range(41) if labels[j] == c]].mean() for c in set(labels[:41]) - {labels[i]})
        assert abs(got[i] - ((b - a) / max(a, b) if own else 0.0)) < 1e-9
    assert space.silhouettes(frame(spark, x[:3], ["a"] * 3), "id", "label", "v", checkpointed).collect() == []


def test_threshold_for_a_degree(spark):
    rng = np.random.default_rng(3)
    w = np.round(rng.choice(np.linspace(0, 1, 30), 200), 6)
    df = spark.createDataFrame([(k, k + 1000, float(c)) for k, c in enumerate(w)], "a long, b long, w double")
    row = space.degree_threshold(df, 50, 3.0).first()
    best = min(t for t in set(w) if 2 * (w >= t).sum() <= 150)
    assert row["threshold"] == best and row["edges"] == (w >= best).sum()


def ari(p, q):
    table = {}
    for x in zip(p, q):
        table[x] = table.get(x, 0) + 1
    two = lambda ns: sum(n * (n - 1) / 2 for n in ns)
    rows, cols = [sum(n for (x, _), n in table.items() if x == c) for c in set(p)], [sum(n for (_, y), n in table.items() if y == c) for c in set(q)]
    expected, most = two(rows) * two(cols) / two([len(p)]), (two(rows) + two(cols)) / 2
    return 1.0 if most == expected else (two(table.values()) - expected) / (most - expected)


def test_agreement_of_resamples_equals_a_loop(spark):
    rng = np.random.default_rng(4)
    truth = np.arange(60) // 15
    links = [(i, j, 1.0) for i in range(60) for j in range(i + 1, 60) if rng.random() < (0.5 if truth[i] == truth[j] else 0.05)]
    df = spark.createDataFrame(links, "a long, b long, w double")
    labels = checkpointed(stability.resampled(df, 0.8, range(4), checkpointed))
    by_run = {}
    for r in labels.collect():
        by_run.setdefault(r["run"], {})[r["node"]] = r["label"]
    assert len(by_run) == 4 and all(20 < len(x) < 60 for x in by_run.values())
    got = {(r["one"], r["other"]): (r["common"], r["ari"]) for r in stability.agreement(labels).collect()}
    for a in range(4):
        alone = community.communities(df.where(stability.sampled("a", a, 0.8) & stability.sampled("b", a, 0.8)), 1.0, checkpointed)
        assert {r["node"]: r["label"] for r in alone.collect()} == by_run[a]
        for b in range(a + 1, 4):
            common = sorted(set(by_run[a]) & set(by_run[b]))
            assert got[a, b][0] == len(common) and abs(got[a, b][1] - ari([by_run[a][x] for x in common], [by_run[b][x] for x in common])) < 1e-5


def test_cleanliness_and_shuffles(spark):
    part = lambda ls: spark.createDataFrame(list(enumerate(ls)), "node long, label long")
    fine, coarse = [k // 5 for k in range(60)], [k // 20 for k in range(60)]
    assert stability.nestedness(part(fine), part(coarse)) == 1.0
    mixed = stability.shuffled(part(coarse), 1, checkpointed)
    dealt = sorted((r["node"], r["label"]) for r in mixed.collect())
    assert [n for n, _ in dealt] == list(range(60)) and sorted(c for _, c in dealt) == coarse and [c for _, c in dealt] != coarse
    assert stability.cleanliness(part(fine), part(coarse), checkpointed) == 1.0
    assert stability.cleanliness(part(fine), mixed, checkpointed) < 0.5


def test_chain_of_levels(spark):
    # points on three scales: pairs in groups in halves
    rng = np.random.default_rng(5)
    x = np.array([[h * 9 + g * 3 + p + rng.normal(0, 0.02), 20.0] for h in range(2) for g in range(3) for p in range(2) for _ in range(6)])
    near = vector.pairs(frame(spark, x), "id", "v", 40)
    rows = stability.chain(checkpointed(near), [3, 5, 12, 40], -1.0, checkpointed, step=1.5).orderBy("level").collect()
    assert rows[0]["cleanliness"] == 1.0 and len(rows) >= 2
    assert all(b["n_communities"] <= a["n_communities"] / 1.5 and b["k"] > a["k"] for a, b in zip(rows, rows[1:]))


def test_shape(spark):
    nodes = spark.createDataFrame([(k, 0 if k < 9 else 9, 0 if k < 6 else 6 if k < 9 else 9) for k in range(12)], "node long, macro long, leaf long")
    r = stability.shape(nodes).first()
    assert (r["macros"], r["structured"], r["depth"], r["leaves"], r["median_leaf"], r["orphans"]) == (2, 0.5, 2, 3, 3.0, 2)


def test_shuffles_number_the_nodes_once(spark):
    labels = spark.createDataFrame([(n, n % 3) for n in range(30)], "node long, label long")
    written = []
    rows = stability.shuffles(labels, range(3), lambda df: written.append(df.columns) or checkpointed(df))
    assert len(written) == 4  # the nodes once, and the labels of each seed
    assert [sorted(r.collect()) for r in rows] == [sorted(stability.shuffled(labels, s, checkpointed).collect()) for s in range(3)]
