import numpy as np

from plurivox.operators import closure, coarsen, node_stats, spans, vector
from plurivox.sources.shared import checkpointed


def table(spark, x):
    return spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "id long, v array<float>")


def test_neighbours_in_blocks(spark, monkeypatch):
    x = np.random.default_rng(1).normal(size=(90, 6))
    monkeypatch.setattr(vector, "BLOCK_ROWS", 20)
    got = {(r["src"], r["rank"]): (r["dst"], r["cosine"]) for r in vector.pairs(table(spark, x), "id", "v", 4).collect()}
    x = x.astype(np.float32).astype(float)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    c = np.round(u @ u.T, 6)
    for i in range(90):
        want = [j for j in np.lexsort((np.arange(90), -c[i])) if j != i][:4]
        assert [got[(i, k + 1)][0] for k in range(4)] == want


def test_neighbours_among_copies(spark, monkeypatch):
    monkeypatch.setattr(vector, "PACKED_ROWS", 32)
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(60, 5)), np.repeat(rng.normal(size=(1, 5)), 70, axis=0), np.zeros((2, 5))])[rng.permutation(132)].astype(np.float32).astype(float)
    u = vector.unit(x)
    c = np.round(u @ u.T, 6)
    for size, bound in ((200, None), (20, None), (20, 0.2)):
        monkeypatch.setattr(vector, "BLOCK_ROWS", size)
        found = vector.pairs(table(spark, x), "id", "v", 4, bound)
        # each task sends the nearest of its rows only: nothing is ranked behind it
        assert "Window" not in found._jdf.queryExecution().toString()
        got = {(r["src"], r["rank"]): r["dst"] for r in found.collect()}
        want = {(i, k + 1): j for i in range(132) for k, j in enumerate([j for j in np.lexsort((np.arange(132), -c[i])) if j != i and (bound is None or c[i, j] >= bound)][:4])}
        assert got == want
    assert {(r["src"], r["dst"]) for r in vector.pairs(table(spark, x), "id", "v", least=0.5).collect()} == {(i, j) for i, j in np.argwhere(c >= 0.5) if i != j}


def test_statistics_of_one_and_equal_vectors(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("b", [0.0, 1.0])], "k string, v array<double>")
    got = {r["k"]: (r["dispersion"], r["consensus"]) for r in node_stats.theme_cards(df, "k", "v").collect()}
    assert got == {"a": (0.0, 1.0), "b": (0.0, 1.0)}


def test_closure(spark):
    links = spark.createDataFrame([(4, 3), (3, 2), (2, 1), (9, 7)], "a long, b long")
    assert {tuple(r) for r in closure.components(links, checkpointed).collect()} == {(1, 1), (2, 1), (3, 1), (4, 1), (7, 7), (9, 7)}


def test_coarsening_merges_near_roots():
    sums = np.array([[10.0, 0.5, 0], [9.0, 0.4, 0], [0, 8.0, 0], [0, 0, 7.0]])
    assert coarsen.merge(sums, np.array([10.2, 9.2, 8.2, 7.2])).tolist() == [0, 0, 1, 2]
    assert coarsen.merge(np.eye(3), np.ones(3)).tolist() == [0, 1, 2]


def test_communities_of_two_cliques(spark):
    pairs = [(a, b, 1.0) for g in (range(4), range(10, 14)) for a in g for b in g if a < b] + [(3, 10, 0.1)]
    links = spark.createDataFrame(pairs, "a long, b long, w double")
    labels = {r["node"]: r["label"] for r in vector.label_propagation(links, 8, checkpointed).collect()}
    assert len({labels[n] for n in range(4)}) == 1 and len({labels[n] for n in range(10, 14)}) == 1 and labels[0] != labels[10]


def test_labels_travel_until_none_changes(spark):
    import pytest

    # a chain whose weights fall, so that the first label passes down all of it
    links = spark.createDataFrame([(k, k + 1, 2.0 - 0.05 * k) for k in range(16)], "a long, b long, w double")
    labels = {r["node"]: r["label"] for r in vector.label_propagation(links, vector.MOST_ROUNDS, checkpointed).collect()}
    weight = {(a, b): 2.0 - 0.05 * min(a, b) for k in range(16) for a, b in ((k, k + 1), (k + 1, k))}
    for n in range(17):
        votes = {labels[n]: 0.01}
        for m in (n - 1, n + 1):
            if (n, m) in weight:
                votes[labels[m]] = votes.get(labels[m], 0) + weight[n, m]
        assert min(votes, key=lambda x: (-round(votes[x], 9), x)) == labels[n]
    with pytest.raises(RuntimeError):
        vector.label_propagation(links, 2, checkpointed)


def test_locate_counts_code_points(spark):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([("é\U0001f600 abc abc", "abc")], "t string, p string").select(spans.locate(F.col("t"), F.col("p")).alias("s")).first()["s"]
    assert (row["start"], row["end"]) == (3, 6)


def test_union_cohesion_and_refused_pairs():
    """Cohesion is the mean cosine to the centroid; a loose union is refused once and other pairs still merge."""
    assert np.isclose(coarsen.cohesion(np.array([3.0, 4.0]), 8.0), 0.625)
    rng = np.random.default_rng(4)

    def theme(direction, spread, n=20):
        v = np.asarray(direction) + rng.normal(0, spread, (n, 6))
        return (v / np.linalg.norm(v, axis=1)[:, None]).sum(axis=0)

    e = np.eye(6)
    sums = np.stack([theme(e[0], 0.02), theme(e[0] + 0.05 * e[1], 0.02), theme(e[2], 1.5), theme(e[2] + 0.05 * e[3], 1.5), theme(e[4], 0.02), theme(e[5], 0.02)])
    out = coarsen.merge(sums, np.full(6, 20.0)).tolist()
    assert out[0] == out[1] and len(set(out[2:])) == 4


def test_deep_trees_and_cycles(spark):
    from plurivox.operators import tree

    nodes = spark.createDataFrame([(k, k - 1 if k else None) for k in range(75)] + [(100, None), (101, 100)], "id long, parent long")
    assert {r["node"]: r["root"] for r in tree.roots(nodes, "id", "parent").collect()} == {**{k: 0 for k in range(75)}, 100: 100, 101: 100}
    assert tree.ancestors(nodes, "id", "parent").count() == 75 * 76 // 2 + 3
    assert tree.descendants(nodes, "id", "parent", 40).count() == 35
    broken = nodes.union(spark.createDataFrame([(200, 201), (201, 200), (202, 201), (300, 999), (100, None)], nodes.schema))
    members = spark.createDataFrame([(7,), (888,)], "m long")
    assert sorted(tuple(r) for r in tree.violations(broken, members, "id", "parent", "m").collect()) == [("cycle", 200), ("cycle", 201), ("cycle", 202), ("lost member", 888), ("missing parent", 999), ("repeated node", 100)]
    assert {r["node"]: r["root"] for r in tree.roots(broken.where("id > 100"), "id", "parent").collect()} == {101: 100, 200: None, 201: None, 202: None, 300: 999}
