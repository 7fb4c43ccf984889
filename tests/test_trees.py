"""Walks of trees and keyword picks against plain recursion and greedy loops."""

import random

import pytest

from plurivox.operators import naming, tree
from plurivox.sources.shared import checkpointed


def forest(n=60, seed=1):
    rng = random.Random(seed)
    return [(k, rng.randrange(k) if k % 9 else None, rng.randint(0, 4)) for k in range(n)]


def walk(rows):
    children = {}
    for k, p, w in rows:
        children.setdefault(p, []).append((-w, k))
    out = []

    def visit(k, depth):
        out.append((k, f"n{len(out)}", depth))
        for _, c in sorted(children.get(k, [])):
            visit(c, depth + 1)

    for _, k in sorted(children.get(None, [])):
        visit(k, 0)
    return sorted(out)


def test_walk_equals_recursion(spark):
    rows = forest()
    df = spark.createDataFrame(rows, "k long, p long, w int").repartition(5)
    assert sorted(tuple(r) for r in tree.preorder(df, "k", "p", "w").collect()) == walk(rows)


def test_roots_of_chains_cycles_and_missing_parents(spark):
    rows = [(k, k - 1 if k else None) for k in range(40)] + [(100, 101), (101, 102), (102, 100), (103, 102), (200, 999), (201, 200)]
    got = {r["node"]: r["root"] for r in tree.roots(spark.createDataFrame(rows, "k long, p long"), "k", "p").collect()}
    assert all(got[k] == 0 for k in range(40)) and all(got[k] is None for k in (100, 101, 102, 103)) and got[200] == got[201] == 999
    assert tree.roots(spark.createDataFrame([], "k long, p long"), "k", "p").collect() == []


def test_owners_below(spark):
    rows = forest()
    up = {k: p for k, p, _ in rows}
    rng = random.Random(4)
    members = [(rng.randrange(70), rng.choice("abcdef")) for _ in range(90)]
    below = {k: set() for k, _, _ in rows}
    for m, o in members:
        while m in below:
            below[m].add(o)
            m = up[m]
    df = spark.createDataFrame(rows, "k long, p long, w int")
    got = {r["node"]: r["n"] for r in tree.distinct_below(df, spark.createDataFrame(members, "m long, o string"), "k", "p", "m", "o").collect()}
    assert got == {k: len(s) for k, s in below.items()}


@pytest.mark.parametrize("depth", [64, 2])
def test_keywords_equal_a_greedy_loop(spark, monkeypatch, depth):
    monkeypatch.setattr(naming, "DEPTH", depth)
    rng = random.Random(5)
    words = [f"w{k}" for k in range(12)]
    weights = {}
    for c in range(4):
        for _ in range(40 if c else 2):
            term = rng.choice(words) if rng.random() < 0.4 else f"{rng.choice(words)} {rng.choice(words)}"
            weights[c, term] = rng.choice([0.0, 0.5, 1.0, 2.0, rng.random()])
    df = spark.createDataFrame([(c, t, w) for (c, t), w in weights.items()], "c long, term string, weight double")
    stop = {"w3", "w7"}
    got = {}
    for r in naming.keywords(df, spark.createDataFrame([(x,) for x in stop], "term string"), "c", 5, checkpointed).collect():
        got.setdefault(r["c"], {})[r["pick"]] = r["term"]
    for c in range(4):
        kept = []
        for t in sorted((t for x, t in weights if x == c), key=lambda t: (-round(weights[c, t], 9), t)):
            if weights[c, t] > 0 and not set(t.split()) & stop and len(kept) < 5 and not any(t in x.split() or x in t.split() for x in kept):
                kept.append(t)
        assert got.get(c, {}) == {k + 1: t for k, t in enumerate(kept)}
