"""Argument layers against plain greedy loops."""

import numpy as np

from plurivox.operators import arguments
from plurivox.sources.shared import checkpointed


def unit(x):
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def clumps(n, seed, centres=4, noise=0.35):
    rng = np.random.default_rng(seed)
    return unit(np.eye(5)[rng.integers(0, centres, n)] + rng.normal(0, noise, (n, 5)))


def test_groups_by_side(spark):
    rows = [("a", s, k) for k, s in enumerate(["for"] * 3 + ["against"] * 2 + ["nuance"] * 4)] + [("b", s, k + 20) for k, s in enumerate(["for", "nuance", "x"])] + [("c", "for", 90)]
    got = arguments.groups(spark.createDataFrame(rows, "leaf string, stance string, id long"), spark.createDataFrame([("a",), ("a",)], "leaf string"))
    assert sorted((r["leaf"], r["side"], r["id"]) for r in got.collect()) == [("a", "for", 0), ("a", "for", 1), ("a", "for", 2), ("b", "neutral", 20), ("b", "neutral", 21), ("b", "neutral", 22)]


def test_cover_and_support_equal_a_greedy_loop(spark):
    groups = {g: clumps(n, g) for g, n in ((1, 60), (2, 9), (3, 1), (4, 30))}
    groups[4][:] = groups[4][0]  # all equal
    rows = [(g, 100 * g + k, [float(c) for c in v], 1.0 + k % 3) for g, x in groups.items() for k, v in enumerate(x)]
    claims = spark.createDataFrame(rows, "g long, id long, vector array<double>, weight double").repartition(5)
    picks = arguments.cover(claims, ["g"], 0.6, 4, checkpointed)
    got = {}
    for r in picks.collect():
        got.setdefault(r["g"], {})[r["pick"]] = r["id"]
    want, sums = {}, {}
    for g, x in groups.items():
        central, covered, seeds = np.round(x @ unit(x.sum(axis=0)[None])[0], 6), np.zeros(len(x), bool), []
        for k in np.lexsort((np.arange(len(x)), -central)):
            if not covered[k] and len(seeds) < 4:
                seeds.append(int(k))
                covered |= np.round(x @ x[k], 6) >= 0.6
        want[g] = {p: 100 * g + k for p, k in enumerate(seeds)}
        sims = np.round(x @ x[seeds].T, 6)
        best = sims.argmax(axis=1)
        for p in range(len(seeds)):
            own = [k for k in range(len(x)) if best[k] == p and sims[k, p] >= 0.5]
            if len(own) >= 3:
                near = sorted(own, key=lambda k: (-sims[k, p], k))[:5]
                sums[g, p] = (len(own), round(sum(1.0 + k % 3 for k in own), 3), [100 * g + k for k in near])
    assert got == want
    rows = arguments.support(claims, picks, ["g"], 0.5).collect()
    assert {(r["g"], r["pick"]): (r["n_support"], r["weight"], [s["id"] for s in r["sources"]]) for r in rows} == sums


def test_merger_equals_a_greedy_loop(spark):
    rng = np.random.default_rng(9)
    entries = []
    for g in range(3):
        x = clumps(40 if g else 300, g + 20)
        entries += [(g, f"leaf{k % 7}", 1000 * g + k, [float(c) for c in v], int(rng.integers(3, 9)), float(k % 5), [(1000 * g + k, 0.5 + k % 10 / 20), (5000 + k, 0.4)]) for k, v in enumerate(x)]
    df = spark.createDataFrame(entries, "parent long, leaf string, id long, vector array<double>, n_support long, weight double, sources array<struct<id: long, similarity: double>>").repartition(6)
    got = sorted((r["parent"], r["rank"], r["id"], r["n_support"], round(r["weight"], 3), list(r["merged_from"]), [s["id"] for s in r["sources"]]) for r in arguments.merged(df, ["parent"], 0.7, 4, 3).collect())
    want = []
    for g in range(3):
        found = []
        for _, leaf, i, v, n, w, src in sorted((e for e in entries if e[0] == g), key=lambda e: (-e[4], e[2])):
            home = next((m for m in found if round(float(np.dot(m["v"], v)), 6) >= 0.7), None)
            if home is None:
                home = {"v": np.array(v), "id": i, "n": 0, "w": 0.0, "from": set(), "src": []}
                found.append(home)
            home["n"] += n
            home["w"] += w
            home["from"].add(leaf)
            home["src"] += src
        for rank, m in enumerate(sorted(found, key=lambda m: -m["n"])[:4]):
            want.append((g, rank + 1, m["id"], m["n"], round(m["w"], 3), sorted(m["from"]), [i for i, _ in sorted(m["src"], key=lambda s: (-s[1], s[0]))[:3]]))
    assert got == want


def test_no_claims(spark):
    claims = spark.createDataFrame([], "g long, id long, vector array<double>, weight double")
    picks = arguments.cover(claims, ["g"], 0.6, 3, checkpointed)
    assert picks.collect() == [] and arguments.support(claims, picks, ["g"], 0.5).collect() == []
