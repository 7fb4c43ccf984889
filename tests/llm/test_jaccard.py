import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from plurivox.llm import jaccard
from plurivox.llm.components import components

from . import fixtures

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_against_brute_force(spark):
    values = fixtures.texts()
    rng = random.Random(9)
    # chains of near copies at the edge of the threshold, in sizes of all bands
    for size in (5, 6, 8, 9, 10, 13, 14, 30, 60, 120, 300):
        words = [rng.choice(fixtures.VOCABULARY) for _ in range(size)]
        for _ in range(6):
            words = list(words)
            words[rng.randrange(size)] = rng.choice(fixtures.VOCABULARY)
            values.append(" ".join(words))
            values.append(" ".join(words[: -rng.randint(1, max(1, size // 8))]))
    docs = fixtures.table(spark, values)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(docs).collect()}
    assert got == brute(enumerate(values))


def test_common_passages_do_not_matter(spark, monkeypatch):
    """The same groups when most shingles count as common, and when none does."""
    values = fixtures.texts(30)
    want = brute(enumerate(values))
    for common in (1, 2, 10**9):
        monkeypatch.setattr(jaccard, "COMMON", common)
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(fixtures.table(spark, values)).collect()} == want


def test_awkward_rows(spark):
    docs = fixtures.awkward(spark)
    got = jaccard.join(docs).collect()
    ids = [r["doc_id"] for r in got]
    assert len(ids) == len(set(ids)) and None in ids
    assert all(r["component_id"] is not None for r in got if r["doc_id"] is not None)
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r[0] for r in kept.where("doc_id is not null").select("doc_id").collect()) == sorted(r["doc_id"] for r in got if r["doc_id"] is not None and r["doc_id"] == r["component_id"])
    assert kept.where("doc_id is null").count() == 1
    assert jaccard.join(fixtures.empty(spark)).count() == 0


@pytest.mark.parametrize("size", [4, 5, 7, 9, 11, 16, 25, 60, 150, 500])
def test_similar_sets_share_a_key(size):
    rng = np.random.default_rng(size)
    table = jaccard.bands(2000)
    for _ in range(60):
        a = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
        most = jaccard.limit(2 * len(a))
        out = rng.integers(0, most + 1)
        b = np.unique(np.r_[rng.permutation(a)[out:], rng.integers(0, 2**63, most - out, dtype=np.uint64)])
        both = len(np.intersect1d(a, b))
        if 100 * both >= 80 * (len(a) + len(b) - both) and len(np.setxor1d(a, b)):
            for common in (a[:0], np.sort(a[::3]), a, b[1:], np.union1d(a, b)):
                assert np.isin(jaccard.keys(a, table, common), jaccard.keys(b, table, common)).any()


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(2)
    for n, m in ((5, 9), (100, 130), (700, 90), (40, 40)):
        a, b = (np.unique(rng.integers(0, 400, k).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for k in (n, m))
        assert jaccard.hamming(jaccard.sketch(a), jaccard.sketch(b)) <= len(np.setxor1d(a, b))
    assert jaccard.hamming(jaccard.sketch(a), jaccard.sketch(a)) == 0


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (7, 8), (5, 5), (3, 4), (20, 10), (10, 30)], "a long, b long")
    assert {tuple(r) for r in components(links).collect()} == {(1, 1), (2, 1), (3, 1), (4, 1), (7, 7), (8, 7), (9, 7), (10, 10), (20, 10), (30, 10)}


def _near_misses(size, seed):
    """A base text, `size` texts linked to it, and as many to which it is just too far."""
    rng = random.Random(seed)
    base = [f"w{k}" for k in range(240)]
    out = [" ".join(base)]
    for edits in [4] * size + [6] * size:
        words = list(base)
        for at in rng.sample(range(5, 235, 8), edits):
            words[at] = f"x{rng.randrange(12)}"
        out.append(" ".join(words))
    return out


def test_open_pivots_meet_once_for_all_keys(spark, monkeypatch):
    """Nodes of two pivots that many keys leave open are compared once, not once a key, and the groups stay right."""
    monkeypatch.setattr(jaccard, "SALT_ROWS", 8)
    open_pairs, plain = [], jaccard.Tables.write

    def write(self, df, name, **options):
        out = plain(self, df, name, **options)
        if name == "unsure":
            open_pairs.append((out.count(), out.select(F.least("pivot1", "pivot2"), F.greatest("pivot1", "pivot2")).distinct().count()))
        return out

    monkeypatch.setattr(jaccard.Tables, "write", write)
    values = _near_misses(24, 4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(fixtures.table(spark, values)).collect()}
    assert got == brute(enumerate(values))
    assert open_pairs[0][0] == open_pairs[0][1] > 0
