import math
import re
import zlib
from collections import Counter

import numpy as np

from plurivox.llm import lm

from . import fixtures

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def toks(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)), None]


def test_base_and_counts_against_brute_force(spark):
    values = fixtures.texts()
    rows = list(enumerate(values))
    count = Counter(w for i, t in rows if zlib.crc32(str(i).encode()) % 10 for w in toks(t))
    n, v = sum(count.values()), len(count)
    got = {r["doc_id"]: r for r in lm.score(fixtures.table(spark, values).repartition(4)).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        r, ws = got[i], toks(t)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(ws), sum(count[w] > 0 for w in ws), n, zlib.crc32(str(i).encode()) % 10 == 0)
        assert math.isclose(r["base_score"], sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), rel_tol=1e-9)
        assert r["score"] <= 0 and math.isfinite(r["score"])


def test_model_beats_the_base_on_held_out_text(spark):
    import random

    rng = random.Random(1)
    # what follows depends on the word before
    a, b = fixtures.VOCABULARY[5:105], fixtures.VOCABULARY[105:205]
    values = [" ".join(rng.choice(a) + " x" if k % 2 else rng.choice(b) + " yyyyyy" for k in range(80)) for _ in range(300)]
    got = lm.score(fixtures.table(spark, values)).where("held_out").groupBy().sum("score", "base_score").first()
    assert got[0] > got[1] * 0.8


def bucket_of(pairs, names, number=0):
    """A bucket of {(word, context): count}."""
    words = sorted({w for w, _ in pairs})
    many = np.array([sum(w == x for x, _ in pairs) for w in words])
    u = np.array([u for _, u in sorted(pairs)])
    return lm.Bucket(number, names, many, u, np.array([pairs[k] for k in sorted(pairs)]))


def test_probabilities_sum_to_one():
    """Over all tokens and the unknown one, after any context, of restaurants of words and of classes."""
    rng = np.random.default_rng(3)
    names = lm.Names(np.arange(4, dtype=np.uint64), np.array([0, 0, 1, 2]))
    contexts = [0, 1, 2, 3, 4 + 1, 4 + 2, 4 + lm.START]
    bucket = bucket_of({(w, u): int(rng.integers(0, 6)) for w in range(50) for u in contexts}, names)
    for _ in range(3):
        s = lm.Sums(bucket.sums(), names.n)
        bucket.sweep(s)
        s = lm.Sums(bucket.sums(), names.n)
        known = bucket.total > 0
        unknown = (lm.STRENGTH + s.d0 * s.t0) / (s.v + 1) / (lm.STRENGTH + s.t2.sum())
        assert math.isclose(bucket.parent(s)[known].sum() + unknown, 1, rel_tol=1e-9)
        p = bucket.predictive(s)
        for u in contexts:
            k = int(names.classes(np.array([u]))[0])
            rest = (lm.STRENGTH + s.d2 * s.t2[k]) * unknown / (lm.STRENGTH + s.c2[k])
            if u < names.n:
                rest = (lm.STRENGTH + s.d1 * s.t1[u]) * rest / (lm.STRENGTH + s.c1[u])
            assert math.isclose(p[(bucket.u == u) & known[bucket.w]].sum() + rest, 1, rel_tol=1e-9)


def test_seating_follows_the_process():
    """Means of tables against customers seated one by one, below and beyond the first customers."""
    rng = np.random.default_rng(1)
    assert lm._seat(np.array([0, 1, 2]), np.full(3, 1e9), 0.5, rng).tolist() == [0, 1, 2]
    for c, new, d in ((5, 2.0, 0.5), (60, 0.7, 0.8), (300, 20.0, 0.3)):
        singly = np.ones(4000)
        for j in range(1, c):
            singly += rng.random(4000) * (new + j - d * singly) < new
        many = lm._seat(np.full(4000, c), np.full(4000, new), d, rng)
        assert ((many >= 1) & (many <= c)).all()
        error = 5 * math.sqrt((singly.var() + many.var()) / 4000)
        assert abs(many.mean() - singly.mean()) < error
        assert abs(many.std() - singly.std()) < 0.1 * singly.std() + 0.02
    draws = rng.random(5000)  # one block against a loop over the same draws
    tables, opened = 3.0, 0
    for j, r in enumerate(draws):
        if r * (40.0 + 30 + j - 0.9 * (tables + opened)) < 40.0:
            opened += 1

    class Given:
        def random(self, n):
            return draws[:n]

    assert lm._block(np.array([40.0]), np.array([30]), np.array([5000]), 0.9, np.array([3.0]), Given()).tolist() == [opened]
    before = lm.BLOCK
    lm.BLOCK = 100
    assert ((lm._seat(np.arange(400), np.full(400, 5.0), 0.5, rng) <= np.arange(400)).all())
    lm.BLOCK = before


def test_score_against_brute_force(spark, monkeypatch):
    """The sampled seating, put into the model's formulas word by word."""
    from plurivox.llm import exchange

    monkeypatch.setattr(lm, "CONTEXTS", 7)
    monkeypatch.setattr(exchange, "buckets_for", lambda docs: 1)
    values = [fixtures.prose(__import__("random").Random(k), 40, 30) for k in range(40)] + [None, "", "the the the"]
    docs = fixtures.table(spark, values).coalesce(1)
    got = {r["doc_id"]: r["score"] for r in lm.score(docs).collect()}
    names = lm.frequent(docs)
    train = [toks(t) for i, t in enumerate(values) if zlib.crc32(str(i).encode()) % 10]
    count = Counter(w for t in train for w in t if w)
    assert names.n == 7
    hashes = {w: int(lm.shared.Words(lm.pa.array([w])).hash[0]) for w in {w for t in values for w in toks(t) if w}}
    assert sorted(hashes[w] for w, _ in sorted(count.items(), key=lambda x: (-x[1], np.uint64(hashes[x[0]]).astype(np.int64)))[:7]) == names.h.tolist()
    place = {int(h): k for k, h in enumerate(names.h)}
    cls = {w: int(lm.tokens(lm.shared.Words(lm.pa.array([w])))[1][0]) for w in hashes}
    token = lambda w: hashes[w] if w else int(lm._END)

    def contexts(t):
        before = [None, *t[:-1]]
        return [names.n + lm.START if b is None else place.get(hashes[b], names.n + cls[b]) for b in before]

    pairs = Counter()
    for t in map(toks, values):
        for w, u in zip(t, contexts(t)):
            pairs[token(w), u] += 0
    for t in train:
        for w, u in zip(t, contexts(t)):
            pairs[token(w), u] += 1
    bucket, key = bucket_of(pairs, names), {k: i for i, k in enumerate(sorted(pairs))}
    history, p = [], np.zeros(len(key))
    for i in range(lm.SWEEPS):
        replay = bucket_of(pairs, names)
        for s in history:
            replay.sweep(s)
        history.append(lm.Sums(replay.sums(), names.n))
    for i, s in enumerate(history):
        if i:
            bucket.sweep(history[i - 1])
        if i < lm.BURN:
            continue
        for (w, u), k in key.items():  # one probability at a time, from plain sums over the seating
            j = int(names.classes(np.array([u]))[0])
            t0 = sum(bucket.t0)
            at = int(bucket.w[k])
            q = next(x for x in range(len(bucket.qw)) if bucket.qw[x] == at and bucket.qk[x] == j)
            p0 = (max(bucket.c0[at] - s.d0 * bucket.t0[at], 0) + (1 + s.d0 * s.t0) / (len({*count, None}) + 1)) / (1 + s.t2.sum())
            p2 = (max(bucket.c2[q] - s.d2 * bucket.t2[q], 0) + (1 + s.d2 * s.t2[j]) * p0) / (1 + s.c2[j])
            if u < names.n:
                own = sum(c for (x, y), c in pairs.items() if y == u)
                p2 = (max(pairs[w, u] - s.d1 * bucket.t1[k], 0) + (1 + s.d1 * s.t1[u]) * p2) / (1 + own)
            p[k] += p2
            assert t0 > 0
    for i, t in enumerate(values):
        want = sum(math.log10(p[key[token(w), u]] / (lm.SWEEPS - lm.BURN)) for w, u in zip(toks(t), contexts(toks(t))))
        assert abs(got[i] - want) < 1e-8 * (len(toks(t)) + 1)


def test_awkward_rows(spark):
    docs = fixtures.awkward(spark)
    got = lm.score(docs).collect()
    assert len(got) == docs.count()
    assert min(r["n_tokens"] for r in got) == 1
    assert lm.score(fixtures.empty(spark)).count() == 0


def test_ids_of_other_types(spark):
    docs = fixtures.table(spark, ["a b", "c"]).selectExpr("concat('x', doc_id) AS doc_id", "text")
    assert sorted(r["doc_id"] for r in lm.score(docs).collect()) == ["x0", "x1"]
