"""The network against a plain loop and finite differences; languages of held-out texts."""

import math
import random

import numpy as np
import pytest

from plurivox.llm import langid

from . import fixtures

SYLLABLES = {"aa": "ba ko li mu ra", "bb": "sch ent ung ßer ein", "cc": "ção nho lha que õe"}


def made(lang, n, rng):
    parts = SYLLABLES[lang].split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n))


def corpus(n=400, seed=5):
    rng = random.Random(seed)
    names = sorted(SYLLABLES)
    return [(k, made(names[k % 3], rng.choice([4, 20, 150]), rng), names[k % 3] if k % 10 else None) for k in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, g, "clash") for i, t, g in rows], "doc_id long, text string, lang string, score string")


def plain(net, data):
    """Probabilities at every position of one window, step by step."""
    hid, soft = net.hidden, lambda x: x / (1 + abs(x))

    def states(codes, side):
        h, out = np.zeros(hid), []
        for c in codes:
            e, g = net.e[c], h @ net.u[side]
            z = np.array([(1 + soft(e[i] + g[i])) / 2 for i in range(hid)])
            r = np.array([(1 + soft(e[hid + i] + g[hid + i])) / 2 for i in range(hid)])
            cand = np.array([soft(e[2 * hid + i] + r[i] * g[2 * hid + i]) for i in range(hid)])
            h = h + z * (cand - h)
            out.append(h)
        return out

    ahead, back = states(list(data), 0), states([c + 256 for c in reversed(data)], 1)[::-1]
    rows = [a @ net.w[0] + b @ net.w[1] + net.b for a, b in zip(ahead, back)]
    return np.array([np.exp(x) / np.exp(x).sum() for x in rows])


def test_documents_equal_a_plain_loop(monkeypatch):
    monkeypatch.setattr(langid, "WINDOW", 7)
    monkeypatch.setattr(langid, "SIDE", 3)
    net = langid.Network(["x", "y", "z"], hidden=4, kind=np.float64)
    texts = [b"", b"abc", b"abcdefg", b"abcdefgh" * 4, b"\xc3\xa9t\xc3\xa9"]
    offsets = np.cumsum([0, *map(len, texts)])
    p = net.documents(np.frombuffer(b"".join(texts), np.uint8), offsets)
    for k, t in enumerate(texts):
        want = np.concatenate([plain(net, t[a : a + 7]) for a in range(0, len(t), 7)]).mean(axis=0) if t else np.zeros(3)
        assert np.allclose(p[k], want)


def test_gradients_equal_differences():
    net = langid.Network(["x", "y"], hidden=3, kind=np.float64)
    lens, buf = np.array([6, 4, 1]), np.frombuffer(b"abcaabbcabc", np.uint8)
    codes, y = langid.layout(lens, np.array([0, 6, 10]), buf, 6), np.array([0, 1, 1])
    _, grads = net.gradients(codes, lens, y)
    rng = np.random.default_rng(0)
    for p, g in zip(net.params(), grads):
        places = np.argwhere(np.abs(g) > 1e-9)
        for at in map(tuple, places[rng.permutation(len(places))[:12]]):
            kept = p[at]
            p[at] = kept + 1e-6
            up = net.gradients(codes, lens, y)[0]
            p[at] = kept - 1e-6
            down = net.gradients(codes, lens, y)[0]
            p[at] = kept
            assert math.isclose((up - down) / 2e-6, g[at], rel_tol=1e-4, abs_tol=1e-8)


@pytest.fixture(scope="module")
def judged(spark):
    rows = corpus()
    docs = frame(spark, rows)
    model = langid.fit(docs)
    return rows, docs, model, {r["doc_id"]: r for r in langid.predict(docs, model).collect()}


def test_held_out_texts(judged):
    rows, _, _, got = judged
    held = [(r[0], sorted(SYLLABLES)[r[0] % 3]) for r in rows if got[r[0]]["held_out"]]
    assert 80 < len(held) < 200
    assert sum(got[i]["lang_pred"] == lang for i, lang in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_the_model_does_not_depend_on_partitioning(judged):
    _, docs, model, _ = judged
    other = langid.fit(docs.repartition(7))
    assert all(np.array_equal(a, b) for a, b in zip(model.params(), other.params()))


def test_held_out_languages_are_never_learnt(spark, judged):
    rows, _, model, got = judged
    changed = frame(spark, [(i, t, "zz" if got[i]["held_out"] else g) for i, t, g in rows])
    assert langid.fit(changed).languages == model.languages


def test_awkward_rows(spark, judged):
    docs = fixtures.awkward(spark).withColumn("text", langid.F.when(langid.F.col("pos") == 9, "123 456").otherwise(langid.F.col("text")))
    texts = {r["pos"]: r["text"] for r in docs.collect()}
    got = langid.predict(docs.select("*", langid.F.lit(1).alias("held_out")), judged[2]).collect()
    assert len(got) == docs.count()
    unknown = [r for r in got if r["lang_pred"] == "und"]
    assert len(unknown) >= 4 and all(r["score"] == 0 for r in unknown)
    assert "123 456" in texts.values()


def test_nothing_to_learn_from(spark):
    assert langid.fit(fixtures.empty(spark)) is None
    assert langid.predict(fixtures.empty(spark), None).collect() == []
    assert {r["lang_pred"] for r in langid.predict(fixtures.table(spark), None).collect()} == {"und"}
    only = frame(spark, [(k, "some words here", "aa") for k in range(20)])
    assert {r["lang_pred"] for r in langid.predict(only, langid.fit(only)).collect()} == {"aa"}
