"""Heavy grams of classes against a count of all grams."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from plurivox.operators import naming
from plurivox.plans import names
from plurivox.sources.shared import checkpointed


def texts():
    rng = random.Random(8)
    common, rare = [f"mot{c}" for c in "abcdefgh"], [f"{a}{b}{c}x" for a in "klmno" for b in "pqrs" for c in "tuvwyz"]
    rows = [(c, " ".join(rng.choice(common if rng.random() < 0.5 else rare) for _ in range(rng.randrange(40)))) for c in ("one", "two", "two", "two", None) for _ in range(30)]
    return [*rows, ("few", "Été à la mer, été ab"), ("few", None), ("none", "a b"), ("none", None), (None, "motb motb mota")]


def counted(rows):
    grams, docs = {}, Counter()
    for c, t in rows:
        ts = [w for w in (t or "").lower().replace(",", "").split() if len(w) > 2]
        grams.setdefault(c, Counter()).update([*ts, *(f"{a} {b}" for a, b in zip(ts, ts[1:]))])
        docs.update((c, w) for w in {*ts} | ({""} if ts else set()))
    return {c: g for c, g in grams.items() if g}, docs


def weights(rows, stop=()):
    grams, _ = counted(rows)
    f = sum(grams.values(), Counter())
    mean = sum(map(Counter.total, grams.values())) / len(grams)
    return {c: {t: round(n / g.total() * math.log(1 + mean / f[t]), 9) for t, n in g.items() if not set(t.split()) & set(stop)} for c, g in grams.items() if c}


def frame(spark, rows):
    return spark.createDataFrame(rows, "theme string, text string").repartition(3)


def test_token_counts_equal_a_count(spark):
    grams, docs = counted(texts())
    f = sum(grams.values(), Counter())
    got = {(r["theme"], r["term"]): (r["n"], r["docs"], r["f"]) for r in naming.token_counts(frame(spark, texts()), "theme", "text").collect()}
    held = Counter()
    for (_, t), n in docs.items():
        held[t] += n
    assert got == {(c, t): (grams[c][t], n, f[t]) if t else (n, n, held[""]) for (c, t), n in docs.items()}


@pytest.mark.parametrize("slots", [1 << 20, 64])
@pytest.mark.parametrize("stop", [None, ["mota", "motc", "kptx"]])
def test_heavy_grams_equal_a_count_of_all(spark, monkeypatch, slots, stop):
    """With 64 bits most words share theirs with one that may stand in a heavy 2-gram, which changes nothing."""
    monkeypatch.setattr(naming, "SLOTS", slots)
    docs = frame(spark, texts())
    words = stop and spark.createDataFrame([(w,) for w in stop], "term string")
    rows = naming.heavy_grams(docs, naming.token_counts(docs, "theme", "text"), "theme", "text", 10, checkpointed, words).collect()
    want = {}
    for c, ws in weights(texts(), stop or ()).items():
        tokens = sorted((w for t, w in ws.items() if " " not in t), reverse=True)
        want |= {(c, t): w for t, w in ws.items() if len(tokens) < 10 or w >= tokens[9]}
    assert {(r["theme"], r["term"]): r["weight"] for r in rows} == pytest.approx(want, abs=2e-9) and len(rows) == len(want)
    assert {c for c, _ in want} == {"one", "two", "few"} and any(" " in t for c, t in want if c != "few")


@pytest.mark.parametrize("name", ["keyword_picks", "ctfidf_grams"])
def test_only_grams_that_may_count_are_counted(spark, monkeypatch, tmp_path, name):
    """Tables of grams hold few of the 2-grams, whose number grows with the texts."""
    rng = random.Random(3)
    rare = [a + b + c for a in "bcdfgh" for b in "aeiou" for c in "klmnprst"]
    rows = []
    for k in range(90):
        pairs = [f"rare{rng.choice(rare)} mot{rng.choice('abcdefghijklmnopqrst')}{'xyz'[k % 3]}" for _ in range(60)]
        rows.append((k, f"s{k % 3}", " ".join(pairs)))
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    tables = []

    def kept(df):
        tables.append(checkpointed(df))
        return tables[-1]

    monkeypatch.setattr(names, "checkpointed", kept)
    found = names.QUERIES[name](spark, str(tmp_path)).collect()
    all_grams = len({(s, t) for s, g in counted([r[1:] for r in rows])[0].items() for t in g if " " in t})
    held = [t.where(F.col("term").contains(" ")).count() for t in tables if "term" in t.columns]
    assert found and held and max(held) < all_grams / 4
