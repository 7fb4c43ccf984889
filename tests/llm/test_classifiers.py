import random

import numpy as np
import pyarrow as pa

from plurivox.llm import quality, shared, toxicity

from . import fixtures


def labelled(spark, n=400):
    """Texts with bad words (toxic) or repeated and decorated words (bad quality), with labels."""
    rng = random.Random(2)
    values, labels = [], []
    for k in range(n):
        words = fixtures.prose(rng, rng.randint(20, 80), 600).split()
        toxic, good = int(k % 5 == 0), int(k % 4 != 0)
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["nastyword", "vileterm", "foulthing"])
        if not good:
            words = [words[0]] * 30 + words if k % 8 else [w + "%%%" for w in words]
        values.append(" ".join(words))
        labels.append((k, good, toxic))
    return fixtures.table(spark, values), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_rows(spark):
    docs, labels = labelled(spark)
    rows = toxicity.digest(toxicity.score(docs, toxicity.fit(docs, labels))).join(labels, "doc_id").where("held_out").collect()
    hit = sum(r["predicted"] == r["toxic"] for r in rows)
    assert len(rows) > 80 and hit / len(rows) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)


def test_toxicity_ignores_other_columns(spark):
    docs, labels = labelled(spark, 120)
    model = toxicity.fit(docs, labels)
    from pyspark.sql import functions as F

    other = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("y")).withColumn("doc_id", F.col("doc_id") + 10_000)
    assert sorted(r["score"] for r in toxicity.score(docs, model).collect()) == sorted(r["score"] for r in toxicity.score(other, model).collect())


def test_toxicity_awkward(spark):
    docs, labels = labelled(spark, 120)
    model = toxicity.fit(docs, labels)
    rows = fixtures.awkward(spark)
    assert toxicity.score(rows, model).where("score between 0 and 1").count() == rows.count()
    assert toxicity.score(fixtures.empty(spark), model).count() == 0
    assert {r["score"] for r in toxicity.score(rows, toxicity.fit(docs, labels.where("toxic = 0"))).collect()} == {0.0}
    assert {r["score"] for r in toxicity.score(rows, toxicity.fit(docs, labels.limit(0))).collect()} == {0.0}


def test_scores_do_not_depend_on_steps():
    model = toxicity.Model()
    texts = pa.array(["a b c d", "", None, "one", "x y " * 50, "two words"])
    together = model.score(*toxicity.prepare(texts))
    alone = [model.score(*toxicity.prepare(texts[k : k + 1]))[0] for k in range(len(texts))]
    assert np.allclose(together, alone)


def test_quality_on_unseen_rows(spark):
    docs, labels = labelled(spark)
    train = labels.where("doc_id % 3 != 0")
    rows = quality.judge(docs, train).join(labels, "doc_id").where("doc_id % 3 = 0").collect()
    good, bad = [r["keep"] for r in rows if r["quality"] == 1], [r["keep"] for r in rows if r["quality"] == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.1


def sited(spark, n=900):
    """Texts that say nothing, of sites that do: host `junk` is bad but for its path `good`, `fine` is good, `tiny` has one bad label."""
    rng = random.Random(6)
    rows, labels = [], []
    for k in range(n):
        source = ("junk/a", "junk/good", "fine/a", "fine/b", "other")[k % 5] if k else "tiny/x"
        good = {"junk/a": 0.1, "junk/good": 0.85, "fine/a": 0.95, "fine/b": 0.95, "other": 0.6, "tiny/x": 0.0}[source]
        rows.append((k, fixtures.prose(rng, 20), "en", source))
        if k % 3 == 0:
            labels.append((k, int(rng.random() < good)))
    rows += [(n, "more", "en", "tiny/x"), (n + 1, "of", "en", "tiny/y"), (n + 2, "these", "en", "unseen/z"), (n + 3, "here", "en", "junk/new")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_sites_turn_verdicts(spark):
    """With the same evidence everywhere, labelled outcomes of a site decide; sparse sites stay near their parents."""
    docs, labels = sited(spark)
    got = {r["doc_id"]: r for r in quality.judge(docs, labels, quality.Model(0.4)).collect()}
    of = lambda source: [r for k, r in got.items() if k % 3 and k < 900 and f"{r['host']}/{r['path']}".startswith(source)]
    assert not any(r["keep"] for r in of("junk/a")) and all(r["keep"] for r in of("junk/good") + of("fine"))
    top, junk = got[902]["shift"], got[903]["shift"]
    assert junk < min(top, got[1]["shift"]) and of("junk/a")[0]["shift"] < junk
    assert abs(got[900]["shift"] - top) < abs(of("junk/a")[0]["shift"] - top) / 2
    assert sorted(r["doc_id"] for r in quality.keep(docs, labels, quality.Model(0.4)).collect()) == sorted(k for k, r in got.items() if r["keep"])


def test_empirical_bayes_against_brute_force(spark):
    docs, labels = sited(spark)
    got = {r["doc_id"]: r for r in quality.judge(docs, labels, quality.Model(0.4)).collect()}
    p = 1 / (1 + np.exp(-0.4))
    own = {r["doc_id"]: (r["quality"] - p, p * (1 - p)) for r in labels.collect()}
    site = {k: (r["host"], r["path"]) for k, r in got.items()}

    def total(ids):
        return sum(own[i][0] for i in ids), sum(own[i][1] for i in ids)

    hosts, paths = {h for h, _ in (site[i] for i in own)}, {site[i] for i in own}
    s, n = total(own)
    top = s / (n + 1)
    by_host = {h: total([i for i in own if site[i][0] == h]) for h in hosts}
    rest = {h: (s - top * n, n) for h, (s, n) in by_host.items()}
    vary = lambda parts: max(0.0, min(quality.WIDEST, sum(s * s - n for s, n in parts) / sum(n * n for _, n in parts)))
    host_v = vary(rest.values())
    mean = {h: top + s * host_v / (1 + n * host_v) for h, (s, n) in rest.items()}
    by_path = {x: total([i for i in own if site[i] == x]) for x in paths}
    path_v = vary([(s - mean[x[0]] * n, n) for x, (s, n) in by_path.items()])
    for k, r in got.items():
        a, b = own.get(k, (0.0, 0.0))
        shift = top
        if r["host"] in by_host:
            s, n = by_host[r["host"]][0] - a, by_host[r["host"]][1] - b
            shift = top + (s - top * n) * host_v / (1 + n * host_v)
            if site[k] in by_path:
                s, n = by_path[site[k]][0] - a, by_path[site[k]][1] - b
                shift += (s - shift * n) * path_v / (1 + n * path_v)
        assert np.isclose(r["shift"], shift) and np.isclose(r["posterior"], 1 / (1 + np.exp(-0.4 - shift)))
    assert host_v > 0 and path_v > 0


def test_quality_awkward(spark):
    docs, labels = labelled(spark, 120)
    rows = fixtures.awkward(spark)
    model = quality.fit(docs, labels)
    judged = quality.judge(rows, labels, model)
    assert judged.count() == rows.count() and judged.where("posterior between 0 and 1").count() == rows.count()
    names = ("c0", "host", "path", "z", "h", "p", "s", "s1", "score", "info", "prior", "variance", "shift", "posterior", "own_score", "top", "evidence", "_gone", "_row", "_id")
    clash = rows.selectExpr("*", *(f"'x' AS {c}" for c in names))
    kept = quality.keep(clash, labels)
    assert kept.columns == clash.columns and all(r["z"] == r["host"] == "x" for r in kept.collect())
    assert quality.judge(fixtures.empty(spark), labels, model).count() == 0
    assert quality.judge(rows, labels.limit(0), model).where("shift = 0").count() == rows.count()
    assert quality.keep(rows, labels.limit(0)).count() == rows.count()
    twice = labels.union(labels)
    assert len(quality.fit(docs.union(docs), twice).w) == len(model.w) and np.allclose(quality.fit(docs.union(docs), twice).w, model.w)


def test_words_and_hashes():
    col = pa.array(["A bc  A", None, "", "long" * 20 + " é", " x"])
    w = shared.Words(col)
    assert np.diff(w.first).tolist() == [3, 0, 0, 2, 1]
    assert w.hash[0] == w.hash[2] != w.hash[1]
    alone = shared.Words(pa.array(["long" * 20]))
    assert alone.hash[0] == w.hash[3]
    assert shared.Words(col.slice(3, 2)).hash.tolist() == w.hash[3:].tolist()


def test_toxicity_model_does_not_depend_on_partitioning(spark):
    docs, labels = labelled(spark, 150)
    docs = docs.union(docs.where("doc_id < 9"))
    one, other = toxicity.fit(docs.coalesce(1), labels), toxicity.fit(docs.repartition(7), labels.repartition(3))
    assert np.array_equal(one.e, other.e) and np.array_equal(one.o, other.o) and np.array_equal(one.cuts, other.cuts)


def test_toxicity_maxima_equal_plain_loops():
    model = toxicity.Model(seed=3)
    buckets, first, _ = toxicity.prepare(pa.array(["a b c d a", "", "one", "x y x z w v u"]))
    got = model.maxima(buckets, first)[0]
    for row in range(len(first) - 1):
        x = [model.e[b].sum(axis=0) for b in buckets[first[row] : first[row + 1]]]
        for k, width in enumerate(toxicity.WIDTHS):
            for q in range(toxicity.FILTERS):
                places = [sum(float(x[i + j] @ model.f[k][q, j]) for j in range(width)) + float(model.fb[k, q]) for i in range(len(x) - width + 1)]
                assert np.isclose(got[row, k * toxicity.FILTERS + q], max([0.0, *places]), atol=1e-5)
