import re

from plurivox.llm import decontam

from . import fixtures

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items):
    wins = {}
    for i, t in items:
        ws = words(t)
        for k in range(max(1, len(ws) - 9) if ws else 0):
            wins.setdefault(tuple(ws[k : k + 10]), set()).add(i)
    sizes = {len(w) for w in wins}
    out = {}
    for d, t in docs:
        ws, hit, found = words(t), set(), set()
        for k in range(len(ws)):
            for n in sizes:
                w = tuple(ws[k : k + n])
                if len(w) == n and w in wins:
                    hit.update(range(k, k + n))
                    found |= wins[w]
        out[d] = (len(ws), len(hit), len(found), sorted(map(str, found)), bool(hit))
    return out


def items(spark, values):
    return spark.createDataFrame([(k, t, "clash") for k, t in enumerate(values)], "item_id long, text string, doc_id string")


def test_against_brute_force(spark):
    values = fixtures.texts()
    passages = [" ".join(values[4].split()[2:16]), "one", "Two words", values[8], values[8], None, "", "?!", "é" * 50, " ".join(["x"] * 12)]
    got = {r["doc_id"]: tuple(r)[1:] for r in decontam.contamination(fixtures.table(spark, values), items(spark, passages)).collect()}
    assert got == brute(enumerate(values), enumerate(passages))


def test_blocks_give_the_same(spark, monkeypatch):
    values = fixtures.texts(20)
    passages = [v for v in values[:8] if v]
    want = brute(enumerate(values), enumerate(passages))
    monkeypatch.setattr(decontam, "BLOCK", 7)
    assert {r["doc_id"]: tuple(r)[1:] for r in decontam.contamination(fixtures.table(spark, values), items(spark, passages)).collect()} == want


def test_awkward_rows(spark):
    docs = fixtures.awkward(spark)
    got = decontam.digest(decontam.contamination(docs, items(spark, ["one two"]))).collect()
    assert len(got) == docs.select("doc_id").distinct().count()
    assert decontam.contamination(fixtures.empty(spark), items(spark, ["a b"])).count() == 0
    assert {r["n_hit"] for r in decontam.contamination(docs, items(spark, [])).collect()} == {0}


def test_no_python_in_the_plan(spark):
    plan = decontam.contamination(fixtures.table(spark), items(spark, ["a b c"]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
