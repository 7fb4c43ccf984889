import hashlib
import re

from plurivox.llm import substring

from . import fixtures


def brute(rows):
    docs = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in rows}
    least = {}
    for i, ws in docs.items():
        for k in range(len(ws) - 12):
            w = tuple(ws[k : k + 13])
            least[w] = min(least.get(w, i), i)
    out = {}
    for i, ws in docs.items():
        gone = set()
        for k in range(len(ws) - 12):
            if least[tuple(ws[k : k + 13])] < i:
                gone.update(range(k, k + 13))
        kept = " ".join(w for k, w in enumerate(ws) if k not in gone)
        out[i] = (len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_against_brute_force(spark):
    values = fixtures.texts()
    got = {r["doc_id"]: tuple(r)[1:] for r in substring.digest(fixtures.table(spark, values).repartition(5)).collect()}
    assert got == brute(enumerate(values))


def test_windows_at_every_offset(spark):
    import random

    rng = random.Random(5)
    passage = [rng.choice(fixtures.VOCABULARY) for _ in range(13)]
    values = [" ".join([rng.choice(fixtures.VOCABULARY) for _ in range(k)] + passage + [rng.choice(fixtures.VOCABULARY) for _ in range(4)]) for k in range(15)]
    got = {r["doc_id"]: tuple(r)[1:] for r in substring.digest(fixtures.table(spark, values).repartition(4)).collect()}
    assert got == brute(enumerate(values))
    assert all(got[k][1] >= 13 for k in range(1, 15))


def test_awkward_rows(spark):
    docs = fixtures.awkward(spark)
    got = substring.digest(docs).collect()
    assert len(got) == docs.count()
    assert [r["n_removed"] for r in got if r["doc_id"] is None] == [0]
    assert substring.digest(fixtures.empty(spark)).count() == 0
    assert {r["text"] for r in substring.dedup(fixtures.table(spark, [None, "a  b"])).collect()} == {"", "a b"}


def test_cover():
    marked = {p for p in range(substring.PERIOD) if p in substring.COVER}
    for i in range(7):
        for j in range(7):
            assert any((i + d) % 7 in marked and (j + d) % 7 in marked for d in range(7))
