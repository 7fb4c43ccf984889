"""The ranking against scores counted one by one."""

import math
import re
from collections import Counter

import pyarrow as pa
import pytest

from plurivox.llm import lexical
from plurivox.llm.shared import Words

from . import fixtures

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    counted = [(i, Counter(terms_of(t))) for i, t in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    n_docs, tokens = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(terms_of(text))
    out = []
    for item, ts in wanted.items():
        scores = []
        for i, c, n in counted:
            m = 100 - 90 + (90 * n * n_docs) // tokens
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in ts if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, k + 1, None if null else i, -s) for k, (s, null, i) in enumerate(sorted(scores)[:10])]
    return sorted(out, key=str)


def got(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=str)


def items_frame(spark, items):
    return spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id long, text string, doc_id string")


def some_items():
    vocabulary = fixtures.VOCABULARY
    return [(1, " ".join(vocabulary[:30])), (2, " ".join(vocabulary[100:140]) + " THE and"), (3, None), (4, ""), (5, "nowhere-at-all"), (None, "one two"), (2, "three é" + "é" * 49), (6, "x end")]


def test_awkward_rows_equal_brute_force(spark):
    docs = fixtures.awkward(spark)
    assert got(lexical.search(docs, items_frame(spark, some_items()))) == brute([(r["doc_id"], r["text"]) for r in docs.collect()], some_items())


@pytest.mark.parametrize("parts", [1, 9])
def test_ties_windows_and_blocks(spark, parts, monkeypatch):
    # sparse, negative and repeated ids; many equal scores; items in several passes
    monkeypatch.setattr(lexical, "PAIRS", 20)
    words = fixtures.VOCABULARY
    rows = [(k * 977 - 40_000 if k % 3 else 5, f"{words[k % 7]} {words[k % 11]} {words[20 + k % 2]}") for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    items = [(k, f"{words[k % 7]} {words[k % 11]} zzz {words[20]}") for k in range(25)]
    assert got(lexical.search(docs, items_frame(spark, items))) == brute(rows, items)


def test_words_are_compared_by_their_bytes():
    names = pa.array(["alpha", "beta", "a" * 20, "a" * 19 + "b", "é"])
    terms = lexical.Terms(names)
    terms.hash[:] = 7  # all terms collide
    terms.run = len(names)
    words = Words(pa.array(["ALPHA beta " + "a" * 19 + "b gamma é " + "a" * 20]), chars=lexical._TERM)
    words._hash = words.hash * 0 + 7
    assert terms.find(words).tolist() == [0, 1, 3, -1, 4, 2]


def test_empty(spark):
    assert lexical.search(fixtures.empty(spark), items_frame(spark, [(1, "a")])).collect() == []
    assert lexical.search(fixtures.table(spark), items_frame(spark, [(1, None)])).collect() == []
