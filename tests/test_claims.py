"""Spans, stored claims and ideas against plain loops."""

import json
import random

from pyspark.sql import functions as F

from plurivox.operators import claims, ingest
from plurivox.sources.shared import checkpointed


def plain_align(text, asked):
    """(claim, text, spans, target) one claim after the other, a cursor for each part."""
    short, at = "", []
    for i, ch in enumerate(text):
        if not ch.isspace() or not (short and short[-1] == " " and text[i - 1].isspace()):
            short += " " if ch.isspace() else ch
            at.append(i)

    def find(part, begin):
        i = text.find(part, begin)
        i = text.find(part) if i < 0 else i
        if i >= 0:
            return i, i + len(part)
        sought = " ".join(part.split())
        j = short.find(sought)
        return None if j < 0 else (at[j], at[j + len(sought) - 1] + 1)

    cursor, out = {}, []
    for claim, parts, target in asked:
        spans = []
        for part in parts:
            key = (part or "").strip()
            span = find(key, cursor.get(key, 0)) if key else None
            if span:
                spans.append(span)
                cursor[key] = span[1]
        if spans:
            aim = find(target.strip(), 0) if target and target.strip() else None
            out.append((claim, " ".join(text[a:b] for a, b in spans), spans, aim))
    return out


def test_alignment_equals_a_plain_loop(spark):
    rng = random.Random(2)
    words = ["ab", "a", "é😀", "b.c", "\\E", "$1", "aa"]
    gaps = [" ", "  ", "\n", " \t ", " ", "   "]
    texts, asked = [], []
    for key in range(60):
        text = "".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randint(0, 40))) + rng.choice(["", "end", "  "])
        texts.append((key, rng.choice(["", " ", "\n\n"]) + text))
        for c in range(rng.randint(0, 6)):
            parts = []
            for _ in range(rng.randint(0, 4)):
                a = rng.randint(0, max(0, len(text) - 1))
                piece = text[a : a + rng.randint(1, 12)]
                kind = rng.random()
                parts.append(piece if kind < 0.5 else rng.choice(gaps).join(piece.split()) if kind < 0.8 else rng.choice(["nowhere", "", " ", "aa", None]))
            asked.append((key, c, parts, rng.choice([None, "", "ab", " a  ab", "zzz"])))
    texts.append((99, None))
    asked.append((99, 0, ["ab"], None))
    got = claims.align(spark.createDataFrame(texts, "k long, text string"), spark.createDataFrame(asked, "k long, claim int, parts array<string>, target string"), "k")
    span = lambda s: None if s is None else (s["start"], s["end"])
    rows = sorted((r["k"], r["claim"], r["text"], [span(s) for s in r["spans"]], span(r["target"])) for r in got.collect())
    want = sorted((k, c, t, s, aim) for k, text in texts if text is not None for c, t, s, aim in plain_align(text, [a[1:] for a in asked if a[0] == k]))
    assert rows == want and len(rows) > 60


def test_a_text_meets_its_claims_in_groups(spark, monkeypatch):
    """A text goes along once for each PARTS parts, not once a part, and repeats go on from group to group."""
    lines = ["same", "other line", "same", "x y", "same"] * 8
    text = "\n".join(lines)
    texts = spark.createDataFrame([(1, text)], "k long, text string")
    asked = [(1, c, [line, line.replace(" ", " \t ")], "same") for c, line in enumerate(lines)]
    want = plain_align(text, [a[1:] for a in asked])
    asked = spark.createDataFrame(asked, "k long, claim int, parts array<string>, target string")
    for parts in (10, 4096):
        monkeypatch.setattr(claims, "PARTS", parts)
        got = claims.align(texts, asked, "k")
        rows = sorted((r["claim"], r["text"], [tuple(s) for s in r["spans"]], tuple(r["target"])) for r in got.collect())
        assert rows == want
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]  # no text is repeated for a part after the join


def test_repeats_get_places_of_their_own(spark):
    texts = spark.createDataFrame([(1, "yes no yes  maybe yes")], "k long, text string")
    asked = spark.createDataFrame([(1, 0, ["yes", "yes"], "no"), (1, 1, ["yes"], None), (1, 2, ["yes"], None), (1, 3, ["yes maybe"], None)], "k long, claim int, parts array<string>, target string")
    rows = {r["claim"]: [tuple(s) for s in r["spans"]] for r in claims.align(texts, asked, "k").collect()}
    assert rows == {0: [(0, 3), (7, 10)], 1: [(18, 21)], 2: [(0, 3)], 3: [(7, 17)]}


def test_stored_forms(spark):
    raw = [
        json.dumps({"text": "b", "spans": [[1, 2], [3], [4, 5]], "target": [1, 2]}),
        json.dumps({"text": "b", "start": 1, "end": 2}),
        json.dumps({"text": "b", "spans": [[7]], "target": None}),
        json.dumps('say "b"'),
        "b c",
        "nowhere",
    ]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(raw)], "k int, raw string").select("k", claims.decode(F.col("raw"), F.lit('a b c say "b"')).alias("c"))
    got = [(r["c"]["text"], [tuple(s) for s in r["c"]["spans"]], r["c"]["target"] and tuple(r["c"]["target"])) for r in df.orderBy("k").collect()]
    assert got == [("b", [(1, 2), (4, 5)], (1, 2)), ("b", [(1, 2)], None), ("b", [(-1, -1)], None), ('say "b"', [(6, 13)], None), ("b c", [(2, 5)], None), ("nowhere", [(-1, -1)], None)]


def test_flattened_claims_are_numbered_in_order(spark):
    rows = [(f"s:{k}", 40 - k, float(k), "b a b", [json.dumps("b"), "a"][: k % 3]) for k in range(40)]
    df = spark.createDataFrame(rows, "avis_id string, ord int, weight double, text string, claims array<string>").repartition(5)
    flat = claims.flatten(df, "ord", checkpointed)
    got = [(r["claim_index"], r["avis_id"], r["pos"], r["weight"], r["text"]) for r in flat.orderBy("claim_index").collect()]
    want = [(a, p, w, t) for a, o, w, _, c in sorted(rows, key=lambda r: r[1]) for p, t in enumerate(["b", "a"][: len(c)])]
    assert got == [(i, *x) for i, x in enumerate(want)]
    order = {(r["avis_id"], r["pos"]): r["nth"] for r in claims.in_order(flat, "avis_id").collect()}
    assert order[("s:2", 0)] == 0 and order[("s:2", 1)] == 1


def test_ideas(spark):
    raw = spark.createDataFrame(
        [
            ("s", "1", "  Mail me: a.b@c.org!!!!  ", " ", "me", " 2024 ", "2.5", {"topic": "x", "lang": "no"}),
            ("s", "2", "!!", "fr", None, None, "many", None),
            ("s", "3", "le la les et", None, None, None, "many", None),
            ("s", "4", None, "fr", "me", None, None, None),
        ],
        "source string, raw_id string, text string, lang string, author string, ts string, weight string, props map<string, string>",
    )
    rows = {r["id"]: r for r in ingest.ideas(raw, "x" * 32).collect()}
    assert set(rows) == {"s:1", "s:3"}
    first, other = rows["s:1"], rows["s:3"]
    assert first["text"] == "Mail me: [email]!!!!" and first["text_clean"] == "Mail me: [email]!" and first["ts"] == "2024" and first["weight"] == 2.5 and first["props"] == {"topic": "x"}
    assert other["lang"] == "fr" and other["weight"] == 1.0 and other["ts"] == "" and other["props"] == {} and len(other["author_hash"]) == 16
