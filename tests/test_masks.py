"""Masks against Python's own patterns and a plain sweep."""

import random
import re

from pyspark.sql import functions as F

from plurivox.functions import masks, text

PATTERNS = [(r"[A-Z][a-z]+ [a-z]+", "[1]"), (r"and [a-z]+", "[2]"), (r"[a-z]+\.", "[3]"), (r"\d+", "[4]")]


def plain_sweep(value, patterns):
    spans, kept, out, last = sorted((m.start(), m.end(), mark) for p, mark in patterns for m in re.finditer(p, value)), [], [], 0
    for a, b, mark in spans:
        if not kept or a >= kept[-1][1]:
            kept.append((a, b, mark))
    for a, b, mark in kept:
        out += [value[last:a], mark]
        last = b
    return "".join(out) + value[last:]


def test_overlapping_matches(spark):
    rng = random.Random(3)
    words = ["The", "and", "cat", "sat.", "12", "é😀", "And", "7up", "mat.", "\n"]
    values = ["", "12", "The cat and the mat.12 ", *(" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(80))]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)] + [(-1, None)], "k int, t string").select("k", masks.mask_all(F.col("t"), PATTERNS).alias("m"))
    got = {r["k"]: r["m"] for r in df.collect()}
    assert got.pop(-1) is None
    assert got == {k: plain_sweep(v, PATTERNS) for k, v in enumerate(values)}


def anonymised(value):
    """The steps one after the other, with Python's patterns."""
    flags = lambda p: p.replace("(?iU)", "(?i)").replace("(?U)", "")
    for p, mark in text.PII[:3]:
        value = re.sub(flags(p), mark, value)
    social = re.compile(r"(?i)\b(?:insta(?:gram)?|snap(?:chat)?|tiktok|telegram|whats?app)\s*[:=]?\s*@?([\w][\w.]{1,29})")
    value = social.sub(lambda m: "[reseau]" if re.search(r"[\d._]", m[1]) else m[0], value)
    for p, mark in ((masks.STREET, "[adresse]"), (masks.POSTCODE, "[adresse]"), (masks.ID_NUMBER, r"\1[numero]")):
        value = re.sub(flags(p), mark, value)
    return re.sub(masks.PHONE_ABROAD, "[tel]", re.sub(masks.PHONE_FR, "[tel]", value))


def test_anonymised_texts(spark):
    values = [
        "J'habite 12 bis rue de la République 75011 Paris et je pense que la réforme est bonne",
        "insta: jean.dupont92 ou snap lea_b, mais instagram tous les jours, Telegram = @max7",
        "Mon numéro de dossier est 123 456-789, référence client : 4455, sécu 1 85 05 78 006 084",
        "Appelez le 06.12 34-56 78, +33 6 12 34 56 78 ou +44 20 7946 0958; pas 2024-01-02 ni 123456789012",
        "a.b@c.org, https://x.y/z, @moi; 5, avenue Foch; le 3 mai; 69001 lyon; 69001 Lyon",
        "immatriculation : 12-345 et dossier n° 77 88",
        "",
    ]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, t string").select("k", masks.anonymise(F.col("t")).alias("m"))
    got = {r["k"]: r["m"] for r in df.collect()}
    assert got == {k: anonymised(v) for k, v in enumerate(values)}
    assert got[1] == "[reseau] ou [reseau], mais instagram tous les jours, Telegram = [mention]" and got[5] == "immatriculation : [numero] et dossier n° [numero]"


def test_a_text_is_masked_once(spark):
    """Each pattern stands once in the plan, however often a later step uses the text, and masks are those of the plain chain."""
    texts = ["12 rue de la Paix 75001 Paris, +33 6 12 34 56 78", "x@y.org www.z.net @moi insta: jo.1 dossier n° 123456 00336 12345678", "a 0612345678 +44 20 7946 09581", "9+33612345678 90612345678 5+44 20 7946 0958", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select(masks.anonymise(F.col("text")).alias("m"))
    assert rows._jdf.queryExecution().analyzed().toString().count("lotissement") == 1
    got = [r["m"] for r in rows.collect()]
    assert got[2] == "a [tel] [tel]" and got[3] == texts[3] and got[4:] == ["", None]
    assert got[0].count("[adresse]") >= 1 and got[0].endswith("[tel]") and "[email] [url] [mention] [reseau]" in got[1] and "[numero]" in got[1]
