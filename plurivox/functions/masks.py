"""Masks over the matches of many patterns, overlapping ones included, and the extended patterns of personal data; all as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import PII, let

# Patterns of personal data beyond addresses of the net, and their marks.
STREETS = (
    r"rue|avenue|av\.?|boulevard|bd|impasse|chemin|allée|allee|place|route|quai|square|villa|cours|passage|sentier|voie|cité|cite|résidence|residence|"
    r"hameau|clos|lotissement|lieu-dit"
)
STREET = rf"(?iU)\b\d{{1,4}}\s*(?:bis|ter|quater)?,?\s*(?:{STREETS})\s+(?:de\s+la\s+|de\s+l['’]|de\s+|du\s+|des\s+|d['’])?(?:[A-Za-zÀ-ÖØ-öø-ÿ][\w\-'’]*\s+){{0,4}}[A-Za-zÀ-ÖØ-öø-ÿ0-9][\w\-'’]*"
POSTCODE = r"(?U)\b\d{5}\s+[A-ZÀ-Ý][\w\-'’]{1,30}\b"
ID_LABELS = (
    r"num[ée]ro\s+de\s+dossier|n[°o]\s*de\s+dossier|dossier\s+n[°o]|num[ée]ro\s+de\s+s[ée]curit[ée]\s+sociale|num[ée]ro\s+de\s+s[ée]cu\b|s[ée]cu\b|num[ée]ro\s+fiscal|"
    r"num[ée]ro\s+client|num[ée]ro\s+d['’]allocataire|num[ée]ro\s+de\s+s[ée]jour|num[ée]ro\s+d['’]identifiant|immatriculation|plaque\s+d['’]immatriculation|"
    r"r[ée]f[ée]rence(?:\s+(?:client|dossier|allocataire))?"
)
ID_NUMBER = rf"(?iU)((?:{ID_LABELS})\s*(?:est|:|=|n[°o])?\s*)(?:\d[\s\-]?){{2,20}}\d"
#: A network's name and a pseudonym after it, which holds a digit, a point or a line.
SOCIAL = r"(?iU)\b(?:insta(?:gram)?|snap(?:chat)?|tiktok|telegram|whats?app)\s*[:=]?\s*@?(?=[\w.]{0,29}[\d._])\w[\w.]{1,29}"
PHONE_FR = r"(?:\+(?<!\d\+)33\s?[1-9]|0(?<!\d0)(?:033\s?[1-9]|[1-9]))(?:[\s.\-]?\d{2}){4}(?!\d)"
PHONE_ABROAD = r"\+(?<!\d\+)(?!33)\d{1,3}[\s.\-]?(?:\d[\s.\-]?){7,13}\d(?!\d)"


def matches(text: Column, pattern: str, mark: str) -> Column:
    """start, end, mark of all matches of a pattern that matches no empty text, in order: the pieces between them and the matches themselves, put together,
    tell where each stands."""
    pieces = F.split(text, pattern, -1)
    both = lambda found: F.zip_with(F.slice(pieces, 1, F.size(found)), found, lambda p, m: F.struct(F.length(p).alias("p"), F.length(m).alias("m")))
    none = F.array().cast("array<struct<p: int, m: int>>")
    sizes = let(F.regexp_extract_all(text, F.lit(pattern), 0), lambda found: F.when(F.size(found) == 0, none).otherwise(both(found)))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, end: int, mark: string>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        begin = s["at"] + x["p"]
        one = F.struct(begin.cast("int").alias("start"), (begin + x["m"]).cast("int").alias("end"), F.lit(mark).alias("mark"))
        return F.struct((begin + x["m"]).cast("int").alias("at"), F.concat(s["out"], F.array(one)).alias("out"))

    return F.aggregate(sizes, start, step)["out"]


def first_wins(spans: Column) -> Column:
    """Of spans (start, end, mark) in the order of start, end and mark those that begin at or after the end of the last one kept."""
    last = lambda kept: F.coalesce(F.element_at(kept, -1)["end"], F.lit(0))
    empty = F.array().cast("array<struct<start: int, end: int, mark: string>>")
    return F.aggregate(F.array_sort(spans), empty, lambda kept, s: F.when((F.size(kept) > 0) & (s["start"] < F.when(F.size(kept) > 0, last(kept)).otherwise(0)), kept).otherwise(F.concat(kept, F.array(s))))


def replaced(text: Column, spans: Column) -> Column:
    """`text` with the marks of spans that do not overlap in their places."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda s, x: F.struct(x["end"].alias("at"), F.concat(s["out"], F.substr(text, s["at"] + 1, x["start"] - s["at"]), x["mark"]).alias("out"))
    return F.aggregate(spans, start, step, lambda s: F.concat(s["out"], F.substr(text, s["at"] + 1)))


def mask_all(text: Column, patterns: list[tuple[str, str]]) -> Column:
    """`text` with the matches of all patterns (pattern, mark) masked at once: where matches overlap, the one that begins first wins (of those that begin
    together the shorter, then the smaller mark)."""
    # bound, for a text that is itself worked out would be so again in each use, and inside `replaced` for each match
    return let(text, lambda t: replaced(t, first_wins(F.concat(*(matches(t, p, m) for p, m in patterns)))))


def _masked_where(text: Column, needs: Callable[[Column], Column], pattern: str, mark: str) -> Column:
    return let(text, lambda t: F.when(needs(t), F.regexp_replace(t, pattern, mark)).otherwise(t))


def anonymise(text: Column) -> Column:
    """Mail, links, mentions, pseudonyms of networks, postal addresses, announced numbers and telephones masked; the words that announce a number stay."""
    # the larger part of the texts lacks what a pattern needs, which is found out faster
    digit, sign, link = (lambda t: t.rlike(r"\p{Nd}")), (lambda t: F.contains(t, F.lit("@"))), (lambda t: F.contains(t, F.lit("http")) | F.contains(t, F.lit("www.")))
    steps = [(*PII[0], sign), (*PII[1], link), (*PII[2], sign), (SOCIAL, "[reseau]", None), (STREET, "[adresse]", digit), (POSTCODE, "[adresse]", digit), (ID_NUMBER, "$1[numero]", digit)]
    for pattern, mark, needs in steps:
        text = F.regexp_replace(text, pattern, mark) if needs is None else _masked_where(text, needs, pattern, mark)
    return mask_all(text, [(PHONE_FR, "[tel]"), (PHONE_ABROAD, "[tel]")])
