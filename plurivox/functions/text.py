"""Text functions as column expressions, inside code generation; only Unicode normalisation leaves the JVM."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed patterns of personal data and their marks, in the order in which they apply.
PII = (
    (r"(?U)\b[\w.+-]+@[\w-]+\.[\w.-]+\b", "[email]"),
    (r"https?://\S+|www\.\S+", "[url]"),
    (r"(?U)(?<!\w)@[A-Za-z0-9_.]{2,}", "[mention]"),
    (r"(?U)(?<!\d)(?:\+?\d[\s.\-]?){9,}\d(?!\d)", "[tel]"),
)
#: Words by which a text gives reasons.
REASON_MARKS = ("because", "since", "therefore", "parce que", "car ", "donc", "weil", "denn", "porque", "por eso")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is worked out once, however often `body` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


@F.pandas_udf(T.StringType())
def nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


def _folded(t: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn").casefold()


#: Latin, Greek, Cyrillic and their marks and punctuation: these fold sign by sign in the JVM, but for those that become several signs or change places.
_SIGNS = [chr(c) for lo, hi in ((0, 0x530), (0x1E00, 0x20D0)) for c in range(lo, hi)]
_HARD = "".join(c for c in _SIGNS if len(_folded(c)) > 1 or (unicodedata.combining(c) and unicodedata.category(c) != "Mn"))
_FOLDS = sorted((c for c in _SIGNS if c not in _HARD and _folded(c) != c), key=lambda c: _folded(c) == "")  # dropped ones last, as `translate` has it
_OTHER = "[^\\x00-\\u052F\\u1E00-\\u20CF]" + "".join(f"|\\u{ord(c):04X}" for c in _HARD if c != "ß")


@F.pandas_udf(T.StringType())
def _fold_others(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None else _folded(t))


def fold(text: str | Column) -> Column:
    """Without accents and case: canonical decomposition, marks dropped, case folded. Only texts with signs beyond `_SIGNS` leave the JVM."""
    text = F.col(text) if isinstance(text, str) else text
    other = F.coalesce(text.rlike(_OTHER), F.lit(False))
    here = F.translate(F.replace(text, F.lit("ß"), F.lit("ss")), "".join(_FOLDS), "".join(map(_folded, _FOLDS)))
    return F.when(other, _fold_others(F.when(other, text))).otherwise(here)


def mask_pii(text: Column) -> Column:
    for pattern, mark in PII:
        text = F.regexp_replace(text, pattern, mark)
    return text


def clean_text(text: Column, normalise: bool = True) -> Column:
    """Normalised text: control characters and wide spaces to spaces, personal data masked, runs of marks and spaces shortened, quotes and dashes plain."""
    text = F.coalesce(text, F.lit(""))
    text = nfc(text) if normalise else text
    text = F.regexp_replace(text, "[   \x00-\x08\x0b\x0c\x0e-\x1f\x7f]", " ")
    text = F.regexp_replace(mask_pii(text), r"([!?.,])\1{2,}", "$1")
    text = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.translate(text, "’“”–—", "'\"\"--")


def empty_like(text: Column, min_chars: int = 3, min_letters: int = 2) -> Column:
    return (F.length(text) < min_chars) | (F.length(F.regexp_replace(text, r"[^\p{L}]", "")) < min_letters)


def label(text: Column, size: int) -> Column:
    """At most `size` characters, cut at a word, with an ellipsis."""
    head = F.substring(text, 1, size)
    cut = F.regexp_replace(F.when(F.instr(head, " ") > 0, F.regexp_replace(head, " [^ ]*$", "")).otherwise(head), r"[,;:.\- ]+$", "")
    return F.when(F.length(text) <= size, text).otherwise(F.concat(F.rtrim(F.when(cut == "", head).otherwise(cut)), F.lit("…")))


def slug(text: Column, fallback: str = "item") -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", ""), F.lit("")), F.lit(fallback))


def author_hash(source: Column, author: Column, salt: str) -> Column:
    """Sixteen hex digits; the salt holds 32 characters at least."""
    if len(salt) < 32:
        raise ValueError("the salt needs 32 characters at least")
    return F.substring(F.sha2(F.concat_ws("|", F.lit(salt), source, author), 256), 1, 16)


def tokens(text: Column, least: int = 3) -> Column:
    """Lower-case runs of letters of `least` characters or more."""
    return F.regexp_extract_all(F.lower(text), F.lit(rf"(\p{{L}}{{{least},}})"), 1)


def reasoning_bonus(text: Column) -> Column:
    """Half a point for each reason mark and for a digit, one at most."""
    low = F.lower(text)
    hits = F.lit(0)
    for mark in REASON_MARKS:
        hits = hits + F.contains(low, F.lit(mark)).cast("int")
    return F.least(F.lit(1.0), (hits + text.rlike("[0-9]").cast("int")) / 2)


def readability(length: Column, low: int = 200, high: int = 1200) -> Column:
    """One inside [low, high], falling in proportion below and above."""
    return F.when(length <= 0, 0.0).when(length < low, length / low).when(length <= high, 1.0).otherwise(F.lit(float(high)) / length)
