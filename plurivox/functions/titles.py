"""Clean-up of generated titles and sections, brackets of ages, colours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def title(text: Column, words: int = 10) -> Column:
    """The first line without bullets, quotes and a leading mark such as `Title:`; `words` words at most."""
    line = F.trim(F.substring_index(F.ltrim(text), "\n", 1))
    line = F.regexp_replace(line, r"^[\-*#>\d.)\s]+", "")
    line = F.regexp_replace(line, r"(?i)^(title|titre|titel|título)\s*:\s*", "")
    line = F.regexp_replace(line, "^[\"'«»“”]+|[\"'«»“”.]+$", "")
    return F.array_join(F.slice(F.split(F.trim(line), r"\s+"), 1, words), " ")


def section(markdown: Column, heading: str) -> Column:
    """The text under a Markdown heading up to the next heading."""
    return F.trim(F.regexp_extract(markdown, rf"(?ms)^#+\s*{heading}\s*$\n(.*?)(?=^#|\z)", 1))


def age_bracket(age: Column) -> Column:
    """Bracket of an age in years, null outside 0 to 120."""
    return (
        F.when((age < 0) | (age > 120), F.lit(None)).when(age < 18, "under 18").when(age < 25, "18-24").when(age < 35, "25-34").when(age < 50, "35-49")
        .when(age < 65, "50-64").when(age <= 120, "65 and over")
    )


def colour(i: Column, n: Column) -> Column:
    """#rrggbb of hue i / n at saturation 0.6 and value 0.9."""
    h = F.pmod(i / n, F.lit(1.0)) * 6
    sector, f = F.floor(h), h - F.floor(h)
    v, s = F.lit(0.9), 0.6
    p, q, t = v * (1 - s), v * (1 - s * f), v * (1 - s * (1 - f))
    hexed = lambda x: F.lpad(F.lower(F.hex(F.round(x * 255).cast("int"))), 2, "0")
    pick = lambda six: F.get(F.array(*six), sector.cast("int"))
    return F.concat(F.lit("#"), hexed(pick([v, q, p, p, t, v])), hexed(pick([t, v, v, q, p, p])), hexed(pick([p, p, t, v, v, q])))
