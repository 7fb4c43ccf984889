"""Serving: filtered, paginated search over contributions and their claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def search(avis: DataFrame, claims: DataFrame, themes: DataFrame | None = None, needle: str | None = None, folded: str = "folded", stance: str | None = None) -> DataFrame:
    """Contributions with a claim in `themes` (column theme) that has `stance`, and whose folded text holds `needle`.

    Theme and stance must hold on one claim. With neither, contributions without claims stay."""
    if themes is not None or stance:
        hit = claims
        if themes is not None:
            hit = hit.join(themes, "theme", "left_semi")
        if stance:
            hit = hit.where(F.col("stance") == stance)
        avis = avis.join(hit.select("rank"), "rank", "left_semi")
    return avis.where(F.contains(F.col(folded), F.lit(needle))) if needle else avis


def page(found: DataFrame, order: list[str | Column], limit: int, offset: int) -> DataFrame:
    """One page in `order`; a negative limit is the rest."""
    out = found.orderBy(*order).offset(offset)
    return out if limit < 0 else out.limit(limit)
