"""All registered queries of the library and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import arguments, claims, enrichment, ingestion, metrics, names, opinions, segments, spaces, streams, texts, vectors

MODULES = (vectors, texts, claims, arguments, segments, spaces, ingestion, opinions, names, metrics, streams, enrichment)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
