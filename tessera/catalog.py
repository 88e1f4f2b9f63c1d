"""All queries of the engine's own operators with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.queries import documents, maintenance, search, text

MODULES = (text, search, documents, maintenance)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword search over all documents."""
    return search.kw_bm25plus_topk(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
