"""Keyword scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.plans.settings import Bm25Params


def idf(df: Column, n: Column) -> Column:
    """ln((n - df + 0.5) / (df + 0.5) + 1)."""
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def bm25(tf: Column, df: Column, n: Column, length: Column, avgdl: Column, params: Bm25Params | None = None) -> Column:
    """BM25+ of one term in one document (plain BM25 with delta 0); 0 in an empty corpus, or where tf is 0."""
    p = params or Bm25Params()
    norm = 1 - p.b + p.b * length / F.when(avgdl > 0, avgdl)
    value = idf(df, n) * (tf * (p.k1 + 1) / (tf + p.k1 * norm) + p.delta)
    return F.when((avgdl > 0) & (n > 0) & (tf > 0), value).otherwise(F.lit(0.0))
