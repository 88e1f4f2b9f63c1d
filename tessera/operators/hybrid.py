"""Fusion of a keyword and a vector list: each has 2k rows and is divided by its own best score (0 where that isn't
positive); score = weight * keyword + (1 - weight) * vector over the union of ids. The weight isn't clamped."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.vectors import normalized
from tessera.operators.topk import top, top_by

DIGITS = 6


def fuse_by(keyword: DataFrame, vector: DataFrame, group: str, k: int = 10, weight: float = 0.5) -> DataFrame:
    """The same for many queries: (group, doc_id, score, rank) from two lists (group, doc_id, score), 2k rows a query each."""
    w = Window.partitionBy(group)
    parts = []
    for found, share in ((keyword, weight), (vector, 1 - weight)):
        best = F.greatest(F.lit(0.0), F.max("score").over(w))
        parts.append(found.select(group, "doc_id", (normalized(F.col("score"), best) * share).alias("part")))
    both = parts[0].unionByName(parts[1]).groupBy(group, "doc_id").agg(F.round(F.sum("part"), DIGITS).alias("score"))
    return top_by(both, group, k, ties="desc")


def _scaled(found: DataFrame, weight: float) -> DataFrame:
    """The list holds 2k rows, so that one task may see it whole."""
    best = F.greatest(F.lit(0.0), F.max("score").over(Window.partitionBy()))
    return found.select("doc_id", (normalized(F.col("score"), best) * weight).alias("part"))


def fuse(keyword: DataFrame, vector: DataFrame, k: int = 10, weight: float = 0.5) -> DataFrame:
    """(doc_id, score) from two lists (doc_id, score) that are cut to 2k already."""
    both = _scaled(keyword, weight).unionByName(_scaled(vector, 1 - weight))
    return top(both.groupBy("doc_id").agg(F.round(F.sum("part"), DIGITS).alias("score")), k, ties="desc")
