"""Typed side columns of documents: numbers, booleans and keywords, all of them nullable."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GROUPS = (("numeric", "numerics", "bigint"), ("boolean", "booleans", "boolean"), ("keyword", "keywords", "string"))


def number_range(df: DataFrame, column: str, low, high) -> DataFrame:
    """low <= column <= high; nulls are out."""
    return df.where(F.col(column).between(low, high))


def equals(df: DataFrame, column: str, value) -> DataFrame:
    return df.where(F.col(column) == value)


def true_rows(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column))


def false_rows(df: DataFrame, column: str) -> DataFrame:
    """Nulls are neither true nor false."""
    return df.where(~F.col(column))


def distinct_keywords(df: DataFrame, column: str, order: str) -> DataFrame:
    """Distinct keywords with the least ``order`` at which each occurs, in that order."""
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("keyword")).agg(F.min(order).alias("first_seen")).orderBy("first_seen", "keyword")


def as_bitmap(df: DataFrame, id_: str) -> DataFrame:
    """(bucket, bitmap, n): the rows' ids as bitmaps, one for each bucket of ids."""
    b = df.groupBy(F.bitmap_bucket_number(F.col(id_)).alias("bucket"))
    return b.agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col(id_))).alias("bitmap"), F.countDistinct(id_).alias("n"))


def pivoted(rows: DataFrame, keep: list[str]) -> DataFrame:
    """Rows with arrays ``numerics``, ``booleans``, ``keywords`` as columns numeric_0, ... up to the widest row; what a row
    lacks is null."""
    widest = rows.agg(*(F.max(F.size(a)).alias(a) for _, a, _ in GROUPS)).first()
    cols = [F.get(a, F.lit(i)).cast(t).alias(f"{name}_{i}") for name, a, t in GROUPS for i in range(max(0, widest[a] or 0))]
    return rows.select(*keep, *cols)
