"""Orderings and top-k. Ties differ by mode: keyword and vector lists by id upwards, fused lists by id downwards.

``k`` of 0 gives no rows. A global top-k is a bounded heap in every task; one by query is a ranked window whose limit is
applied before the shuffle as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ORDERS = {"asc": F.asc, "desc": F.desc}


def top(df: DataFrame, k: int, by: str = "score", id_: str = "doc_id", ties: str = "asc", largest: bool = True) -> DataFrame:
    if k <= 0:
        return df.limit(0)
    return df.orderBy(F.desc(by) if largest else F.asc(by), ORDERS[ties](id_)).limit(k)


def top_by(df: DataFrame, group: str, k: int, by: str = "score", id_: str = "doc_id", ties: str = "asc", largest: bool = True) -> DataFrame:
    """The first k of each group, with their rank from 1."""
    w = Window.partitionBy(group).orderBy(F.desc(by) if largest else F.asc(by), ORDERS[ties](id_))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max(k, 0))
