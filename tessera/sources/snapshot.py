"""Snapshots: the live documents as Parquet with a version that a reader checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.settings import UnsupportedSnapshot
from tessera.streaming.changelog import DOCUMENT

VERSION = 3


def save(docs: DataFrame, path: str, applied: int) -> None:
    docs.write.mode("overwrite").parquet(f"{path}/v={VERSION}/documents")
    docs.sparkSession.createDataFrame([(VERSION, applied)], "version int, applied long").coalesce(1).write.mode("overwrite").json(f"{path}/info")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """(documents, position); a later version is refused."""
    info = spark.read.schema("version int, applied long").json(f"{path}/info").first()
    if info.version > VERSION:
        raise UnsupportedSnapshot(f"version {info.version}; this reads up to {VERSION}")
    return spark.read.schema(DOCUMENT).parquet(f"{path}/v={info.version}/documents"), info.applied


def estimated_size(docs: DataFrame) -> DataFrame:
    """(docs, bytes): contents, 4 bytes a vector component, metadata as JSON."""
    one = F.coalesce(F.octet_length("content"), F.lit(0)) + 4 * F.greatest(F.coalesce(F.size("embedding"), F.lit(0)), F.lit(0)) + F.coalesce(F.octet_length(F.to_json("metadata")), F.lit(0)) + 24
    return docs.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum(one), F.lit(0)).alias("bytes"))
