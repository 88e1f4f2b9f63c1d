"""Numbered folders of which readers take the highest that was committed.

A table that is to be replaced is written beside the old one; it counts once its ``_SUCCESS`` file is there, so a job that fails
halfway leaves readers with what they had.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def committed(spark: SparkSession, folder: str) -> int:
    """The highest N with a finished ``gen-N``; 0 where there is none. One listing, whatever the tables' size."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(conf)
    if not fs.exists(path):
        return 0
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    numbers = sorted((int(n[4:]) for n in names if n.startswith("gen-") and n[4:].isdigit()), reverse=True)
    return next((n for n in numbers if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{folder}/gen-{n}/_SUCCESS"))), 0)


def current(spark: SparkSession, folder: str, ddl: str) -> DataFrame:
    """The rows of the highest generation; none before the first."""
    n = committed(spark, folder)
    return spark.read.schema(ddl).parquet(f"{folder}/gen-{n}") if n else spark.createDataFrame([], ddl)


def append(df: DataFrame, folder: str) -> None:
    """Adds rows to the highest generation."""
    df.write.mode("append").parquet(f"{folder}/gen-{max(1, committed(df.sparkSession, folder))}")


def replace(df: DataFrame, folder: str) -> int:
    """Writes the next generation, which may be made from the one before."""
    n = committed(df.sparkSession, folder) + 1
    df.write.mode("overwrite").parquet(f"{folder}/gen-{n}")
    return n
