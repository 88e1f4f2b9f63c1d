"""The folder for tables that a job writes and reads again."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new name in the folder that the cluster shares (``spark.checkpoint.dir``); where none is set, a local master,
    as in tests, gets a folder that goes with the process, and a cluster an error. All of an application's tables lie under its
    id, where they can be deleted once it has ended."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if at is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir names no folder that the cluster shares")
        own = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        at = f"file://{own}"
        spark.sparkContext.setCheckpointDir(at)
    return f"{at}/tessera-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def written(df: DataFrame, **options: object) -> DataFrame:
    """The rows as a table in the shared folder, read again."""
    path = shared_folder(df.sparkSession)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
