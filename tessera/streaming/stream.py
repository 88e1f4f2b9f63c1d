"""The changelog as a stream.

Each micro-batch is compacted to a few rows a document and written as its own delta, named by the batch, so that a
batch that is repeated after a failure overwrites what it wrote and nothing else. The cost of a batch follows the batch, not the
state. Reading folds the base and all deltas; ``compact`` merges them to a base, a folder of its own that no batch of a later
stream is named like. Progress is the highest position of what is committed.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.settings import IndexNotReady
from tessera.sources import generations
from tessera.streaming.changelog import CHANGELOG, compacted, fold, schema, tombstones, watermark


class ChangelogView:
    """The current documents of a stream of commands, kept in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, dim: int | None = None):
        self.spark, self.path, self.dim = spark, path, dim

    def start(self, stream: DataFrame, trigger: dict | None = None):
        """Starts the query; ``trigger`` as for ``DataStreamWriter.trigger``, by default all that is there and no more."""

        def apply(batch: DataFrame, batch_id: int) -> None:
            # the log's end is kept even where the batch changes no document
            end = batch.agg(F.max("raft_index").alias("raft_index")).where("raft_index IS NOT NULL")
            filler = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema(CHANGELOG) if f.name != "raft_index"]
            rows = compacted(batch, self.dim).unionByName(end.select("raft_index", *filler).withColumn("op", F.lit("Mark")))
            rows.select(*schema(CHANGELOG).names).write.mode("overwrite").parquet(f"{self.path}/deltas/batch={batch_id}")

        return stream.writeStream.foreachBatch(apply).option("checkpointLocation", f"{self.path}/progress").trigger(**(trigger or {"availableNow": True})).start()

    def deltas(self) -> DataFrame:
        """All committed rows, those of the base too; none before the first batch."""
        base = generations.current(self.spark, f"{self.path}/base", CHANGELOG)
        try:
            return base.unionByName(self.spark.read.schema(CHANGELOG + ", batch int").parquet(f"{self.path}/deltas").drop("batch"))
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return base

    def documents(self) -> DataFrame:
        return fold(self.deltas().where("op <> 'Mark'"), self.dim)

    def tombstones(self) -> DataFrame:
        return tombstones(self.deltas().where("op <> 'Mark'"), self.dim)

    def applied(self) -> int:
        """The highest position that is visible; 0 before any."""
        return watermark(self.deltas()).first().applied or 0

    def compact(self, to: str) -> ChangelogView:
        """The same view in another folder, as its base. Streams go on in either: what they bring is folded with the base, also where
        they bring a part of it again."""
        rows = self.deltas()
        mark = rows.where("op = 'Mark'").orderBy(F.desc("raft_index")).limit(1)
        generations.replace(compacted(rows.where("op <> 'Mark'"), self.dim).select(*mark.columns).unionByName(mark), f"{to}/base")
        return ChangelogView(self.spark, to, self.dim)

    def wait_for(self, position: int, timeout: float, poll: float = 0.1) -> int:
        """Waits until the position is visible."""
        until = time.monotonic() + timeout
        while (now := self.applied()) < position:
            if time.monotonic() >= until:
                raise IndexNotReady(f"position {position} isn't visible yet, {now} is")
            time.sleep(poll)
        return now


def read_changelog(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A folder of Parquet files of commands as a stream."""
    r = spark.readStream.schema(CHANGELOG)
    return (r.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else r).parquet(path)
