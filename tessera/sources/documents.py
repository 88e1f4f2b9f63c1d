"""Documents on storage: JSON ingest, a changelog table as the store, look-ups, and checksums."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources import generations
from tessera.streaming.changelog import CHANGELOG, METADATA, compacted, fold, schema, tombstones, watermark

INGEST = f"content string, embedding array<float>, metadata {METADATA}"


def read_json(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    """Documents to be indexed: one JSON object a line, or an array in each file (``lines=False``). Broken records are null."""
    return spark.read.schema(INGEST).option("multiLine", not lines).json(path)


def parse_json(raw: DataFrame, column: str = "value") -> DataFrame:
    """The same from a column of strings, as of a stream."""
    return raw.select(F.from_json(column, INGEST).alias("d")).select("d.*")


class DocumentStore:
    """A log of commands under ``path``; the current documents are its fold."""

    def __init__(self, spark: SparkSession, path: str, dim: int | None = None):
        self.spark, self.path, self.dim = spark, path, dim

    def append(self, commands: DataFrame) -> None:
        """Rows of the changelog's form; columns that are lacking are null."""
        have = set(commands.columns)
        cols = [F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in schema(CHANGELOG)]
        generations.append(commands.select(*cols), f"{self.path}/log")

    def log(self) -> DataFrame:
        return generations.current(self.spark, f"{self.path}/log", CHANGELOG)

    def replace(self, log: DataFrame) -> None:
        """Another log in place of this one, from which it may be made."""
        generations.replace(log.select(*schema(CHANGELOG).names), f"{self.path}/log")

    def compact(self) -> None:
        """The log without what is superseded."""
        self.replace(compacted(self.log(), self.dim))

    def put(self, docs: DataFrame, raft_index: int, at: int) -> None:
        """Upserts (id, content, embedding, metadata) under one position; ids are told apart by themselves."""
        one = [F.lit(raft_index).alias("raft_index"), F.lit(0).alias("ordinal"), F.lit("Index").alias("op"), F.col("id").alias("doc_id"), F.lit(at).alias("at")]
        self.append(docs.select(*one, "content", "embedding", "metadata"))

    def tombstone(self, ids: Iterable[int], raft_index: int, at: int = 0) -> None:
        rows = [(raft_index, i, "Delete", int(d), at) for i, d in enumerate(ids)]
        self.append(self.spark.createDataFrame(rows, "raft_index long, ordinal int, op string, doc_id long, at long"))

    def documents(self) -> DataFrame:
        return fold(self.log(), self.dim)

    def tombstones(self) -> DataFrame:
        return tombstones(self.log(), self.dim)

    def pointers(self) -> DataFrame:
        """(doc_id, raft_index) of every document ever indexed, deleted ones too, in order."""
        return self.log().where("op = 'Index'").groupBy("doc_id").agg(F.max("raft_index").alias("raft_index")).orderBy("doc_id")

    def get(self, doc_id: int) -> DataFrame:
        """The document, or no row. The filter reaches the log's scan, before the fold."""
        return fold(self.log().where(F.col("doc_id") == doc_id), self.dim)

    def exists(self, ids: DataFrame) -> DataFrame:
        """Those of the ids that were ever indexed, whether they are live or not."""
        return ids.join(self.pointers().select("doc_id"), "doc_id", "left_semi")

    def live(self, ids: DataFrame) -> DataFrame:
        """Those of the ids that are live."""
        return ids.join(self.documents().select(F.col("id").alias("doc_id")), "doc_id", "left_semi")

    def clear(self) -> None:
        self.replace(self.spark.createDataFrame([], CHANGELOG))

    def applied(self) -> int:
        return watermark(self.log()).first().applied or 0


def checksums(df: DataFrame, id_: str, column: str) -> DataFrame:
    """(id, bytes, crc) of a column, to be held against ``verify``."""
    return df.select(F.col(id_), F.octet_length(column).alias("bytes"), F.crc32(F.encode(F.col(column), "UTF-8")).alias("crc"))


def verify(df: DataFrame, sums: DataFrame, id_: str, column: str) -> DataFrame:
    """Rows whose length or checksum isn't what was recorded, and those that are on one side only."""
    now = checksums(df, id_, column).withColumnsRenamed({"bytes": "bytes_now", "crc": "crc_now"})
    j = sums.join(now, id_, "full_outer")
    return j.where(~(F.col("bytes").eqNullSafe(F.col("bytes_now")) & F.col("crc").eqNullSafe(F.col("crc_now"))))
