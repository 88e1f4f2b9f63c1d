"""Index segments and their manifest.

A segment is a partition ``segment_id=N`` of six tables: postings and terms (files sorted by term), lengths, statistics, deletions
and side columns. The manifest is a table of a
row for each live segment; a change writes its next generation beside the last and readers take the highest that was
committed, so that a reader never sees half a change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.index import analysed, tokenized, without
from tessera.plans.settings import TokenizerConfig
from tessera.sources import generations
from tessera.sources.scratch import written

#: Ids of deleted documents that are sent to all tasks, 32 MB of them; more are joined in an exchange.
BROADCAST_IDS = 1 << 22
META = "id bigint, min_raft_index bigint, max_raft_index bigint, doc_count bigint, live_doc_count bigint, size_bytes bigint, created_at bigint"


def delete_ratio():
    """1 - live / all; 0 for an empty segment."""
    return F.when(F.col("doc_count") > 0, 1 - F.col("live_doc_count") / F.col("doc_count")).otherwise(F.lit(0.0))


class SegmentStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _save(self, df: DataFrame, table: str, mode: str = "append") -> None:
        df.write.mode(mode).partitionBy("segment_id").parquet(f"{self.path}/{table}")

    def write(self, tok: DataFrame, columns: DataFrame | None = None) -> None:
        """Segments from (segment_id, doc_id, tokens), and their side columns (segment_id, doc_id, ...). Postings aren't exchanged: each
        task writes a file of each segment that is sorted by term, and a look-up skips what it doesn't need of each file; a merge makes
        files that share no term."""
        post, lengths = analysed(tok, by=("segment_id",))
        self._save(post.sortWithinPartitions("segment_id", "term", "doc_id"), "postings")
        self._save(lengths, "lengths")
        self._derive(sorted(r.segment_id for r in tok.select("segment_id").distinct().collect()))
        if columns is not None:
            self._save(columns.sortWithinPartitions("segment_id", "doc_id"), "columns")

    def _derive(self, segments: list[int]) -> None:
        """Dictionary and statistics of segments, from their postings and lengths."""
        t = self.read("postings", segments).groupBy("segment_id", "term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total_tf"))
        self._save(t.repartitionByRange("segment_id", "term").sortWithinPartitions("segment_id", "term"), "terms")
        self._save(self.read("lengths", segments).groupBy("segment_id").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_len").alias("total_len")), "stats")

    def delete(self, ids: DataFrame) -> None:
        """Marks documents (doc_id) as deleted in the segments that hold them; unknown ids change nothing. The manifest's live
        counts follow."""
        gone = self.read("lengths").join(ids.select("doc_id").distinct(), "doc_id", "left_semi").select("segment_id", "doc_id")
        self._save(without(gone, self.deleted()), "deletions")
        now, n = self.load_manifest()
        if n:
            left = self.deleted().groupBy("segment_id").agg(F.count(F.lit(1)).alias("gone"))
            j = now.join(left, F.col("id") == F.col("segment_id"), "left")
            self.save_manifest(j.withColumn("live_doc_count", F.col("doc_count") - F.coalesce("gone", F.lit(0))).select(now.columns))

    def deleted(self) -> DataFrame:
        """(segment_id, doc_id) of all deletions; none before the first."""
        try:
            return self.spark.read.schema("doc_id long, segment_id long").parquet(f"{self.path}/deletions")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], "doc_id long, segment_id long")

    def flush(self, buffer: DataFrame, cfg: TokenizerConfig | None = None, columns: list[str] | None = None, at: int = 0, force: bool = False, **limits) -> int | None:
        """A segment of the buffered documents (doc_id, text, raft_index, ...) with its manifest entry, once they are enough; its id,
        or None. ``columns`` are kept as side columns."""
        size = F.coalesce(F.octet_length("text"), F.lit(0))
        n, size_bytes, low, high = buffer.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0)), F.min("raft_index"), F.max("raft_index")).first()
        if not n or not (force or should_flush(n, size_bytes, **limits)):
            return None
        id_ = next_id(self.load_manifest()[0])
        tok = tokenized(buffer, cfg, text="text").withColumn("segment_id", F.lit(id_).cast("long"))
        self.write(tok, buffer.select(F.lit(id_).cast("long").alias("segment_id"), "doc_id", *columns) if columns else None)
        self.add(self.spark.createDataFrame([(id_, low, high, n, n, size_bytes, at)], META))
        return id_

    def read(self, table: str, segments: list[int] | None = None) -> DataFrame:
        """``postings``, ``terms``, ``lengths``, ``stats`` or ``columns``, of some segments only where they are named: other partitions
        aren't listed."""
        df = self.spark.read.parquet(f"{self.path}/{table}")
        return df if segments is None else df.where(F.col("segment_id").isin(*segments))

    def merge(self, segments: list[int], into: int, deleted: DataFrame | None = None) -> None:
        """A segment of what is live in the others, which stay until the manifest no longer names them."""
        gone = self.deleted().select("doc_id")
        gone = written((gone if deleted is None else gone.unionByName(deleted.select("doc_id"))).distinct())
        if gone.count() <= BROADCAST_IDS:  # then the postings aren't exchanged for it
            gone = F.broadcast(gone)
        for table, order in (("postings", ["term", "doc_id"]), ("lengths", ["doc_id"]), ("columns", ["doc_id"])):
            if table == "columns" and not self._has(table):
                continue
            df = self.read(table, segments).drop("segment_id").join(gone, "doc_id", "left_anti")
            df.repartitionByRange(*order[:1]).sortWithinPartitions(*order).write.mode("overwrite").parquet(f"{self.path}/{table}/segment_id={into}")
        self._derive([into])

    def _has(self, table: str) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def save_manifest(self, entries: DataFrame) -> int:
        """The next generation, which holds these entries alone."""
        return generations.replace(entries.coalesce(1), f"{self.path}/manifest")

    def load_manifest(self) -> tuple[DataFrame, int]:
        """(entries, generation); nothing and 0 before the first."""
        return generations.current(self.spark, f"{self.path}/manifest", META), generations.committed(self.spark, f"{self.path}/manifest")

    def add(self, entry: DataFrame) -> int:
        """The next generation, with these entries too."""
        now = self.load_manifest()[0]
        return self.save_manifest(now.unionByName(entry.select(now.columns)))

    def replace(self, gone: list[int], entry: DataFrame) -> int:
        """The next generation, with merged segments in place of others."""
        now = self.load_manifest()[0]
        return self.save_manifest(now.where(~F.col("id").isin(*gone)).unionByName(entry.select(now.columns)))


def next_id(manifest: DataFrame) -> int:
    return (manifest.agg(F.max("id").alias("m")).first().m or 0) + 1


def to_json(manifest: DataFrame) -> DataFrame:
    return manifest.select(F.to_json(F.struct(*manifest.columns)).alias("entry"))


def from_json(entries: DataFrame) -> DataFrame:
    return entries.select(F.from_json("entry", META).alias("e")).select("e.*")


def should_flush(docs: int, size_bytes: int, max_docs: int = 50_000, max_bytes: int = 256 << 20) -> bool:
    """Whether what was written since the last segment makes one."""
    return docs >= max_docs or size_bytes >= max_bytes


def totals(manifest: DataFrame) -> DataFrame:
    """(segments, docs, live_docs, bytes, applied) in one row."""
    zero = F.lit(0)
    return manifest.agg(
        F.count(F.lit(1)).alias("segments"), F.coalesce(F.sum("doc_count"), zero).alias("docs"), F.coalesce(F.sum("live_doc_count"), zero).alias("live_docs"),
        F.coalesce(F.sum("size_bytes"), zero).alias("bytes"), F.max("max_raft_index").alias("applied"),
    )
