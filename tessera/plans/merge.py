"""Which segments to merge, from the manifest.

Two rules give candidates: two segments or more with over 15 % deleted documents, and a size tier (1 MiB, 10 MiB, ...) with
more than ten segments, of which the smallest go. A merge whose bytes go beyond the largest segment size isn't made.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.segments import delete_ratio

MAX_DELETED, TIER_SIZE, MERGE_AT_ONCE, TIERS, FLOOR, MAX_BYTES = 0.15, 10, 10, 10, 1 << 20, 5 << 30


def tier():
    """0 up to the floor, then one more for each factor of ten."""
    t = F.ceil(F.log10(F.col("size_bytes") / F.lit(float(FLOOR))))
    return F.when(F.col("size_bytes") <= FLOOR, 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(TIERS - 1), t - 1))).cast("int")


def by_deletes(manifest: DataFrame) -> DataFrame:
    bad = manifest.withColumn("r", delete_ratio()).where(F.col("r") > MAX_DELETED)
    g = bad.agg(F.sort_array(F.collect_list("id")).alias("segments"), F.avg("r").alias("r"), F.sum("live_doc_count").alias("live"), F.sum("size_bytes").alias("bytes"))
    return g.where(F.size("segments") >= 2).select(F.lit("deletes").alias("reason"), "segments", F.round(F.col("r") * 100, 6).alias("score"), "bytes")


def by_tier(manifest: DataFrame) -> DataFrame:
    t = manifest.withColumn("tier", tier())
    t = t.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("tier"))).withColumn("r", F.row_number().over(Window.partitionBy("tier").orderBy("size_bytes", "id")))
    take = F.greatest(F.lit(2), F.least(F.lit(MERGE_AT_ONCE), F.col("n") - TIER_SIZE + 1))
    g = t.where((F.col("n") > TIER_SIZE) & (F.col("r") <= take)).groupBy("tier").agg(F.sort_array(F.collect_list("id")).alias("segments"), F.sum("size_bytes").alias("bytes"))
    score = F.greatest(F.lit(1), F.lit(10) - F.col("tier")) * F.size("segments")
    return g.select(F.concat(F.lit("tier "), F.col("tier").cast("string")).alias("reason"), "segments", score.cast("double").alias("score"), "bytes")


def candidates(manifest: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(reason, segments, score, bytes), best first."""
    both = by_deletes(manifest).unionByName(by_tier(manifest))
    return both.where(F.col("bytes") <= max_bytes).orderBy(F.desc("score"), "reason")


def benefit(planned: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(plan, score) of segments with a column ``plan``: 100 times the mean share of deleted documents, 10 for each segment less, and
    up to 50 the smaller the result is."""
    size = F.greatest(F.lit(0.0), 50 * (1 - F.sum("size_bytes") / F.lit(float(max_bytes))))
    return planned.groupBy("plan").agg((F.avg(delete_ratio()) * 100 + (F.count(F.lit(1)) - 1) * 10 + size).alias("score"))


def all_of_many(manifest: DataFrame, limit: int = TIER_SIZE) -> list[int]:
    """All segments where there are more than the limit, none otherwise. A manifest is small."""
    ids = [r.id for r in manifest.select("id").orderBy("id").collect()]
    return ids if len(ids) > limit else []


class MergeScheduler:
    """Merges in progress: two at most, no segment in two of them."""

    def __init__(self, at_once: int = 2):
        self.at_once, self.waiting, self.running = at_once, [], []

    def add(self, segments: list[int], score: float) -> bool:
        """False where one of the segments is waiting or being merged already."""
        if any(set(segments) & set(s) for s, _ in self.waiting + self.running):
            return False
        self.waiting = sorted([*self.waiting, (list(segments), score)], key=lambda x: -x[1])
        return True

    def next(self) -> list[int] | None:
        if len(self.running) >= self.at_once or not self.waiting:
            return None
        self.running.append(self.waiting.pop(0))
        return self.running[-1][0]

    def complete(self, segments: list[int]) -> None:
        self.running = [x for x in self.running if x[0] != segments]
