"""Checks of a recorded history of operations.

History: (op_id, op_type, doc_id, doc_ids, query, invoke_time, return_time, ok, found, raft_index). Rows are ordered by
return time and op_id; only completed operations (return_time not null) that went well (ok) change the state. Each check gives
violations (invariant, doc_id, op_id, detail), none where it holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WRITES = ("Index", "Delete")
HISTORY = "op_id long, op_type string, doc_id long, doc_ids array<long>, query string, invoke_time long, return_time long, ok boolean, found boolean, raft_index long"
VIOLATION = ["invariant", "doc_id", "op_id", "detail"]


def completed(h: DataFrame) -> DataFrame:
    return h.where("return_time IS NOT NULL")


def pending(h: DataFrame) -> DataFrame:
    return h.where("return_time IS NULL")


def in_time(h: DataFrame, start: int, end: int) -> DataFrame:
    """Operations invoked within both ends."""
    return h.where(F.col("invoke_time").between(start, end))


def of_type(h: DataFrame, op: str) -> DataFrame:
    return h.where(F.col("op_type") == op)


def durations(h: DataFrame) -> DataFrame:
    return completed(h).select("op_id", (F.col("return_time") - F.col("invoke_time")).alias("nanos"))


def to_json(h: DataFrame) -> DataFrame:
    return h.select(F.to_json(F.struct(*h.columns)).alias("event"))


def from_json(events: DataFrame, schema: str = HISTORY) -> DataFrame:
    return events.select(F.from_json("event", schema).alias("e")).select("e.*")


def _good(h: DataFrame) -> DataFrame:
    """Completed operations that went well; batches count as one operation for each of their documents."""
    g = completed(h).where("ok")
    ids = F.when(F.col("op_type").isin("BatchIndex", "BatchDelete"), F.col("doc_ids")).otherwise(F.array("doc_id"))
    op = F.when(F.col("op_type") == "BatchIndex", "Index").when(F.col("op_type") == "BatchDelete", "Delete").otherwise(F.col("op_type"))
    return g.select("op_id", op.alias("op"), F.posexplode_outer(ids).alias("at", "doc_id"), "doc_ids", "return_time", "found", "raft_index")


def _order() -> list[Column]:
    return [F.col("return_time"), F.col("op_id"), F.coalesce("at", F.lit(0))]


def _violations(df: DataFrame, name: str, detail: Column) -> DataFrame:
    return df.select(F.lit(name).alias("invariant"), "doc_id", "op_id", detail.alias("detail"))


def indexed_document_retrievable(h: DataFrame) -> DataFrame:
    """Documents whose last write is an Index, that were looked up and never found."""
    g = _good(h).where("doc_id IS NOT NULL")
    last = F.max_by("op", F.when(F.col("op").isin(*WRITES), F.struct(*_order())))
    d = g.groupBy("doc_id").agg(
        last.alias("last"), F.max_by("op_id", F.when(F.col("op") == "Index", F.struct(*_order()))).alias("op_id"),
        F.max(F.when(F.col("op") == "Get", F.col("found"))).alias("ever"),
    )
    return _violations(d.where("last = 'Index' AND ever = false"), "IndexedDocumentRetrievable", F.lit("indexed, looked up, never found"))


def _last_write(ops: DataFrame) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy(*_order()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ops.withColumn("state", F.last(F.when(F.col("op").isin(*WRITES), F.col("op")), ignorenulls=True).over(w))


def deleted_document_not_retrievable(h: DataFrame) -> DataFrame:
    s = _last_write(_good(h).where("doc_id IS NOT NULL"))
    return _violations(s.where("op = 'Get' AND found AND state = 'Delete'"), "DeletedDocumentNotRetrievable", F.lit("found after its deletion"))


def monotonic_reads(h: DataFrame) -> DataFrame:
    """A document that was found and then not, without a deletion in between."""
    g = _good(h).where("doc_id IS NOT NULL")
    before = Window.partitionBy("doc_id").orderBy(*_order()).rowsBetween(Window.unboundedPreceding, -1)
    state = F.when(F.col("op") == "Delete", F.lit(False)).when((F.col("op") == "Get") & F.col("found"), F.lit(True))
    s = g.withColumn("seen", F.last(state, ignorenulls=True).over(before))
    return _violations(s.where("op = 'Get' AND NOT found AND seen"), "MonotonicReads", F.lit("found before, now not"))


def unique_document_ids(h: DataFrame) -> DataFrame:
    """An Index of an id that is live already is an upsert, so that no history violates it."""
    return _violations(completed(h).select("doc_id", "op_id").where(F.lit(False)), "UniqueDocumentIds", F.lit(""))


def search_reflects_index(h: DataFrame) -> DataFrame:
    """Search results with a document whose last write is a deletion."""
    g = _good(h)
    hits = g.where("op = 'Search'").select("op_id", "op", F.explode("doc_ids").alias("doc_id"), "return_time", F.lit(0).alias("at"))
    writes = g.where(F.col("op").isin(*WRITES) & F.col("doc_id").isNotNull()).select("op_id", "op", "doc_id", "return_time", "at")
    s = _last_write(writes.unionByName(hits))
    return _violations(s.where("op = 'Search' AND state = 'Delete'"), "SearchReflectsIndex", F.lit("a deleted document in the results"))


def raft_ordering_respected(h: DataFrame, buckets: int = 1024) -> DataFrame:
    """Log positions must not fall. Order is global, so time is cut into buckets: within one the row before counts, at its
    beginning the last row of the bucket before; only one row a bucket is ordered as a whole."""
    r = completed(h).where("raft_index IS NOT NULL").select("doc_id", "op_id", "return_time", "raft_index")
    ends = r.agg(F.min("return_time").alias("low"), F.max("return_time").alias("high")).first()
    low, width = ends.low or 0, ((ends.high or 0) - (ends.low or 0)) // buckets + 1
    r = r.withColumn("part", F.floor((F.col("return_time") - low) / width))
    w = Window.partitionBy("part").orderBy("return_time", "op_id")
    s = r.withColumn("prev", F.lag("raft_index").over(w))
    edge = r.groupBy("part").agg(F.max_by("raft_index", F.struct("return_time", "op_id")).alias("own"))
    edge = edge.select("part", F.lag("own").over(Window.orderBy("part")).alias("last"))
    s = s.join(F.broadcast(edge), "part").withColumn("prev", F.coalesce("prev", "last"))
    return _violations(s.where("raft_index < prev"), "RaftOrderingRespected", F.concat_ws(" after ", "raft_index", "prev"))


INVARIANTS = (
    indexed_document_retrievable, deleted_document_not_retrievable, monotonic_reads, unique_document_ids, search_reflects_index, raft_ordering_respected,
)


def check_all(h: DataFrame, invariants=INVARIANTS) -> DataFrame:
    out = invariants[0](h)
    for f in invariants[1:]:
        out = out.unionByName(f(h))
    return out
