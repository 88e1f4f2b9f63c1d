"""The changelog: an append-only table of commands, folded to the current documents.

Rows: raft_index, ordinal (within a batch), op ('Index', 'Update', 'Delete'), doc_id, content, embedding, metadata, at (seconds).
A null field of an Update isn't touched. By document, in the order (raft_index, ordinal): the last Index or Delete begins what
counts; Updates after an Index replace single fields and set updated_at, Updates after a Delete, or of a document that was
never indexed, count for nothing. An Index or Update whose vector has another length than ``dim`` is refused as a whole.

``compacted`` gives rows of the same form, at most one and one a field for each document. Folding the compacted parts of a log
gives the same as folding the log, in whatever way it was parted: every field keeps the position that set it, and what
comes after a Delete is kept for the case that another part has a later Index. That is what makes micro-batches and
compaction cheap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

METADATA = "struct<title:string,source:string,tags:array<string>,custom:map<string,string>>"
CHANGELOG = f"raft_index bigint, ordinal int, op string, doc_id bigint, content string, embedding array<float>, metadata {METADATA}, at bigint"
DOCUMENT = f"id bigint, content string, embedding array<float>, metadata {METADATA}, created_at bigint, updated_at bigint"
FIELDS = ("content", "embedding", "metadata")
#: New documents that one task numbers, about.
BUCKET_ROWS = 1 << 17


def schema(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def refused(log: DataFrame, dim: int | None) -> DataFrame:
    """Commands whose vector has the wrong length."""
    return log.where(_wrong(dim))


def _wrong(dim: int | None):
    if dim is None:
        return F.lit(False)
    return F.coalesce((F.col("op") != "Delete") & F.col("embedding").isNotNull() & (F.size("embedding") != dim), F.lit(False))


def _order():
    return F.struct("raft_index", "ordinal")


def _folded(log: DataFrame, dim: int | None) -> DataFrame:
    """By document: its base command (null where there is none), and the last of each field since, with its position and
    time. One exchange by doc_id serves the window and the aggregation."""
    log = log.where(~_wrong(dim) & F.col("doc_id").isNotNull()).withColumn("o", _order())
    base = F.max(F.when(F.col("op").isin("Index", "Delete"), F.col("o"))).over(Window.partitionBy("doc_id"))
    log = log.withColumn("base", base).where("base IS NULL OR o >= base")
    first = F.col("o") == F.col("base")
    last = []
    for c in FIELDS:
        at = F.when(F.col(c).isNotNull(), F.col("o"))
        last += [F.max_by(c, at).alias(c), F.max(at).alias(f"{c}_o"), F.max_by("at", at).alias(f"{c}_at")]
    return log.groupBy("doc_id").agg(F.max(F.when(first, F.col("op"))).alias("base_op"), F.max("base").alias("base"), F.max(F.when(first, F.col("at"))).alias("created"), *last)


def fold(log: DataFrame, dim: int | None = None) -> DataFrame:
    """The live documents (id, content, embedding, metadata, created_at, updated_at)."""
    live = _folded(log, dim).where("base_op = 'Index'")
    newest = F.array_max(F.array(*(F.struct(F.col(f"{c}_o").alias("o"), F.col(f"{c}_at").alias("at")) for c in FIELDS)))
    updated = F.when(newest["o"] > F.col("base"), newest["at"]).otherwise(F.col("created"))
    return live.select(F.col("doc_id").alias("id"), *FIELDS, F.col("created").alias("created_at"), updated.alias("updated_at"))


def tombstones(log: DataFrame, dim: int | None = None) -> DataFrame:
    """(doc_id, raft_index) of the documents whose last base command is a Delete."""
    return _folded(log, dim).where("base_op = 'Delete'").select("doc_id", F.col("base.raft_index").alias("raft_index"))


def compacted(log: DataFrame, dim: int | None = None) -> DataFrame:
    """The log with what is superseded left out: by document its base command, and an Update for each field set since."""
    kinds = schema(CHANGELOG)

    def row(op, at, order, when, fields):
        values = [(F.when(fields(c), F.col(c)) if fields(c) is not None else F.lit(None)).cast(kinds[c].dataType).alias(c) for c in FIELDS]
        whole = F.struct(order["raft_index"].alias("raft_index"), order["ordinal"].alias("ordinal"), op.alias("op"), F.col("doc_id"), *values, at.alias("at"))
        return F.when(when, whole)

    base = row(F.col("base_op"), F.col("created"), F.col("base"), F.col("base").isNotNull(), lambda c: F.col(f"{c}_o") == F.col("base"))
    later = [
        row(F.lit("Update"), F.col(f"{f}_at"), F.col(f"{f}_o"), F.col(f"{f}_o").isNotNull() & (F.col("base").isNull() | (F.col(f"{f}_o") > F.col("base"))), lambda c, f=f: F.lit(True) if c == f else None)
        for f in FIELDS
    ]
    rows = F.explode(F.filter(F.array(base, *later), lambda x: x.isNotNull()))
    return _folded(log, dim).select(rows.alias("r")).select("r.*")


def watermark(log: DataFrame) -> DataFrame:
    """(applied) in one row: the highest position."""
    return log.agg(F.max("raft_index").alias("applied"))


def next_ids(current: DataFrame, new: DataFrame, order: list[str]) -> DataFrame:
    """``new`` with ids that go on without gaps after the highest of ``current``. Rows are numbered by a count of each hash
    bucket and a number within it, so that no task sees them all; there are as many buckets as the rows take."""
    top = current.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    buckets = max(1, -(-new.count() // BUCKET_ROWS))
    b = new.withColumn("__b", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    size = b.groupBy("__b").count()
    before = size.select("__b", (F.sum("count").over(Window.orderBy("__b")) - F.col("count")).alias("before"))
    n = b.withColumn("__n", F.row_number().over(Window.partitionBy("__b").orderBy(*order)))
    j = n.join(F.broadcast(before), "__b").crossJoin(F.broadcast(top))
    return j.select((F.col("top") + F.col("before") + F.col("__n")).alias("id"), *new.columns)
