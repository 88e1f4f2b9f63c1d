"""Segments, manifests, merges, and checks of histories.

Segments of the documents are ``doc_id % 12``; deleted documents are the toxic ones. The history is the events table: signup,
error, view and click are Index, Delete, Get and Search; some operations are pending, failed or out of order."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import invariants as inv
from tessera.operators.index import tokenized
from tessera.plans import merge
from tessera.queries.common import TOK, table
from tessera.sources.scratch import shared_folder
from tessera.sources.segments import SegmentStore, delete_ratio, from_json, to_json, totals


def _manifest(spark, d):
    """A segment for each supplier's line items; returned ones are deleted."""
    g = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("id"))
    return g.agg(
        F.min("l_orderkey").alias("min_raft_index"), F.max("l_orderkey").alias("max_raft_index"), F.count(F.lit(1)).alias("doc_count"),
        F.count_if(F.col("l_returnflag") != "R").alias("live_doc_count"), (F.sum("l_quantity") * 300).cast("long").alias("size_bytes"), F.lit(0).cast("long").alias("created_at"),
    )


def _shown(c):
    return c.select("reason", F.array_join(F.transform("segments", lambda x: x.cast("string")), ",").alias("segments"), "score", "bytes")


def mrg_candidates(spark, d):
    return _shown(merge.candidates(_manifest(spark, d)))


def mrg_by_deletes(spark, d):
    return _shown(merge.by_deletes(_manifest(spark, d)))


def mrg_tiers(spark, d):
    return _manifest(spark, d).select("id", merge.tier().alias("tier"))


def man_totals(spark, d):
    return totals(_manifest(spark, d))


def man_delete_ratio(spark, d):
    return _manifest(spark, d).select("id", F.round(delete_ratio(), 6).alias("ratio"))


def mrg_benefit(spark, d):
    """What it would bring to merge each three segments whose ids have one remainder."""
    return merge.benefit(_manifest(spark, d).withColumn("plan", F.col("id") % 3)).select("plan", F.round("score", 6).alias("score"))


def man_json(spark, d):
    """The manifest as JSON and back."""
    return from_json(to_json(_manifest(spark, d))).select("id", "doc_count", "live_doc_count", "size_bytes")


def man_generations(spark, d):
    """A manifest that was saved, added to, and in which one segment took the place of two."""
    s, m = SegmentStore(spark, shared_folder(spark)), _manifest(spark, d)
    s.save_manifest(m.where("id > 3"))
    s.add(m.where("id <= 3"))
    one = m.where("id BETWEEN 1 AND 2").agg(
        (F.max("id") * 0 - 1).alias("id"), F.min("min_raft_index").alias("min_raft_index"), F.max("max_raft_index").alias("max_raft_index"), F.sum("doc_count").alias("doc_count"),
        F.sum("live_doc_count").alias("live_doc_count"), F.sum("size_bytes").alias("size_bytes"), F.max("created_at").alias("created_at"),
    )
    g = s.replace([1, 2], one)
    return s.load_manifest()[0].select("id", "doc_count").withColumn("generation", F.lit(g))


def _segments(spark, d):
    s = SegmentStore(spark, shared_folder(spark))
    s.write(tokenized(table(spark, d, "documents"), text="text").withColumn("segment_id", F.col("doc_id") % 12))
    return s


def seg_stats(spark, d):
    """Lengths of each written segment."""
    return _segments(spark, d).read("lengths").groupBy(F.col("segment_id").cast("long").alias("segment_id")).agg(F.count(F.lit(1)).alias("n"), F.sum("doc_len").alias("total_len"))


def mrg_compact(spark, d):
    """Terms of all segments merged into one without what is deleted."""
    s = _segments(spark, d)
    s.merge(list(range(12)), 100, table(spark, d, "labels").where("toxic = 1").select("doc_id"))
    return s.read("terms", [100]).select("term", "df", "total_tf")


def enc_roundtrip(spark, d):
    """Postings of all segments with what they hold, written and read."""
    return _segments(spark, d).read("postings").select("segment_id", "term", "doc_id", "tf", "doc_len").withColumn("segment_id", F.col("segment_id").cast("long"))


def seg_flush(spark, d):
    """Rows of the six tables of a segment that was flushed and from which documents were deleted, and of its manifest entry."""
    s = SegmentStore(spark, shared_folder(spark))
    docs = table(spark, d, "documents").withColumn("raft_index", F.col("doc_id") + 1)
    s.flush(docs, columns=["lang", "source", "n_chars"], force=True)
    s.delete(table(spark, d, "labels").where("toxic = 1").select("doc_id"))
    entry = s.load_manifest()[0].select(F.posexplode(F.array("min_raft_index", "max_raft_index", "doc_count", "live_doc_count", "size_bytes")).alias("at", "rows"))
    entry = entry.select(F.element_at(F.array(*map(F.lit, ("first position", "last position", "documents", "live documents", "bytes"))), F.col("at") + 1).alias("what"), "rows")
    for name, t in [*((n, s.read(n)) for n in ("postings", "terms", "lengths", "stats", "columns")), ("deletions", s.deleted())]:
        entry = entry.unionByName(t.agg(F.lit(name).alias("what"), F.count(F.lit(1)).alias("rows")))
    return entry


TYPES = {"signup": "Index", "error": "Delete", "view": "Get", "click": "Search", "purchase": "Update"}


def history(events):
    e, v = F.col("event_id"), F.col("value")
    op = F.element_at(F.create_map(*(F.lit(x) for kv in TYPES.items() for x in kv)), F.col("event_type"))
    search, write = F.col("event_type") == "click", F.col("event_type").isin("signup", "error", "purchase")
    return events.select(
        e.alias("op_id"), op.alias("op_type"), F.when(~search, F.col("user_id")).alias("doc_id"), F.when(search, F.array("user_id", F.col("user_id") + 1)).alias("doc_ids"), F.lit(None).cast("string").alias("query"),
        (e * 1000).alias("invoke_time"), F.when(e % 97 != 0, e * 1000 + 500).alias("return_time"), (e % 41 != 0).alias("ok"), F.when(F.col("event_type") == "view", v > 5).alias("found"),
        F.when(write, F.when(e % 100 == 3, e - 40).otherwise(e)).alias("raft_index"),
    )


def _h(spark, d):
    return history(table(spark, d, "events"))


def inv_indexed_retrievable(spark, d):
    """As it stands in the log, with Gets that found nothing only."""
    h = _h(spark, d)
    return inv.indexed_document_retrievable(h.withColumn("found", F.col("found") & (F.col("doc_id") % 3 == 0)))


def inv_deleted_not_retrievable(spark, d):
    return inv.deleted_document_not_retrievable(_h(spark, d))


def inv_monotonic_reads(spark, d):
    return inv.monotonic_reads(_h(spark, d))


def inv_unique_ids(spark, d):
    return inv.unique_document_ids(_h(spark, d))


def inv_search_reflects_index(spark, d):
    return inv.search_reflects_index(_h(spark, d))


def inv_raft_ordering(spark, d):
    return inv.raft_ordering_respected(_h(spark, d))


def inv_all(spark, d):
    return inv.check_all(_h(spark, d)).groupBy("invariant").agg(F.count(F.lit(1)).alias("n"))


def inv_durations(spark, d):
    return inv.durations(_h(spark, d))


def inv_pending(spark, d):
    return inv.pending(_h(spark, d)).select("op_id")


def inv_time_range(spark, d):
    return inv.in_time(inv.of_type(_h(spark, d), "Get"), 100_000, 400_000).select("op_id")


def inv_json(spark, d):
    back = inv.from_json(inv.to_json(_h(spark, d)))
    return back.groupBy("op_type").agg(F.count(F.lit(1)).alias("n"), F.sum("raft_index").alias("positions"))


QUERIES = {
    f.__name__: f
    for f in (
        mrg_candidates, mrg_by_deletes, mrg_tiers, mrg_benefit, man_json, man_totals, man_delete_ratio, man_generations, seg_stats, seg_flush, mrg_compact, enc_roundtrip, inv_indexed_retrievable, inv_deleted_not_retrievable,
        inv_monotonic_reads, inv_unique_ids, inv_search_reflects_index, inv_raft_ordering, inv_all, inv_durations, inv_pending, inv_time_range, inv_json,
    )
}

MAN = """m AS (SELECT l_suppkey AS id, min(l_orderkey) AS lo, max(l_orderkey) AS hi, count(*) AS n, count(*) FILTER (WHERE l_returnflag <> 'R') AS live, (sum(l_quantity) * 300)::BIGINT AS bytes FROM lineitem GROUP BY 1
), r AS (SELECT *, CASE WHEN n > 0 THEN 1 - live / n::DOUBLE ELSE 0 END AS ratio, CASE WHEN bytes <= 1048576 THEN 0 ELSE greatest(0, least(9, ceil(log10(bytes / 1048576.0::DOUBLE)) - 1)) END::INT AS tier FROM m
), del AS (SELECT 'deletes' AS reason, string_agg(id::VARCHAR, ',' ORDER BY id) AS segments, round(avg(ratio) * 100, 6) AS score, sum(bytes)::BIGINT AS bytes FROM r WHERE ratio > 0.15 HAVING count(*) >= 2
), t AS (SELECT *, count(*) OVER (PARTITION BY tier) AS c, row_number() OVER (PARTITION BY tier ORDER BY bytes, id) AS k FROM r
), tie AS (SELECT 'tier ' || tier AS reason, string_agg(id::VARCHAR, ',' ORDER BY id) AS segments, (greatest(1, 10 - tier) * count(*))::DOUBLE AS score, sum(bytes)::BIGINT AS bytes
  FROM t WHERE c > 10 AND k <= greatest(2, least(10, c - 10 + 1)) GROUP BY tier)"""
H = """h AS (SELECT event_id AS op_id, CASE event_type WHEN 'signup' THEN 'Index' WHEN 'error' THEN 'Delete' WHEN 'view' THEN 'Get' WHEN 'click' THEN 'Search' ELSE 'Update' END AS op, user_id AS u, value > 5 AS found,
    CASE WHEN event_type IN ('signup', 'error', 'purchase') THEN CASE WHEN event_id % 100 = 3 THEN event_id - 40 ELSE event_id END END AS raft FROM events WHERE event_id % 97 <> 0
), g AS (SELECT * FROM h WHERE op_id % 41 <> 0)"""
INV1 = """SELECT 'IndexedDocumentRetrievable' AS invariant, u AS doc_id, i AS op_id, 'indexed, looked up, never found' AS detail FROM (
  SELECT u, arg_max(op, op_id) FILTER (WHERE op IN ('Index', 'Delete')) AS last, max(op_id) FILTER (WHERE op = 'Index') AS i, bool_or({found}) FILTER (WHERE op = 'Get') AS ever FROM g WHERE op <> 'Search' GROUP BY u)
  WHERE last = 'Index' AND ever = false"""
INV2 = """SELECT 'DeletedDocumentNotRetrievable' AS invariant, u AS doc_id, op_id, 'found after its deletion' AS detail FROM (
  SELECT *, last_value(CASE WHEN op IN ('Index', 'Delete') THEN op END IGNORE NULLS) OVER (PARTITION BY u ORDER BY op_id ROWS UNBOUNDED PRECEDING) AS state FROM g WHERE op <> 'Search') WHERE op = 'Get' AND found AND state = 'Delete'"""
INV3 = """SELECT 'MonotonicReads' AS invariant, u AS doc_id, op_id, 'found before, now not' AS detail FROM (
  SELECT *, last_value(CASE WHEN op = 'Delete' THEN false WHEN op = 'Get' AND found THEN true END IGNORE NULLS) OVER (PARTITION BY u ORDER BY op_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM g WHERE op <> 'Search')
  WHERE op = 'Get' AND NOT found AND seen"""
INV5 = """SELECT 'SearchReflectsIndex' AS invariant, d AS doc_id, op_id, 'a deleted document in the results' AS detail FROM (
  SELECT *, last_value(CASE WHEN op <> 'Search' THEN op END IGNORE NULLS) OVER (PARTITION BY d ORDER BY op_id ROWS UNBOUNDED PRECEDING) AS state FROM (
    SELECT op_id, op, u AS d FROM g WHERE op IN ('Index', 'Delete') UNION ALL SELECT op_id, op, u FROM g WHERE op = 'Search' UNION ALL SELECT op_id, op, u + 1 FROM g WHERE op = 'Search')) WHERE op = 'Search' AND state = 'Delete'"""
INV6 = """SELECT 'RaftOrderingRespected' AS invariant, CASE WHEN op <> 'Search' THEN u END AS doc_id, op_id, raft || ' after ' || prev AS detail FROM (SELECT *, lag(raft) OVER (ORDER BY op_id) AS prev FROM h WHERE raft IS NOT NULL) WHERE raft < prev"""
ORACLES = {
    "mrg_candidates": f"WITH {MAN} SELECT * FROM (SELECT * FROM del UNION ALL SELECT * FROM tie) WHERE bytes <= 5368709120",
    "mrg_by_deletes": f"WITH {MAN} SELECT * FROM del",
    "mrg_tiers": f"WITH {MAN} SELECT id, tier FROM r",
    "mrg_benefit": f"WITH {MAN} SELECT id % 3 AS plan, round(avg(ratio) * 100 + (count(*) - 1) * 10 + greatest(0.0, 50 * (1 - sum(bytes) / 5368709120.0::DOUBLE)), 6) AS score FROM r GROUP BY 1",
    "man_json": f"WITH {MAN} SELECT id, n AS doc_count, live AS live_doc_count, bytes AS size_bytes FROM m",
    "man_totals": f"WITH {MAN} SELECT count(*) AS segments, sum(n)::BIGINT AS docs, sum(live)::BIGINT AS live_docs, sum(bytes)::BIGINT AS bytes, max(hi) AS applied FROM m",
    "man_delete_ratio": f"WITH {MAN} SELECT id, round(ratio, 6) AS ratio FROM r",
    "man_generations": f"WITH {MAN} SELECT id, n AS doc_count, 3 AS generation FROM m WHERE id NOT IN (1, 2) UNION ALL SELECT -1, sum(n)::BIGINT, 3 FROM m WHERE id IN (1, 2)",
    "seg_flush": f"""WITH {TOK}, p AS (SELECT doc_id, term FROM (SELECT doc_id, unnest(tokens) AS term FROM tok) GROUP BY ALL), x AS (SELECT DISTINCT doc_id FROM labels JOIN documents USING (doc_id) WHERE toxic = 1)
      SELECT 'postings' AS what, count(*) AS rows FROM p UNION ALL SELECT 'terms', count(DISTINCT term) FROM p UNION ALL SELECT 'lengths', count(*) FROM documents UNION ALL SELECT 'stats', 1 UNION ALL SELECT 'columns', count(*) FROM documents
      UNION ALL SELECT 'deletions', count(*) FROM x UNION ALL SELECT 'first position', min(doc_id) + 1 FROM documents UNION ALL SELECT 'last position', max(doc_id) + 1 FROM documents UNION ALL SELECT 'documents', count(*) FROM documents
      UNION ALL SELECT 'live documents', (SELECT count(*) FROM documents) - (SELECT count(*) FROM x) UNION ALL SELECT 'bytes', sum(strlen(coalesce(text, '')))::BIGINT FROM documents""",
    "seg_stats": f"WITH {TOK} SELECT doc_id % 12 AS segment_id, count(*) AS n, sum(len(tokens))::BIGINT AS total_len FROM tok GROUP BY 1",
    "mrg_compact": f"WITH {TOK} SELECT term, count(DISTINCT doc_id) AS df, count(*) AS total_tf FROM (SELECT doc_id, unnest(tokens) AS term FROM tok WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)) GROUP BY term",
    "enc_roundtrip": f"WITH {TOK} SELECT doc_id % 12 AS segment_id, term, doc_id, count(*) AS tf, doc_len FROM (SELECT doc_id, unnest(tokens) AS term, len(tokens) AS doc_len FROM tok) GROUP BY ALL",
    "inv_indexed_retrievable": f"WITH {H} {INV1.format(found='found AND u % 3 = 0')}",
    "inv_deleted_not_retrievable": f"WITH {H} {INV2}",
    "inv_monotonic_reads": f"WITH {H} {INV3}",
    "inv_unique_ids": "SELECT '' AS invariant, user_id AS doc_id, event_id AS op_id, '' AS detail FROM events WHERE false",
    "inv_search_reflects_index": f"WITH {H} {INV5}",
    "inv_raft_ordering": f"WITH {H} {INV6}",
    "inv_all": f"WITH {H} SELECT invariant, count(*) AS n FROM (({INV1.format(found='found')}) UNION ALL ({INV2}) UNION ALL ({INV3}) UNION ALL ({INV5}) UNION ALL ({INV6})) GROUP BY 1",
    "inv_durations": "SELECT event_id AS op_id, 500::BIGINT AS nanos FROM events WHERE event_id % 97 <> 0",
    "inv_pending": "SELECT event_id AS op_id FROM events WHERE event_id % 97 = 0",
    "inv_time_range": "SELECT event_id AS op_id FROM events WHERE event_type = 'view' AND event_id BETWEEN 100 AND 400",
    "inv_json": """SELECT CASE event_type WHEN 'signup' THEN 'Index' WHEN 'error' THEN 'Delete' WHEN 'view' THEN 'Get' WHEN 'click' THEN 'Search' ELSE 'Update' END AS op_type, count(*) AS n,
      sum(CASE WHEN event_type IN ('signup', 'error', 'purchase') THEN CASE WHEN event_id % 100 = 3 THEN event_id - 40 ELSE event_id END END)::BIGINT AS positions FROM events GROUP BY 1""",
}
