"""Filters, columns, commands, snapshots and streams. The events table stands for a changelog: event_id is the position, user_id
the document, and signup, purchase and error are Index, Update and Delete."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import columns as col
from tessera.operators.filters import Filter, apply_filters
from tessera.plans import commands as commands_of
from tessera.queries.common import table
from tessera.sources import documents as store
from tessera.sources import snapshot
from tessera.sources.scratch import shared_folder, written
from tessera.streaming import changelog as log
from tessera.streaming.stream import ChangelogView, read_changelog

DAY = 86400


def _meta(spark, d):
    """The documents in the engine's form: tags are language and source."""
    t = table(spark, d, "documents")
    m = F.struct(
        F.lit(None).cast("string").alias("title"), F.col("source"), F.array("lang", "source").alias("tags"), F.create_map(F.lit("lang"), F.col("lang")).alias("custom"),
    )
    return t.select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.lit(None).cast("array<float>").alias("embedding"), m.alias("metadata"), (F.col("doc_id") * DAY).alias("created_at"), (F.col("doc_id") * DAY).alias("updated_at"))


def _filtered(spark, d, *filters):
    return apply_filters(_meta(spark, d), list(filters)).select("id")


def flt_tag(spark, d):
    return _filtered(spark, d, Filter.tag("fr"))


def flt_source(spark, d):
    return _filtered(spark, d, Filter.source("src3"))


def flt_date_range(spark, d):
    return _filtered(spark, d, Filter.date_range(10 * DAY, 100 * DAY))


def flt_custom(spark, d):
    return _filtered(spark, d, Filter.custom("lang", "de"))


def flt_and(spark, d):
    return _filtered(spark, d, Filter.tag("en"), Filter.source("src1"), Filter.date_range(0, 500 * DAY))


def flt_none(spark, d):
    return _filtered(spark, d)


def col_range(spark, d):
    return col.number_range(table(spark, d, "lineitem"), "l_quantity", 10, 20).select("l_orderkey", "l_linenumber", "l_quantity")


def col_equals(spark, d):
    return col.equals(table(spark, d, "part"), "p_size", 15).select("p_partkey")


def _labelled(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id", (F.col("toxic") == 1).alias("toxic")), "doc_id", "left")


def col_true(spark, d):
    return col.true_rows(_labelled(spark, d), "toxic").select("doc_id")


def col_false(spark, d):
    return col.false_rows(_labelled(spark, d), "toxic").select("doc_id")


def col_null(spark, d):
    return _labelled(spark, d).where("toxic IS NULL").select("doc_id")


def col_keyword(spark, d):
    return col.equals(table(spark, d, "customer"), "c_mktsegment", "BUILDING").select("c_custkey")


def col_unique_keywords(spark, d):
    return col.distinct_keywords(table(spark, d, "orders"), "o_orderpriority", "o_orderkey")


def col_bitmap(spark, d):
    """Ids of a range as bitmaps, with the bits of each counted."""
    b = col.as_bitmap(col.number_range(table(spark, d, "orders"), "o_totalprice", 1000, 50000), "o_orderkey")
    return b.select("bucket", F.bitmap_count("bitmap").alias("bits"), "n")


def col_pivot(spark, d):
    rows = table(spark, d, "supplier").select("s_suppkey", F.array("s_suppkey", F.col("s_nationkey").cast("long")).alias("numerics"), F.array(F.col("s_acctbal") > 0).alias("booleans"), F.array("s_name").alias("keywords"))
    return col.pivoted(rows, ["s_suppkey"])


OPS = {"signup": "Index", "purchase": "Update", "error": "Delete"}


def commands(events):
    """Events as a changelog; every fiftieth command has a vector of the wrong length and is refused."""
    op = F.element_at(F.create_map(*(F.lit(x) for kv in OPS.items() for x in kv)), F.col("event_type"))
    index, writes = F.col("event_type") == "signup", F.col("event_type") != "error"
    title = F.concat(F.lit("t"), F.col("event_id").cast("string"))
    m = F.struct(title.alias("title"), F.lit("events").alias("source"), F.array(F.concat(F.lit("g"), (F.col("user_id") % 7).cast("string"))).alias("tags"), F.create_map().cast("map<string,string>").alias("custom"))
    vec = F.when(F.col("event_id") % 50 == 0, F.array(F.lit(1.0), F.lit(2.0))).when(index, F.array(F.lit(1.0))).cast("array<float>")
    return events.where(F.col("event_type").isin(*OPS)).select(
        F.col("event_id").alias("raft_index"), F.lit(0).alias("ordinal"), op.alias("op"), F.col("user_id").alias("doc_id"),
        F.when(writes & (index | (F.col("value") > 10)), F.col("props")).alias("content"), F.when(writes, vec).alias("embedding"),
        F.when(writes & (index | (F.col("value") <= 50)), m).alias("metadata"), (F.col("event_id") * 10).alias("at"),
    )


def _log(spark, d):
    return commands(table(spark, d, "events"))


def _shown(docs):
    return docs.select("id", "content", F.col("metadata.title").alias("title"), "created_at", "updated_at")


def cmd_latest(spark, d):
    """The current documents after upserts, partial updates and deletions."""
    return _shown(log.fold(_log(spark, d), 1))


def cmd_tombstones(spark, d):
    return log.tombstones(_log(spark, d), 1)


def cmd_refused(spark, d):
    return log.refused(_log(spark, d), 1).select("raft_index", "doc_id")


def cmd_compacted(spark, d):
    """Folding what was compacted in eight parts gives what folding the log does."""
    whole = written(_log(spark, d).withColumn("part", F.col("raft_index") % 8))
    parts = [log.compacted(whole.where(F.col("part") == i).drop("part"), 1) for i in range(8)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return _shown(log.fold(out, 1))


def cmd_get(spark, d):
    """One document; the filter goes to the scan."""
    return _shown(log.fold(_log(spark, d).where("doc_id = 7"), 1))


def cmd_total(spark, d):
    return log.fold(_log(spark, d), 1).agg(F.count(F.lit(1)).alias("total"))


def cmd_metadata_index(spark, d):
    """Live documents by tag."""
    docs = log.fold(_log(spark, d), 1).select(F.explode("metadata.tags").alias("tag"))
    return docs.groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def cmd_next_ids(spark, d):
    """Benchmark items as new documents: their ids go on without gaps."""
    current = table(spark, d, "documents").select(F.col("doc_id").alias("id"))
    ids = log.next_ids(current, table(spark, d, "benchmark").select("item_id"), ["item_id"])
    return ids.agg(F.min("id").alias("first"), F.max("id").alias("last"), F.countDistinct("id").alias("n"))


def src_full_scan(spark, d):
    """All documents ever indexed, deleted ones too, with the position of their last Index."""
    return _log(spark, d).where("op = 'Index'").groupBy("doc_id").agg(F.max("raft_index").alias("raft_index"))


def src_store(spark, d):
    """Through a store on disk."""
    s = store.DocumentStore(spark, shared_folder(spark), 1)
    s.append(_log(spark, d))
    return _shown(s.documents())


def src_json(spark, d):
    """Documents as JSON and back."""
    raw = _meta(spark, d).select(F.to_json(F.struct("content", "metadata")).alias("value"))
    back = store.parse_json(raw)
    return back.groupBy(F.col("metadata.source").alias("source")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("content")).alias("chars"))


def src_json_files(spark, d):
    """The same through files of one object a line."""
    path = shared_folder(spark)
    _meta(spark, d).select("content", "metadata").write.json(path)
    back = store.read_json(spark, path)
    return back.groupBy(F.col("metadata.source").alias("source")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("content")).alias("chars"))


def src_checksums(spark, d):
    """Recorded lengths and CRC32 of all texts held against texts of which some (the toxic ones) were changed since in one letter."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    bad = table(spark, d, "labels").where("toxic = 1").select("doc_id", F.lit(True).alias("bad")).distinct()
    path = shared_folder(spark)
    store.checksums(docs, "doc_id", "text").write.parquet(path)
    now = docs.join(bad, "doc_id", "left").withColumn("text", F.when(F.col("bad"), F.concat(F.lit("#"), F.substring("text", 2, 1 << 30))).otherwise(F.col("text")))
    return store.verify(now, spark.read.parquet(path), "doc_id", "text").select("doc_id", "bytes", "bytes_now")


def src_exists(spark, d):
    """Which customers were ever indexed as documents, deleted or not, and which are live."""
    s = store.DocumentStore(spark, shared_folder(spark), 1)
    s.append(_log(spark, d))
    ids = table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"))
    return s.exists(ids).join(s.live(ids).withColumn("live", F.lit(True)), "doc_id", "left").select("doc_id", F.coalesce("live", F.lit(False)).alias("live"))


def cmd_names(spark, d):
    """Commands by their name, and whether they change documents."""
    op = F.element_at(F.create_map(*(F.lit(x) for kv in OPS.items() for x in kv)), F.col("event_type"))
    n = table(spark, d, "events").select(commands_of.name_of(F.coalesce(op, F.lit(""))).alias("name"))
    return n.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.bool_or(commands_of.modifies(F.col("name"))).alias("modifies"))


def snp_roundtrip(spark, d):
    path = shared_folder(spark)
    snapshot.save(log.fold(_log(spark, d), 1), path, 1)
    return _shown(snapshot.load(spark, path)[0])


def snp_size(spark, d):
    return snapshot.estimated_size(_meta(spark, d))


def _stream(spark, d):
    """The events as a stream; the pattern lets the table be a file or a folder."""
    return spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parque[t]")


def str_changelog(spark, d):
    """The events as a stream of commands, applied in micro-batches."""
    events = _stream(spark, d)
    view = ChangelogView(spark, shared_folder(spark), 1)
    view.start(commands(events)).awaitTermination()
    return _shown(view.documents())


def str_compacted(spark, d):
    """A view that was compacted, and in which the stream then went on with the later commands."""
    view, half = ChangelogView(spark, shared_folder(spark), 1), table(spark, d, "events").agg(F.max("event_id")).first()[0] // 2
    for late in (False, True):
        path = shared_folder(spark)
        rows = _log(spark, d).where((F.col("raft_index") > half) == late)
        rows.repartitionByRange(3, "raft_index").write.parquet(path)
        view = view.compact(shared_folder(spark)) if late else view
        view.start(read_changelog(spark, path, 1)).awaitTermination()
    return _shown(view.documents())


def str_micro_batches(spark, d):
    """The commands as eight files, one a micro-batch."""
    path = shared_folder(spark)
    _log(spark, d).repartitionByRange(8, "raft_index").write.parquet(path)
    view = ChangelogView(spark, shared_folder(spark), 1)
    view.start(read_changelog(spark, path, 1)).awaitTermination()
    return _shown(view.documents())


def str_watermark(spark, d):
    return log.watermark(_log(spark, d))


QUERIES = {
    f.__name__: f
    for f in (
        flt_tag, flt_source, flt_date_range, flt_custom, flt_and, flt_none, col_range, col_equals, col_true, col_false, col_null, col_keyword, col_unique_keywords, col_bitmap, col_pivot,
        cmd_latest, cmd_tombstones, cmd_refused, cmd_compacted, cmd_get, cmd_total, cmd_metadata_index, cmd_next_ids, cmd_names, src_exists, src_full_scan, src_store, src_json, src_json_files, src_checksums,
        snp_roundtrip, snp_size, str_changelog, str_compacted, str_micro_batches, str_watermark,
    )
}

EV = """ev AS (SELECT event_id AS r, user_id AS d, CASE event_type WHEN 'signup' THEN 'Index' WHEN 'purchase' THEN 'Update' ELSE 'Delete' END AS op,
    CASE WHEN event_type = 'signup' OR value > 10 THEN props END AS content, CASE WHEN event_type = 'signup' OR value <= 50 THEN 't' || event_id END AS title
  FROM events WHERE event_type IN ('signup', 'purchase', 'error') AND (event_type = 'error' OR event_id % 50 <> 0)
), b AS (SELECT *, max(r) FILTER (WHERE op <> 'Update') OVER (PARTITION BY d) AS base FROM ev
), f AS (SELECT d, arg_max(content, r) FILTER (WHERE content IS NOT NULL) AS content, arg_max(title, r) FILTER (WHERE title IS NOT NULL) AS title, max(base) AS base,
    max(op) FILTER (WHERE r = base) AS first_op, max(r) AS last FROM b WHERE r >= base GROUP BY d)"""
FOLD = f"WITH {EV} SELECT d AS id, content, title, base * 10 AS created_at, last * 10 AS updated_at FROM f WHERE first_op = 'Index'"
LAB = "SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id)"
JSON = "SELECT source, count(*) AS n, sum(length(text))::BIGINT AS chars FROM documents GROUP BY source"
ORACLES = {
    "flt_tag": "SELECT doc_id AS id FROM documents WHERE lang = 'fr' OR source = 'fr'",
    "flt_source": "SELECT doc_id AS id FROM documents WHERE source = 'src3'",
    "flt_date_range": "SELECT doc_id AS id FROM documents WHERE doc_id BETWEEN 10 AND 100",
    "flt_custom": "SELECT doc_id AS id FROM documents WHERE lang = 'de'",
    "flt_and": "SELECT doc_id AS id FROM documents WHERE lang = 'en' AND source = 'src1' AND doc_id BETWEEN 0 AND 500",
    "flt_none": "SELECT doc_id AS id FROM documents",
    "col_range": "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 20",
    "col_equals": "SELECT p_partkey FROM part WHERE p_size = 15",
    "col_true": f"{LAB} WHERE toxic = 1",
    "col_false": f"{LAB} WHERE toxic <> 1",
    "col_null": f"{LAB} WHERE toxic IS NULL",
    "col_keyword": "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'",
    "col_unique_keywords": "SELECT o_orderpriority AS keyword, min(o_orderkey) AS first_seen FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1",
    "col_bitmap": "SELECT CASE WHEN o_orderkey > 0 THEN 1 + (o_orderkey - 1) // 32768 ELSE o_orderkey // 32768 END AS bucket, count(DISTINCT o_orderkey) AS bits, count(DISTINCT o_orderkey) AS n FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000 GROUP BY 1",
    "col_pivot": "SELECT s_suppkey, s_suppkey AS numeric_0, s_nationkey::BIGINT AS numeric_1, s_acctbal > 0 AS boolean_0, s_name AS keyword_0 FROM supplier",
    **dict.fromkeys(("cmd_latest", "cmd_compacted", "src_store", "snp_roundtrip", "str_changelog", "str_compacted", "str_micro_batches"), FOLD),
    "cmd_get": f"{FOLD} AND d = 7",
    "cmd_tombstones": f"WITH {EV} SELECT d AS doc_id, base AS raft_index FROM f WHERE first_op = 'Delete'",
    "cmd_refused": "SELECT event_id AS raft_index, user_id AS doc_id FROM events WHERE event_type IN ('signup', 'purchase') AND event_id % 50 = 0",
    "cmd_total": f"WITH {EV} SELECT count(*) AS total FROM f WHERE first_op = 'Index'",
    "cmd_metadata_index": f"WITH {EV} SELECT 'g' || (d % 7) AS tag, count(*) AS n FROM f WHERE first_op = 'Index' GROUP BY 1",
    "cmd_next_ids": "SELECT m + 1 AS first, m + n AS last, n FROM (SELECT (SELECT max(doc_id) FROM documents) AS m, (SELECT count(*) FROM benchmark) AS n)",
    "src_full_scan": "SELECT user_id AS doc_id, max(event_id) AS raft_index FROM events WHERE event_type = 'signup' GROUP BY 1",
    "src_json": JSON,
    "src_json_files": JSON,
    "src_checksums": "SELECT DISTINCT doc_id, strlen(text) AS bytes, strlen('#' || substr(text, 2)) AS bytes_now FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 AND text IS NOT NULL AND text <> '#' || substr(text, 2)",
    "src_exists": f"WITH {EV}, x AS (SELECT DISTINCT user_id AS doc_id FROM events WHERE event_type = 'signup') SELECT c_custkey AS doc_id, c_custkey IN (SELECT d FROM f WHERE first_op = 'Index') AS live FROM customer WHERE c_custkey IN (SELECT doc_id FROM x)",
    "cmd_names": "SELECT CASE event_type WHEN 'signup' THEN 'IndexDocument' WHEN 'purchase' THEN 'UpdateDocument' WHEN 'error' THEN 'DeleteDocument' END AS name, count(*) AS n, bool_or(event_type IN ('signup', 'purchase', 'error')) AS modifies FROM events GROUP BY 1",
    "snp_size": """SELECT count(*) AS docs, sum(strlen(text) + 24 + strlen('{"source":"' || source || '","tags":["' || lang || '","' || source || '"],"custom":{"lang":"' || lang || '"}}'))::BIGINT AS bytes FROM documents""",
    "str_watermark": "SELECT max(event_id) AS applied FROM events WHERE event_type IN ('signup', 'purchase', 'error')",
}
