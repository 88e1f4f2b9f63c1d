"""Keyword search: a document matches with one query term at least; repeated query terms count as often as they occur.

Statistics (n, df, avgdl) are those of the live documents of the whole corpus. Scores are rounded to ``DIGITS`` places
before they are ranked, so that ranks don't depend on the order of summation.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.ranking import bm25, idf
from tessera.functions.text import analyse, tokens
from tessera.operators.index import InvertedIndex
from tessera.operators.topk import top, top_by
from tessera.plans.settings import Bm25Params, TokenizerConfig
from tessera.sources.scratch import written

DIGITS = 6
RESULT = "doc_id long, score double"
#: (query, term) rows that are sent to all tasks at once; documents of a block that has one bound, blocks that are scored first.
QUERY_ROWS, BLOCK, FIRST_BLOCKS = 1 << 18, 4096, 4
#: Documents that meet all queries at once, and cells of their table; postings that are waited for.
DOCUMENTS, CELLS, WAITING = 1024, 1 << 22, 1 << 18


def _none(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], RESULT)


def scores(index: InvertedIndex, query: list[str], params: Bm25Params | None = None) -> DataFrame:
    """(doc_id, score) of all matches. Only the query's terms are read from postings and dictionary."""
    return _scored(index, query, params).groupBy("doc_id").agg(F.round(F.sum("one"), DIGITS).alias("score"))


def _scored(index: InvertedIndex, query: list[str], params: Bm25Params | None) -> DataFrame:
    """(term, doc_id, tf, one): what each posting of the query's terms scores."""
    weights = Counter(query)
    n, avgdl = index.totals()
    post, terms = index.of(weights)
    # frequencies of the query's terms and the corpus' totals are few numbers, which go into the expression
    df = {r.term: r.df for r in terms.select("term", "df").collect()}
    hits = post.select("term", "doc_id", "tf", "doc_len")
    one = F.lit(0.0)
    for t, w in weights.items():
        if t in df:
            one = F.when(F.col("term") == t, bm25(F.col("tf"), F.lit(df[t]), F.lit(n), F.col("doc_len"), F.lit(avgdl), params) * w).otherwise(one)
    return hits.select("term", "doc_id", "tf", one.alias("one"))


def search(index: InvertedIndex, query: list[str], k: int = 10, params: Bm25Params | None = None, tombstones: DataFrame | None = None) -> DataFrame:
    """The k best documents of an index for analysed query terms."""
    if not query or k <= 0:
        return _none(index.postings.sparkSession)
    return top(scores(index.live(tombstones), query, params), k)


def _occurrences(array: str, term: str) -> Column:
    return F.size(F.filter(array, lambda x: x == term))


def scan_scores(docs: DataFrame, query: list[str], params: Bm25Params | None = None, cfg: TokenizerConfig | None = None, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) without an index. Texts are analysed once, and what is exchanged is an id, a length and a frequency
    for each query term; the same exchange feeds the statistics and the scores."""
    weights = Counter(query)
    names = [f"tf{i}" for i in range(len(weights))]
    tok = docs.select(F.col(id_).alias("doc_id"), tokens(F.col(text), cfg).alias("t"))
    tf = [_occurrences("t", t).alias(c) for c, t in zip(names, weights, strict=True)]
    thin = tok.select("doc_id", F.size("t").alias("doc_len"), *tf).repartition("doc_id")
    df = [F.count_if(F.col(c) > 0).alias(f"d{c}") for c in names]
    stats = thin.agg(F.count("doc_id").alias("n"), (F.sum("doc_len") / F.count("doc_id")).alias("avgdl"), *df)
    each = [bm25(F.col(c), F.col(f"d{c}"), F.col("n"), F.col("doc_len"), F.col("avgdl"), params) * w for c, w in zip(names, weights.values(), strict=True)]
    total = each[0]
    for x in each[1:]:
        total = total + x
    return thin.crossJoin(F.broadcast(stats)).select("doc_id", F.round(total, DIGITS).alias("score")).where("score > 0")


def scan_search(docs: DataFrame, query: str, k: int = 10, params: Bm25Params | None = None, cfg: TokenizerConfig | None = None, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """The k best documents for a query string; nothing where no term is left or k is 0."""
    found = analyse(query, cfg)
    if not found or k <= 0:
        return _none(docs.sparkSession)
    return top(scan_scores(docs, found, params, cfg, id_, text), k)


def batch_search(index: InvertedIndex, queries: DataFrame, k: int = 10, params: Bm25Params | None = None, cfg: TokenizerConfig | None = None, qid: str = "qid", text: str = "query") -> DataFrame:
    """(qid, doc_id, score, rank): the k best documents for each of many queries in one plan.

    A term's weight, which depends on no document, is joined to the queries first. Postings of the queries' terms alone are brought
    together by document, once; then a document meets all queries in its task, in tables of a bounded size, so that its scores are summed up
    and the k best of the task are chosen there, and only those move to their query. A common term is no hot key in it. Queries are broadcast
    up to ``QUERY_ROWS`` (query, term) rows; beyond that blocks of them are taken in turn."""
    q = queries.select(F.col(qid).alias("qid"), F.explode(tokens(F.col(text), cfg)).alias("term")).groupBy("qid", "term").agg(F.count(F.lit(1)).alias("w"))
    one_row = F.broadcast(index.stats.select("n", "avgdl"))
    q = q.join(index.terms.select("term", "df"), "term").crossJoin(one_row)
    p = params or Bm25Params()
    q = written(q.select("qid", "term", "avgdl", (F.col("w") * idf(F.col("df"), F.col("n"))).alias("w")))
    blocks = max(1, -(-q.count() // QUERY_ROWS))
    best = []
    for i in range(blocks):
        some = q.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == i)
        hits = index.postings.join(F.broadcast(some.select("term").distinct()), "term", "left_semi").select("doc_id", "term", "tf", "doc_len").repartition("doc_id").sortWithinPartitions("doc_id")
        best.append(top_by(_met(hits, some, k, p), "qid", k))
    return reduce(DataFrame.unionByName, best)


def _met(hits: DataFrame, queries: DataFrame, k: int, p: Bm25Params) -> DataFrame:
    """(qid, doc_id, score): of each task the k best of each query. Documents come in order of their ids, and ``DOCUMENTS`` of them at a
    time meet a query's terms as sums over a table of terms and documents, so a task's memory doesn't grow with its input."""
    t = queries.toArrow()  # QUERY_ROWS rows at most
    terms, of = np.unique(np.asarray(t.column("term").to_pylist(), object), return_inverse=True) if t.num_rows else (np.empty(0, object), np.empty(0, np.int64))
    qids, who = np.unique(np.asarray(t.column("qid")), return_inverse=True)
    order = np.argsort(who, kind="stable")
    ends = np.searchsorted(who[order], np.arange(len(qids) + 1))
    avgdl = float(t.column("avgdl")[0].as_py()) if t.num_rows else 1.0
    weight = np.asarray(t.column("w"), float)
    shared = hits.sparkSession.sparkContext.broadcast((pa.array(terms.tolist(), pa.string()), of.ravel()[order], weight[order], qids, ends))

    def run(batches):
        names, of, weight, qids, ends = shared.value
        held = {}
        for ids, table, present in _tables(batches, names, avgdl, p):
            for j in range(len(qids)):
                own = slice(ends[j], ends[j + 1])
                some = np.flatnonzero(present[of[own]].any(0))
                if not len(some):
                    continue
                s = np.round(weight[own] @ table[of[own]][:, some], DIGITS)
                i = ids[some]
                if len(s) > k:
                    keep = s >= np.partition(s, -k)[-k]
                    s, i = s[keep], i[keep]
                if j in held:
                    i, s = np.concatenate([held[j][0], i]), np.concatenate([held[j][1], s])
                best = np.lexsort((i, -s))[:k]
                held[j] = i[best], s[best]
        for j, (i, s) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), qids[j])), pa.array(i), pa.array(s)], names=["qid", "doc_id", "score"])

    if k <= 0:
        return hits.sparkSession.createDataFrame([], f"qid {queries.schema['qid'].dataType.simpleString()}, {RESULT}")
    return hits.mapInArrow(run, f"qid {queries.schema['qid'].dataType.simpleString()}, doc_id {hits.schema['doc_id'].dataType.simpleString()}, score double")


def _tables(batches, terms: pa.Array, avgdl: float, p: Bm25Params):
    """(ids, what a posting scores by term and document, whether there is one) of a bounded number of documents at a time, from rows in
    the order of their documents, which a batch may cut."""
    rest = None

    def made(doc, term, tf, length):
        ids, at = np.unique(doc, return_inverse=True)
        step = max(1, min(DOCUMENTS, CELLS // max(1, len(terms))))
        for a in range(0, len(ids), step):
            low, high = np.searchsorted(at, [a, a + step])
            table = np.zeros((len(terms), min(step, len(ids) - a)))
            present = np.zeros(table.shape, bool)
            cell, n, norm = (term[low:high], at[low:high] - a), tf[low:high], 1 - p.b + p.b * length[low:high] / avgdl
            table[cell] = n * (p.k1 + 1) / (n + p.k1 * norm) + p.delta
            present[cell] = True
            yield ids[a : a + step], table, present

    for b in batches:
        if not b.num_rows:
            continue
        now = [np.asarray(b.column(0)), np.asarray(pc.index_in(b.column(1), value_set=terms), np.int64), np.asarray(b.column(2), float), np.asarray(b.column(3), float)]
        now = [np.concatenate(x) for x in zip(rest, now, strict=True)] if rest else now
        whole = int(np.searchsorted(now[0], now[0][-1]))  # the last document may go on
        if whole < WAITING:
            rest = now
            continue
        yield from made(*(x[:whole] for x in now))
        rest = [x[whole:] for x in now]
    if rest:
        yield from made(*rest)


def bounds(index: InvertedIndex, query: list[str], params: Bm25Params | None = None, block: int = BLOCK) -> DataFrame:
    """(term, block, first_doc, last_doc, n, max_tf, max_score): for each query term and block of document ids the most that a
    posting of it scores. Blocks are aggregated before they move."""
    return _bounds(_scored(index, query, params).withColumn("block", F.floor(F.col("doc_id") / block)))


def _bounds(rows: DataFrame) -> DataFrame:
    return rows.groupBy("term", "block").agg(
        F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.count(F.lit(1)).alias("n"), F.max("tf").alias("max_tf"), F.round(F.max("one"), DIGITS).alias("max_score")
    )


def bounded_search(index: InvertedIndex, query: list[str], k: int = 10, params: Bm25Params | None = None, block: int = BLOCK) -> DataFrame:
    """As ``search``, by blocks: those of the greatest upper bounds are scored first, and of the others only those whose bound
    reaches the k-th score found. Pays where few blocks can hold the best."""
    if not query or k <= 0:
        return _none(index.postings.sparkSession)
    rows = written(_scored(index, query, params)).withColumn("block", F.floor(F.col("doc_id") / block))
    upper = written(_bounds(rows).groupBy("block").agg(F.sum("max_score").alias("upper")))
    first = [r.block for r in top(upper, FIRST_BLOCKS, "upper", "block").collect()]
    start = top(rows.where(F.col("block").isin(first)).groupBy("doc_id").agg(F.round(F.sum("one"), DIGITS).alias("score")), k).collect()
    least = start[-1].score if len(start) == k else 0.0
    # a sum of rounded parts may lie below the rounded sum by this much
    open_ = upper.where(F.col("upper") + len(set(query)) * 10.0**-DIGITS >= least).select("block")
    return top(rows.join(open_, "block", "left_semi").groupBy("doc_id").agg(F.round(F.sum("one"), DIGITS).alias("score")), k)
