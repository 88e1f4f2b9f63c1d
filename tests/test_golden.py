"""Small fixtures with known results."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import vectors as vs
from tessera.functions.porter2 import stem
from tessera.functions.text import analyse, term_frequencies, tokens
from tessera.operators import columns, filters, graph, hybrid, invariants, keyword, pq, vector
from tessera.operators.index import InvertedIndex, prefix, tokenized
from tessera.operators.topk import top
from tessera.plans.engine import Engine, SearchRequest
from tessera.plans.merge import MergeScheduler, candidates
from tessera.plans.settings import BadRequest, Bm25Params, DocumentNotFound, IndexNotReady, InvalidConfig, InvalidEmbeddingDimensions, PqConfig, Settings, TokenizerConfig
from tessera.sources.segments import META
from tessera.streaming import changelog as log

CORPUS = [(1, "rust rust rust programming", [1.0, 0.0, 0.0]), (2, "rust programming language", [0.9, 0.1, 0.0]), (3, "python programming language", [0.0, 1.0, 0.0]), (4, "garden tools", [0.0, 0.0, 1.0])]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(CORPUS, "doc_id long, text string, embedding array<float>").cache()


def ids(df):
    return [r.doc_id for r in df.collect()]


def test_keyword_scores(spark, docs):
    stemmed = TokenizerConfig(stem=True)
    got = {r.doc_id: r.score for r in keyword.scan_search(docs, "rust programming", 10, cfg=stemmed).collect()}
    assert got == {1: 2.380312, 2: 2.099644, 3: 0.71335}
    plain = {r.doc_id: r.score for r in keyword.scan_search(docs, "rust programming", 10, Bm25Params(delta=0), stemmed).collect()}
    assert plain == {1: 1.33049, 2: 1.049822, 3: 0.356675}
    assert set(ids(keyword.scan_search(docs, "rust programming", 2))) == {1, 2}
    assert ids(keyword.search(InvertedIndex.build(docs), ["rust", "programming"], 2)) == ids(keyword.scan_search(docs, "rust programming", 2))


def test_keyword_edges(spark, docs):
    assert ids(keyword.scan_search(docs, "", 5)) == ids(keyword.scan_search(docs, "rust", 0)) == ids(keyword.scan_search(docs, "absent", 5)) == []
    gone = spark.createDataFrame([(1,)], "doc_id long")
    assert ids(keyword.search(InvertedIndex.build(docs), ["rust"], 5, tombstones=gone)) == [2]
    none = docs.limit(0)
    assert ids(keyword.scan_search(none, "rust", 5)) == []
    assert InvertedIndex.build(none).stats.first().asDict() == {"n": 0, "total_len": 0, "avgdl": 0.0}
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "rust " * 50000), (4, "rust")], "doc_id long, text string")
    assert set(ids(keyword.scan_search(odd, "rust", 5))) == {3, 4}


def test_batch_equals_single(spark, docs):
    q = spark.createDataFrame([(7, "rust programming"), (8, "language language"), (9, "nothing here")], "qid long, query string")
    index = InvertedIndex.build(docs)
    got = {(r.qid, r.doc_id): r.score for r in keyword.batch_search(index, q, 10).collect()}
    for qid, text in ((7, "rust programming"), (8, "language language")):
        assert {k: v for k, v in got.items() if k[0] == qid} == {(qid, r.doc_id): r.score for r in keyword.scan_search(docs, text, 10).collect()}
    assert not [k for k in got if k[0] == 9]


def test_saved_index(spark, docs, tmp_path):
    InvertedIndex.build(docs).save(str(tmp_path))
    again = InvertedIndex.load(spark, str(tmp_path))
    assert [r.term for r in prefix(again.terms, "pro").collect()] == ["programming"]
    assert ids(keyword.search(again, ["rust"], 5)) == [1, 2]
    plan = again.postings.where(F.col("term").isin("rust"))._jdf.queryExecution().toString()
    assert "PushedFilters: [" in plan and "rust" in plan.split("PushedFilters: [")[1][:200]


def test_vector_search(docs):
    assert ids(vector.search(docs, [1.0, 0.0, 0.0], 2)) == [1, 2]
    assert ids(vector.search(docs, [1.0, 0.0], 2, dim=3)) == ids(vector.search(docs, [1.0, 0.0, 0.0], 0)) == []


def test_hybrid(docs):
    kw, ve = keyword.scan_search(docs, "rust programming", 4), vector.search(docs, [0.0, 1.0, 0.0], 4)
    assert ids(hybrid.fuse(kw, ve, 1, 1.0)) == [1]
    assert ids(hybrid.fuse(kw, ve, 1, 0.0)) == [3]
    both = {r.doc_id: r.score for r in hybrid.fuse(kw, ve, 10, 0.5).collect()}
    assert both[1] == 0.5 and set(both) == {1, 2, 3, 4}


def test_negative_dot_products_count_as_nothing(spark, docs):
    ve = vector.search(docs, [-1.0, -1.0, -1.0], 4, "dot")
    assert all(r.score == 0 for r in hybrid.fuse(keyword.scan_search(docs, "absent", 4), ve, 4, 0.0).collect())


def test_tie_rules(spark):
    s = spark.createDataFrame([(1, 1.0), (2, 1.0), (3, 2.0)], "doc_id long, score double")
    assert ids(top(s, 2)) == [3, 1] and ids(top(s, 2, ties="desc")) == [3, 2]


def test_similarities(spark):
    rows = [([1.0, 2.0], [1.0, 2.0]), ([1.0, 0.0], [0.0, 1.0]), ([1.0, 0.0], [-1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 2.0]), ([0.0, 0.0], [1.0, 0.0]), (None, [1.0])]
    df = spark.createDataFrame(rows, "a array<float>, b array<float>")
    a, b = F.col("a"), F.col("b")
    got = df.select(vs.cosine(a, b).alias("c"), vs.euclidean(a, b).alias("e"), vs.dot(a, b).alias("d")).collect()
    assert [round(r.c, 6) if r.c is not None else None for r in got] == [1, 0, 0, 0, 0, 0, None]
    assert got[5].e == 0.5 and got[4].e == 0 and got[0].d == 5
    fixed = df.select(vs.cosine(a, [1.0, 2.0]).alias("c"), vs.dot(a, [1.0] * 300).alias("long")).collect()
    assert round(fixed[0].c, 6) == 1 and fixed[4].c == 0 and fixed[0].long == 0
    n = spark.createDataFrame([(5.0, 10.0), (15.0, 10.0), (3.0, 0.0)], "s double, m double").select(vs.normalized(F.col("s"), F.col("m")).alias("x")).collect()
    assert [r.x for r in n] == [0.5, 1.0, 0.0]


def test_tokenizer(spark):
    plain = TokenizerConfig()
    assert analyse("Hello World! This is a test.", plain) == ["hello", "world", "this", "is", "test"]
    assert not set(analyse("This is a document about the system", TokenizerConfig(remove_stopwords=True))) & {"this", "is", "a", "the"}
    assert all(t.startswith("run") for t in analyse("running runs runner", TokenizerConfig(stem=True)))
    assert term_frequencies("apple apple banana") == {"apple": 2, "banana": 1}
    assert analyse("a ab abc abcd abcde abcdef", TokenizerConfig(min_len=3, max_len=5)) == ["abc", "abcd", "abcde"]
    texts = ["It's 3.14, foo_bar a-b", "Straße ÉTÉ naïve", "", None, "x" * 60]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    for cfg in (plain, TokenizerConfig(mode="uax29"), TokenizerConfig(stem=True, remove_stopwords=True), TokenizerConfig(lowercase=False, stem=True, mode="uax29")):
        got = {r.i: r.t for r in df.select("i", tokens(F.col("text"), cfg).alias("t")).collect()}
        assert got == {i: analyse(t, cfg) for i, t in enumerate(texts)}
    assert {"it's", "3.14", "foo_bar"} <= set(analyse(texts[0], TokenizerConfig(mode="uax29")))


@pytest.mark.parametrize(
    ("word", "expected"),
    [("caresses", "caress"), ("flies", "fli"), ("dies", "die"), ("mules", "mule"), ("denied", "deni"), ("agreed", "agre"), ("owned", "own"), ("humbled", "humbl"), ("sized", "size"), ("meeting", "meet"),
     ("stating", "state"), ("itemization", "item"), ("sensational", "sensat"), ("traditional", "tradit"), ("reference", "refer"), ("colonizer", "colon"), ("plotted", "plot"), ("generously", "generous"),
     ("consistency", "consist"), ("knightly", "knight"), ("happy", "happi"), ("sky", "sky"), ("skies", "sky"), ("hopping", "hop"), ("hoping", "hope"), ("succeed", "succeed"), ("by", "by"), ("say", "say"),
     ("communication", "communic"), ("relational", "relat"), ("conditional", "condit"), ("national", "nation"), ("controlling", "control"), ("ties", "tie"), ("cries", "cri"), ("gas", "gas"), ("this", "this"), ("kiwis", "kiwi"), ("luxuriated", "luxuri")],
)
def test_stems(word, expected):
    assert stem(word) == expected


def test_filters(spark):
    m = "struct<title:string,source:string,tags:array<string>,custom:map<string,string>>"
    d = spark.createDataFrame([(1, (None, "s", ["a"], {"k": "v"}), 10), (2, (None, None, [], {}), 20), (3, None, None)], f"id long, metadata {m}, created_at long")
    F_ = filters.Filter
    run = lambda *f: sorted(r.id for r in filters.apply_filters(d, list(f)).collect())
    assert run(F_.tag("a")) == run(F_.source("s")) == run(F_.custom("k", "v")) == [1]
    assert run(F_.date_range(10, 20)) == [1, 2] and run(F_.tag("a"), F_.date_range(11, 20)) == [] and run() == [1, 2, 3]


def test_columns(spark):
    d = spark.createDataFrame([(0, 100, True, "apple"), (1, 200, False, "banana"), (2, None, None, None), (3, 150, True, "apple")], "i int, n long, b boolean, k string")
    pick = lambda x: [r.i for r in x.orderBy("i").collect()]
    assert pick(columns.number_range(d, "n", 100, 160)) == [0, 3] and pick(columns.true_rows(d, "b")) == [0, 3] and pick(columns.false_rows(d, "b")) == [1]
    assert pick(columns.equals(d, "k", "apple")) == [0, 3] and [r.keyword for r in columns.distinct_keywords(d, "k", "i").collect()] == ["apple", "banana"]
    rows = spark.createDataFrame([(0, [10, None], [True], ["alpha", None]), (1, [20], [None], ["beta", "gamma"])], "i int, numerics array<long>, booleans array<boolean>, keywords array<string>")
    assert columns.pivoted(rows, ["i"]).columns == ["i", "numeric_0", "numeric_1", "boolean_0", "keyword_0", "keyword_1"]


def _log(spark, rows):
    full = [(r, o, op, d, c, e, None, at) for r, o, op, d, c, e, at in rows]
    return spark.createDataFrame(full, log.schema(log.CHANGELOG))


def test_fold(spark):
    rows = [
        (1, 0, "Index", 1, "a", [1.0], 10), (2, 0, "Update", 1, "b", None, 20), (3, 0, "Update", 1, None, None, 30), (4, 0, "Index", 2, "c", [1.0], 40), (5, 0, "Delete", 2, None, None, 50),
        (6, 0, "Update", 2, "x", None, 60), (7, 0, "Update", 3, "y", None, 70), (8, 0, "Index", 4, "bad", [1.0, 2.0], 80), (9, 0, "Index", 5, "old", [1.0], 90), (9, 1, "Index", 5, "new", [2.0], 91), (10, 0, "Delete", 6, None, None, 99),
    ]
    whole = _log(spark, rows)
    seen = lambda f: sorted((r.id, r.content, r.embedding, r.created_at, r.updated_at) for r in f.collect())
    expected = [(1, "b", [1.0], 10, 20), (5, "new", [2.0], 91, 91)]
    assert seen(log.fold(whole, 1)) == expected
    for cut in range(len(rows) + 1):
        parts = log.compacted(_log(spark, rows[:cut]), 1).unionByName(log.compacted(_log(spark, rows[cut:]), 1)) if 0 < cut < len(rows) else whole
        if cut in (2, 5, 6, 10):
            assert seen(log.fold(parts, 1)) == expected
    assert sorted((r.doc_id, r.raft_index) for r in log.tombstones(whole, 1).collect()) == [(2, 5), (6, 10)]
    assert [r.doc_id for r in log.refused(whole, 1).collect()] == [4]
    assert seen(log.fold(whole.limit(0), 1)) == []


def test_next_ids(spark):
    current = spark.createDataFrame([(5,), (9,)], "id long")
    got = log.next_ids(current, spark.createDataFrame([(chr(97 + i % 26), i) for i in range(100)], "c string, i long"), ["i"])
    assert sorted(r.id for r in got.collect()) == list(range(10, 110))


def test_engine(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "e"), Settings(dim=3, pq=PqConfig(m=3)))
    given = e.index([{"content": c, "embedding": v, "metadata": {"title": None, "source": "s", "tags": ["t"], "custom": {}}} for _, c, v in CORPUS])
    assert given == [1, 2, 3, 4]
    with pytest.raises(IndexNotReady):
        e.search(SearchRequest("keyword", "rust", min_applied=1))
    found = e.search(SearchRequest("keyword", "rust programming", k=2, min_applied=1, wait_seconds=5))
    assert set(ids(found.results)) == {1, 2} and found.total_hits == 4
    assert ids(e.search(SearchRequest("vector", embedding=[1.0, 0.0, 0.0], k=2)).results) == [1, 2]
    assert len(ids(e.search(SearchRequest("hybrid", "rust", [1.0, 0.0, 0.0])).results)) == 4
    assert ids(e.search(SearchRequest("keyword", "rust", filters=[filters.Filter.source("other")])).results) == []
    e.update(2, content="garden party")
    e.delete([1, 77])
    e.refresh()
    assert ids(e.search(SearchRequest("keyword", "rust")).results) == []
    assert set(ids(e.search(SearchRequest("keyword", "garden")).results)) == {2, 4}
    for bad, error in ((lambda: e.update(1, content="x"), DocumentNotFound), (lambda: e.index([{"content": "x", "embedding": [1.0]}]), InvalidEmbeddingDimensions), (lambda: e.search(SearchRequest("hybrid", "x")), BadRequest), (lambda: e.get(1), DocumentNotFound)):
        with pytest.raises(error):
            bad()
    e.snapshot(str(tmp_path / "snap"))
    e.compact()
    assert e.get(2)["content"] == "garden party"
    other = Engine(spark, str(tmp_path / "o"), Settings(dim=3, pq=PqConfig(m=3)))
    other.restore(str(tmp_path / "snap"))
    assert other.total() == 3 and set(ids(other.search(SearchRequest("keyword", "garden")).results)) == {2, 4}
    assert other.get(2)["updated_at"] >= other.get(2)["created_at"]
    assert "searches_total" in e.metrics.text() and e.health()["pending"] == 0
    assert Engine(spark, str(tmp_path / "e"), Settings(dim=3, pq=PqConfig(m=3))).total() == 3


def test_pq_and_graph(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.random((400, 16)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id long, embedding array<float>").repartition(5)
    book = pq.train(df, 16, PqConfig(m=4, max_iter=10))
    codes = pq.encoded(df, book)
    assert codes.count() == 400 and book.compression_ratio() == 16
    exact = set(np.argsort(((x - x[50]) ** 2).sum(1))[:10].tolist())
    q = x[50].tolist()
    assert len(exact & set(ids(pq.reranked(pq.search(codes, book, q, 60), df, q, 10)))) >= 7
    got = graph.search(df, [(0, q)], 16, 10)
    assert len(exact & set(ids(got))) >= 9
    assert len(exact & set(ids(graph.search(df, [(0, q)], 16, 10, shard_rows=100)))) >= 9
    assert pq.Codebook.of(book.frame(spark)).encode(x.astype(float)).tolist() == book.encode(x.astype(float)).tolist()
    with pytest.raises(InvalidConfig):
        PqConfig(m=5).check(16)
    assert graph.adaptive_ef(0) == 50 and graph.adaptive_ef(1 << 40) == 400 and graph.brute_force(1000)


def test_batch_vectors_by_blocks(spark, monkeypatch):
    import numpy as np

    x = np.random.default_rng(5).normal(size=(60, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id long, embedding array<double>")
    q = df.withColumnRenamed("doc_id", "qid")
    for metric in ("cosine", "euclidean", "dot"):
        whole = sorted(map(tuple, vector.batch_search(df, q, 8, 4, metric).collect()))
        with monkeypatch.context() as m:
            m.setattr(vector, "QUERY_BYTES", 1500)
            assert sorted(map(tuple, vector.batch_search(df, q, 8, 4, metric).collect())) == whole
        assert len(whole) == 240


def test_invariants(spark):
    rows = [(1, "Index", 100, None, None, 0, 1, True, None, 1), (2, "Delete", 100, None, None, 2, 3, True, None, 2), (3, "Get", 100, None, None, 4, 5, True, True, None)]
    h = spark.createDataFrame(rows, invariants.HISTORY)
    assert [r.invariant for r in invariants.check_all(h).collect()] == ["DeletedDocumentNotRetrievable"]
    good = [(i, "Index", i, None, None, i * 2, i * 2 + 1, True, None, i) for i in (1, 2, 3)]
    assert invariants.check_all(spark.createDataFrame(good, invariants.HISTORY)).count() == 0
    batch = [(1, "BatchIndex", None, [1, 2, 3], None, 0, 1, True, None, 1), (2, "BatchDelete", None, [1, 2], None, 2, 3, True, None, 2), (3, "Search", None, [1, 3], "q", 4, 5, True, None, None), (4, "Get", 3, None, None, 6, 7, True, True, None), (5, "Get", 3, None, None, 8, 9, True, False, None), (6, "Index", 9, None, None, 10, 11, True, None, 1), (7, "Get", 9, None, None, 12, 13, True, False, None)]
    got = sorted((r.invariant, r.doc_id) for r in invariants.check_all(spark.createDataFrame(batch, invariants.HISTORY)).collect())
    assert got == [("IndexedDocumentRetrievable", 9), ("MonotonicReads", 3), ("RaftOrderingRespected", 9), ("SearchReflectsIndex", 1)]


def test_merges(spark):
    m = [(i, 0, i, 100, 100, 1 << 19, 0) for i in range(12)] + [(50, 0, 0, 100, 50, 1 << 25, 0), (51, 0, 0, 100, 70, 1 << 25, 0)]
    got = candidates(spark.createDataFrame(m, META)).collect()
    assert [(r.reason, len(r.segments), r.score) for r in got] == [("deletes", 2, 40.0), ("tier 0", 3, 30.0)]
    assert candidates(spark.createDataFrame([], META)).count() == 0
    s = MergeScheduler()
    assert s.add([1, 2], 1.0) and not s.add([2, 3], 9.0) and s.add([4], 5.0) and s.add([5], 2.0)
    assert [s.next(), s.next(), s.next()] == [[4], [5], None]
    s.complete([4])
    assert s.next() == [1, 2]


def test_settings():
    with pytest.raises(InvalidConfig):
        Settings(metric="taxi")
    assert math.isclose(Bm25Params().delta, 1.0)


def test_index_of_tokens(spark):
    d = spark.createDataFrame([(1, "b a b"), (2, None)], "doc_id long, text string")
    assert {r.doc_id: r.tokens for r in tokenized(d, TokenizerConfig(min_len=1)).collect()} == {1: ["b", "a", "b"], 2: []}


def test_recorder_and_command_line(spark, tmp_path, capsys):
    from tessera.__main__ import main
    from tessera.plans.recorder import Recorder

    r = Recorder(Engine(spark, str(tmp_path / "r"), Settings(dim=3, pq=PqConfig(m=3))))
    r.index([{"content": c, "embedding": v} for _, c, v in CORPUS])
    assert r.get(1) is not None
    r.delete([1])
    assert r.get(1) is None
    with pytest.raises(DocumentNotFound):
        r.update(1, content="x")
    r.engine.refresh()
    r.search(SearchRequest("keyword", "rust"))
    h = r.history()
    assert [x.ok for x in h.orderBy("op_id").collect()] == [True, True, True, True, False, True]
    assert invariants.check_all(h).count() == 0 and invariants.completed(h).count() == 6
    (tmp_path / "in.json").write_text('{"content": "tools for gardens", "embedding": [0, 1, 0]}\n{"content": "rust", "embedding": [1, 0, 0]}\n')
    for args in (["index", str(tmp_path / "in.json")], ["search", "gardens"], ["compact"], ["snapshot", str(tmp_path / "s")], ["restore", str(tmp_path / "s")], ["health"]):
        main([str(tmp_path / "c"), *args, "--dim", "3"], spark)
    out = capsys.readouterr().out
    assert '"score": ' in out and '"documents": 2' in out


def test_json_arrays_and_generations(spark, tmp_path):
    from tessera.sources import generations
    from tessera.sources.documents import DocumentStore, read_json

    (tmp_path / "a.json").write_text('[{"content": "x", "embedding": [1.0]}, {"content": "y", "metadata": {"tags": ["t"]}}]')
    assert [(r.content, r.embedding) for r in read_json(spark, str(tmp_path / "a.json"), lines=False).collect()] == [("x", [1.0]), ("y", None)]
    at = str(tmp_path / "g")
    assert generations.committed(spark, at) == 0 and generations.current(spark, at, "x long").count() == 0
    generations.append(spark.range(3).withColumnRenamed("id", "x"), at)
    generations.append(spark.range(2).withColumnRenamed("id", "x"), at)
    assert generations.replace(generations.current(spark, at, "x long").where("x = 0"), at) == 2
    (tmp_path / "g" / "gen-3").mkdir()  # a job that didn't end
    assert generations.committed(spark, at) == 2 and generations.current(spark, at, "x long").count() == 2
    s = DocumentStore(spark, str(tmp_path / "s"))
    assert s.applied() == 0 and s.get(1).count() == 0
    s.tombstone([7], 3)
    assert [r.doc_id for r in s.tombstones().collect()] == [7] and s.applied() == 3 and s.pointers().count() == 0
    s.clear()
    assert s.log().count() == 0


def test_stream_goes_on_after_compaction(spark, tmp_path):
    """Ten documents, compacted, then three more from a new folder: thirteen, and again where a batch comes twice."""
    from tessera.streaming.stream import ChangelogView, read_changelog

    def rows(ids, at):
        return spark.createDataFrame([(at + i, 0, "Index", i, f"text {i}", [1.0], None, 0) for i in ids], log.schema(log.CHANGELOG))

    first, second, third = (f"{tmp_path}/{x}" for x in "abc")
    rows(range(10), 1).write.parquet(first)
    view = ChangelogView(spark, f"{tmp_path}/view", 1)
    view.start(read_changelog(spark, first)).awaitTermination()
    small = view.compact(f"{tmp_path}/small")
    assert small.documents().count() == 10 and small.applied() == view.applied()
    rows(range(20, 23), 100).write.parquet(second)
    small.start(read_changelog(spark, second)).awaitTermination()
    assert sorted(r.id for r in small.documents().collect()) == [*range(10), 20, 21, 22] and small.applied() == 122
    again = small.compact(f"{tmp_path}/again")
    rows([5, 20, 30], 200).unionByName(rows(range(10), 1)).write.parquet(third)  # a part of the log a second time
    again.start(read_changelog(spark, third)).awaitTermination()
    assert sorted(r.id for r in again.documents().collect()) == [*range(10), 20, 21, 22, 30]


def test_engine_reads_what_is_not_refreshed(spark, tmp_path):
    from tessera.plans.commands import Change, Command
    from tessera.plans.engine import Engine, SearchRequest
    from tessera.plans.settings import BadRequest, InvalidConfig, InvalidEmbeddingDimensions, Settings, TokenizerConfig

    e = Engine(spark, str(tmp_path / "e"), Settings(dim=2, approximate=True))
    e.index([{"content": "rust programming", "embedding": [1.0, 0.0]}, {"content": "garden tools", "embedding": [0.0, 1.0]}])
    e.refresh()
    near = SearchRequest("vector", None, [1.0, 0.1], k=2, approximate=True)
    assert [i for i, _ in e.search(near).hits] == [1, 2]
    # the document before the wrong one is written
    with pytest.raises(InvalidEmbeddingDimensions):
        e.index([{"content": "rust compiler", "embedding": [0.9, 0.1]}, {"content": "bad", "embedding": [1.0]}, {"content": "never", "embedding": [1.0, 1.0]}])
    with pytest.raises(BadRequest):
        e.index([{"content": None, "embedding": [1.0, 1.0]}])
    e.apply(Command("DeleteDocument", ids=(1,)))
    assert [i for i, _ in e.search(SearchRequest("keyword", "rust")).hits] == [1]
    r = e.search(SearchRequest("keyword", "rust", fresh=True))
    assert [i for i, _ in r.hits] == [3] and r.matched == 1 and r.results.columns == ["doc_id", "score", "highlights"]
    assert [i for i, _ in e.search(SearchRequest("vector", None, [1.0, 0.0], fresh=True)).hits] == [3, 2]
    fresh = e.search(SearchRequest("hybrid", "rust tools", [1.0, 0.0], fresh=True)).hits
    e.refresh()
    assert e.search(SearchRequest("hybrid", "rust tools", [1.0, 0.0])).hits == fresh and e.total() == 2
    assert e.apply(Command("UpdateDocument", ids=(2,), change=Change().having(content="the garden"))) == 4
    e.apply(Command("UpdateSettings", settings={"tokenizer": TokenizerConfig(remove_stopwords=True)}))
    e.refresh()
    assert e.search(SearchRequest("keyword", "the")).hits == [] and e.status()["dimensions"] == 2
    with pytest.raises(InvalidConfig):
        e.update_settings(dim=3)
    with pytest.raises(ValueError):
        Command("Nothing")
    assert Command("BatchDelete").modifies_documents and not Command("CompactIndex").modifies_documents
    assert Change().empty and Change(content="x").applied({"content": "y", "id": 1}, 7) == {"content": "x", "id": 1, "updated_at": 7}


def test_graph_of_copies(spark):
    """Hundreds of equal and nearly equal vectors don't cut each other off; graphs read back are those that were written."""
    rng = np.random.default_rng(1)
    x = np.concatenate((np.repeat(rng.normal(size=(3, 8)), 150, 0), rng.normal(size=(1, 8)) + 1e-5 * rng.normal(size=(150, 8)), rng.normal(size=(200, 8))))
    order = rng.permutation(len(x))
    x = x[order]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id long, embedding array<double>")
    nodes = graph.built(df, 8)
    asked = [(i, x[i].tolist()) for i in range(0, len(x), 7)]
    got = {}
    for r in graph.find(nodes, asked, 8, 10).collect():
        got.setdefault(r.qid, []).append((r["rank"], r.doc_id))
    hit = 0
    for i, q in asked:
        d = np.round(np.sqrt(((x - np.array(q)) ** 2).sum(1)), 6)
        far = np.sort(d)[9]
        hit += np.mean([d[j] <= far for _, j in got[i]]) * (len(got[i]) == 10)
    assert hit / len(asked) >= 0.95
    assert nodes.count() < len(x) - 400
    g = graph.Graph(8).build(x[np.argsort(np.arange(len(x)))], np.arange(len(x)))
    back = graph.Graph.of(g.rows())
    assert back.layers == g.layers and back.entry == g.entry and back.search(x[3], 5, 50) == g.search(x[3], 5, 50)


def test_quantized_store(spark, tmp_path):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id long, embedding array<float>")
    s = pq.PqStore(spark, str(tmp_path / "pq"), 8, PqConfig(m=4, centroids=16, max_iter=20))
    s.add(df.where("doc_id < 50"))
    assert s.book() is None and s.count() == 50 and {tuple(r.codes) for r in s.codes().collect()} == {(0, 0, 0, 0)}
    book = s.train()
    s.add(df.where("doc_id >= 40"))
    s.remove(spark.createDataFrame([(3,), (999,)], "doc_id long"))
    codes = {r.doc_id: r.codes for r in s.codes().collect()}
    assert sorted(codes) == [i for i in range(80) if i != 3] and all(codes[i] == book.encode(x[[i]].astype(float))[0].tolist() for i in codes)
    assert s.contains(spark.createDataFrame([(3,), (4,)], "doc_id long")).collect()[0].doc_id == 4 and s.waiting().isEmpty()
    q = rng.normal(size=8).tolist()
    exact = sorted(((round(float(np.sqrt(((v - np.array(q)) ** 2).sum())), 6), i) for i, v in enumerate(x) if i != 3))[:5]
    found = pq.exact_search(pq.with_error(s.codes(), book, df), book, df, q, 5).collect()
    assert [(r.distance, r.doc_id) for r in found] == exact
    cache = pq.VectorCache(30)
    short = pq.search(s.codes(), book, q, 40)
    assert [i for i, _ in cache.reranked(short, df, q, 3)] == [i for _, i in exact[:3]] and len(cache) == 30 and cache.misses == 40
    cache.remove(next(iter(cache._rows)))
    assert len(cache) == 29


def test_codebook_against_plain_iterations(spark):
    """Every subspace against the same steps written out row by row."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 6))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id long, embedding array<double>").repartition(3)
    book = pq.train(df, 6, PqConfig(m=3, centroids=5, max_iter=4, tol=0.0))
    first = np.array([r.embedding for r in df.orderBy(F.xxhash64("doc_id"), "doc_id").collect()])
    for s in range(3):
        c = pq.spread(first[:, 2 * s : 2 * s + 2], 5)
        for _ in range(4):
            at = [min(range(5), key=lambda j: ((p - c[j]) ** 2).sum()) for p in x[:, 2 * s : 2 * s + 2]]
            c = np.array([np.mean([p for p, a in zip(x[:, 2 * s : 2 * s + 2], at) if a == j], 0) if j in at else c[j] for j in range(5)])
        assert np.allclose(book.centroids[s], c)


def test_metrics_keep_buckets_only():
    from tessera.plans.metrics import Metrics

    m = Metrics()
    for v in (0.0005, 0.02, 0.02, 7.0):
        m.observe("search_seconds", v)
    text = m.text()
    assert 'search_seconds_bucket{le="0.001"} 1' in text and 'search_seconds_bucket{le="0.05"} 3' in text and 'search_seconds_bucket{le="+Inf"} 4' in text and "search_seconds_sum 7.0405" in text
    assert len(m.seen["search_seconds"]) == 10
