"""What keeps the cost of large inputs in proportion."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq_file
import pytest

from tessera.functions import text
from tessera.operators import graph, keyword, pq, vector
from tessera.operators import index as ix
from tessera.plans.settings import Bm25Params
from tessera.queries import search
from tessera.sources import segments


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_postings_move_nothing(spark):
    docs = spark.createDataFrame([(1, "b a b"), (2, ""), (3, None), (4, "a")], "doc_id long, text string")
    from tessera.plans.settings import TokenizerConfig

    p = ix.postings(ix.tokenized(docs, TokenizerConfig(min_len=1)), positions=True, lengths=True)
    assert "Exchange" not in _plan(p)
    assert sorted(map(tuple, p.select("term", "doc_id", "tf", "doc_len", "positions").collect())) == [("a", 1, 1, 3, [1]), ("a", 4, 1, 1, [0]), ("b", 1, 2, 3, [0, 2])]


def test_postings_of_repeated_ids(spark):
    docs = spark.createDataFrame([(1, "aa bb aa"), (1, "aa"), (2, "cc")], "doc_id long, text string")
    p = ix.postings(ix.tokenized(docs))
    assert sorted(map(tuple, p.select("doc_id", "term", "tf").collect())) == [(1, "aa", 3), (1, "bb", 1), (2, "cc", 1)]


def test_slices_of_tokens(spark, monkeypatch):
    """Tables of postings and lengths from one analysis, in slices smaller than a document."""
    monkeypatch.setattr(ix, "SLICE", 2)
    docs = spark.createDataFrame([(i, "aa bb cc aa " * (i % 4)) for i in range(40)], "doc_id long, text string")
    post, lengths = ix.analysed(ix.tokenized(docs))
    assert {(r.term, r.doc_id): (r.tf, r.doc_len) for r in post.collect()} == {(t, i): (n * (i % 4), 4 * (i % 4)) for i in range(40) if i % 4 for t, n in (("aa", 2), ("bb", 1), ("cc", 1))}
    assert {r.doc_id: r.doc_len for r in lengths.collect()} == {i: 4 * (i % 4) for i in range(40)}


@pytest.mark.parametrize("metric", ["cosine", "dot", "euclidean"])
def test_lists_hold_the_exact_best(metric, monkeypatch):
    """Lists from products in single precision are those of a scalar loop, whatever the order of ids, copies and zero vectors."""
    monkeypatch.setattr(vector, "QUERIES_AT_ONCE", 16)
    monkeypatch.setattr(vector, "ROWS_AT_ONCE", 32)
    r = np.random.default_rng(3)
    for trial in range(12):
        n, k = int(r.integers(1, 150)), int(r.integers(1, 8))
        x = r.normal(size=(n, 5)) * 10.0 ** r.integers(-6, 6) if trial % 2 else r.integers(-2, 3, (n, 5)).astype(float)
        if trial % 3 == 0:
            x = x[r.integers(0, max(1, n // 6), n)]
        q, ids = x[r.integers(0, n, 20)], r.permutation(n).astype(np.int64)
        lists = vector._Lists(np.arange(20), q, k, metric)
        for part in (slice(0, n // 2), slice(n // 2, None)):
            lists.add(ids[part], x[part])
        want = set()
        for i, one in enumerate(q):
            s = vector._exact(np.repeat(one[None], n, 0), x, metric)
            want |= {(i, int(ids[j]), float(s[j])) for j in np.lexsort((ids, -s))[:k]}
        assert {(int(a), int(b), float(c)) for a, b, c in zip(*lists.rows(), strict=True)} == want


def test_stored_graphs_answer_exactly(spark):
    """More neighbours than a walk keeps, some of them copies, at distances that are equal once rounded."""
    r = np.random.default_rng(5)
    x = r.normal(size=(600, 8))
    x[300:320], x[400:420] = x[0], x[1] + 1e-9
    v = spark.createDataFrame([(i, a.tolist()) for i, a in enumerate(x)], "doc_id long, embedding array<double>")
    nodes = graph.built(v, 8, shard_rows=250)
    got = {(g.qid, g.rank): (g.doc_id, g.distance) for g in graph.find(nodes, [(i, x[i].tolist()) for i in (0, 1, 7)], 8, 25, ef=25, exact=True).collect()}
    for i in (0, 1, 7):
        d = np.round(np.sqrt(((x - x[i]) ** 2).sum(1)), 6)
        assert [got[i, n + 1] for n in range(25)] == [(int(j), float(d[j])) for j in np.lexsort((np.arange(600), d))[:25]]


def test_unicode_words_in_slices(spark, monkeypatch):
    texts = ["one two", None, "", "don't stop", "x" * 10 + " yy"]
    whole = text._unicode_words.func(pa.array(texts)).to_pylist()
    monkeypatch.setattr(text, "SLICE_BYTES", 4)
    assert text._unicode_words.func(pa.array(texts)).to_pylist() == whole == [["one", "two"], [], [], ["don't", "stop"], ["x" * 10, "yy"]]


def test_documents_meet_queries_in_bounded_tables(monkeypatch):
    """Tables of a few documents hold each posting once, though batches cut documents."""
    monkeypatch.setattr(keyword, "DOCUMENTS", 3)
    monkeypatch.setattr(keyword, "WAITING", 4)
    r = np.random.default_rng(2)
    rows = [(d, t, int(r.integers(1, 5)), 9) for d in range(40) for t in ("aa", "bb", "cc") if r.random() < 0.6]
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[a : a + 5], strict=True)], names=["doc_id", "term", "tf", "doc_len"]) for a in range(0, len(rows), 5)]
    names, p, got = pa.array(["aa", "bb", "cc"]), Bm25Params(), {}
    for ids, table, there in keyword._tables(batches, names, 7.0, p):
        assert len(ids) <= 3
        for t, j in zip(*np.nonzero(there), strict=True):
            assert (int(ids[j]), names[int(t)].as_py()) not in got
            got[int(ids[j]), names[int(t)].as_py()] = table[t, j]
    assert got == {(d, t): n * (p.k1 + 1) / (n + p.k1 * (1 - p.b + p.b * length / 7.0)) + p.delta for d, t, n, length in rows}


def test_errors_of_codes_need_no_join(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(50, 4))
    v = spark.createDataFrame([(i, a.tolist()) for i, a in enumerate(x)], "doc_id long, embedding array<double>")
    book = pq.Codebook([x[:5, :2], x[:5, 2:]])
    e = pq.errors(v, book)
    assert "Exchange" not in _plan(e) and _plan(e).count("MapInArrow") == 1
    assert [row.error for row in e.orderBy("doc_id").collect()] == pytest.approx(np.sqrt(((book.decode(book.encode(x)) - x) ** 2).sum(1)).tolist())


def test_each_tile_has_a_task_of_its_own(spark, monkeypatch):
    """Tiles of vectors and queries don't meet in one task by their hash, and all pairs are looked at."""
    monkeypatch.setattr(vector, "QUERY_BYTES", 8 * 4 * 8)
    r = np.random.default_rng(6)
    x = r.normal(size=(60, 4))
    v = spark.createDataFrame([(i, a.tolist()) for i, a in enumerate(x)], "doc_id long, embedding array<double>")
    found = vector.batch_search(v, v.withColumnRenamed("doc_id", "qid"), 4, 3, "dot")
    assert _plan(found).count("shufflepartitionidpassthrough") == 2
    want = {(i, int(j)) for i in range(60) for j in np.lexsort((np.arange(60), -np.round(x @ x[i], 6)))[:3]}
    assert {(g.qid, g.doc_id) for g in found.collect()} == want


def test_many_queries_meet_vectors_in_all_tasks(spark, monkeypatch):
    """A table of one file is one task's, whatever the number of queries."""
    monkeypatch.setattr(vector, "DEALT", 10)
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(1, 40)], "doc_id long, embedding array<double>").coalesce(1)
    found = vector.batch_search(v, v.withColumnRenamed("doc_id", "qid"), 2, 1, "dot")
    assert "hashpartitioning(doc_id#" in _plan(found)
    assert {(g.qid, g.doc_id) for g in found.collect()} == {(i, 39) for i in range(1, 40)}


def test_each_graph_has_a_task_of_its_own(spark):
    """Shards don't meet in one task by their hash, neither when they are built nor when they are searched."""
    r = np.random.default_rng(7)
    x = r.normal(size=(90, 4))
    v = spark.createDataFrame([(i, a.tolist()) for i, a in enumerate(x)], "doc_id long, embedding array<double>")
    nodes = graph.built(v, 4, shard_rows=10)
    assert _plan(nodes).count("shufflepartitionidpassthrough") == 1 and "hashpartitioning" not in _plan(nodes)
    found = graph.find(ix.written(nodes), [(i, x[i].tolist()) for i in (0, 50)], 4, 3)
    assert _plan(found).count("shufflepartitionidpassthrough") == 2
    for i in (0, 50):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        assert [g.doc_id for g in found.where(f"qid = {i}").orderBy("rank").collect()] == np.argsort(d)[:3].tolist()


def test_training_reads_vectors_in_all_tasks(spark, monkeypatch):
    """A table of one file would be one task's in each pass."""
    seen = []
    monkeypatch.setattr(pq, "written", lambda df: seen.append(df.rdd.getNumPartitions()) or ix.written(df))
    v = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(60)], "doc_id long, embedding array<double>").coalesce(1)
    book = pq.train(v, 2, pq.PqConfig(m=2, centroids=4))
    assert seen == [spark.sparkContext.defaultParallelism]
    assert sorted(book.centroids[0].ravel().tolist()) == [0.0, 1.0, 2.0]


def test_segments_are_written_and_merged_without_needless_exchanges(spark, tmp_path, monkeypatch):
    """Postings are written where they were counted, sorted by term, and a merge doesn't exchange them for what is deleted."""
    plans = []
    frame = type(spark.range(1))
    own = frame.write.fget
    monkeypatch.setattr(frame, "write", property(lambda df: plans.append((df.columns, _plan(df))) or own(df)))
    monkeypatch.setattr(ix, "SLICE", 7)
    docs = spark.createDataFrame([(i, i % 2, ["bb", "aa", "bb", f"x{i % 5}"] if i % 7 else []) for i in range(40)], "doc_id long, segment_id long, tokens array<string>")
    s = segments.SegmentStore(spark, str(tmp_path))
    s.write(docs)
    saved = [p for c, p in plans if "tf" in c]
    assert saved and not any("Exchange" in p for p in saved)
    for f in (tmp_path / "postings").rglob("*.parquet"):
        t = list(zip(*(pq_file.read_table(f, partitioning=None).column(c).to_pylist() for c in ("term", "doc_id")), strict=True))
        assert t == sorted(t)
    assert {(r.segment_id, r.term, r.doc_id): (r.tf, r.doc_len) for r in s.read("postings").collect()} == {(i % 2, t, i): (n, 4) for i in range(40) if i % 7 for t, n in (("aa", 1), ("bb", 2), (f"x{i % 5}", 1))}
    assert {(r.segment_id, r.n, r.total_len) for r in s.read("stats").collect()} == {(0, 20, 68), (1, 20, 68)}
    plans.clear()
    s.merge([0, 1], 9, spark.range(1, 4).withColumnRenamed("id", "doc_id"))
    (merged,) = [p for c, p in plans if "tf" in c]
    assert merged.count("Exchange rangepartitioning") == 1 and "Exchange hashpartitioning" not in merged and "SortMergeJoin" not in merged
    assert {(r.term, r.df, r.total_tf) for r in s.read("terms", [9]).collect()} == {("aa", 31, 31), ("bb", 31, 62), ("x0", 6, 6), ("x1", 6, 6), ("x2", 6, 6), ("x3", 6, 6), ("x4", 7, 7)}


def test_counted_slices_are_sorted(spark):
    """Each slice of postings comes in the order of segment, term and document, whatever the order of the documents."""
    docs = spark.createDataFrame([(9 - i, i % 2, ["é", "bb", "Z", "bb"]) for i in range(10)], "doc_id long, seg long, tokens array<string>").coalesce(1)
    got = [(r.seg, r.term.encode(), r.doc_id, r.tf, list(r.positions)) for r in ix._counted(docs, True, ("seg",), False).collect()]
    assert got == sorted(got)
    assert got == [(s, t, d, n, p) for s in (0, 1) for t, n, p in ((b"Z", 1, [2]), (b"bb", 2, [1, 3]), ("é".encode(), 1, [0])) for d in range(1 - s, 10, 2)]


def test_texts_are_cut_where_their_terms_are_counted(spark, monkeypatch):
    """No tokens move to the task that counts them, and they are those of ``tokens`` for all characters and settings."""
    from tessera.plans.settings import TokenizerConfig

    monkeypatch.setattr(ix, "SLICE", 700)
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    odd = ["ΑΣ ΑΣ' ΣΑΣ Σ ʰΣ", "İİ İ", "ẞ ẞẞ Ⱥ ȺȺ", "x" * 50 + " " + "y" * 51 + " " + "İ" * 17 + " " + "Ⱥ" * 17, "end", "end", "", None, "...", "é", "eé", "a1b2 ٣٤ Ⅷ ½½ 𝔸𝔸 𐐀𐐀", "a\0b cc\0dd", "The THE running runs", "ﬁﬁ ée"]
    texts = odd + ["".join(every[a : a + 4000]) for a in range(0, len(every), 4000)] + [" ".join("a" + c for c in every[a : a + 3000]) for a in range(0, 0x30000, 3000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for cfg in (None, TokenizerConfig(min_len=1, max_len=9000, lowercase=False), TokenizerConfig(remove_stopwords=True, stem=True, min_len=3)):
        whole, tok = ix.texts(docs, cfg), ix.tokenized(docs, cfg)
        found = ix.postings(whole, positions=True, lengths=True, cfg=cfg)
        assert "regexp_extract_all" not in _plan(found) and "ArrowEvalPython" not in _plan(found)
        want = ix.postings(tok, positions=True, lengths=True)
        a, b = (sorted((r.doc_id, r.term, r.tf, r.doc_len, tuple(r.positions)) for r in x.collect()) for x in (found, want))
        assert a == b
        lengths = ix.analysed(whole, cfg=cfg, repeated=False)[1]
        assert sorted(map(tuple, lengths.collect())) == sorted(map(tuple, ix.doc_stats(tok).collect()))
    twice = ix.InvertedIndex.build(docs.where("doc_id < 9").union(docs.where("doc_id = 4")))
    assert [(r.doc_id, r.tf) for r in twice.postings.where("term = 'end'").orderBy("doc_id").collect()] == [(4, 2), (5, 1)]


def test_bytes_that_are_no_text(spark):
    cut = text.Cutter(text.TokenizerConfig(), text.letters())
    code, terms, size = cut(pa.array([b"aa\xc3", b"bb\xff\xe2\x82cc", b"\xf4\xbf\xbf\xbf aa"], pa.binary()))
    assert [terms[int(i)].as_py() for i in code] == ["aa", "bb", "cc", "aa"] and size.tolist() == [1, 2, 1]


def test_saved_postings_are_sorted_in_bounded_parts(spark, tmp_path, monkeypatch):
    """Few shuffle partitions don't make a task sort more than it holds; files share no term and are sorted."""
    monkeypatch.setattr(ix, "SORTED", 30)
    docs = spark.createDataFrame([(i, " ".join(f"t{j:02d}" for j in range(i % 7, 40))) for i in range(30)], "doc_id long, text string")
    ix.InvertedIndex.build(docs).save(str(tmp_path))
    files = [list(zip(*(pq_file.read_table(f).column(c).to_pylist() for c in ("term", "doc_id")), strict=True)) for f in (tmp_path / "postings").glob("*.parquet")]
    assert len(files) > 20 and all(f == sorted(f) for f in files)
    terms = [{t for t, _ in f} for f in files]
    assert sum(map(len, terms)) == len(set().union(*terms)) == 40
    assert sorted(r for f in files for r in f) == [(f"t{j:02d}", i) for j in range(40) for i in range(30) if j >= i % 7]


def _tables_written(monkeypatch) -> list[int]:
    rows, plain = [], ix.written

    def spied(df, **options):
        out = plain(df, **options)
        rows.append(out.count())
        return out

    monkeypatch.setattr(ix, "written", spied)
    return rows


def _table_of_texts(spark, tmp_path) -> str:
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * 7 + j * j) % 900}" for j in range(200)) + " the of the and" * (i % 3)) for i in range(600)], "doc_id long, text string").coalesce(2)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_block_search_writes_blocks(spark, tmp_path, monkeypatch):
    """The index that is searched by blocks has far fewer rows than postings, and is looked up once."""
    d, rows, looks, plain = _table_of_texts(spark, tmp_path), _tables_written(monkeypatch), [], keyword._scored
    monkeypatch.setattr(keyword, "_scored", lambda *a: looks.append(1) or plain(*a))
    got = search.kw_blockmax_topk(spark, d).collect()
    assert sum(rows) * 100 < ix.postings(ix.tokenized(spark.read.parquet(f"{d}/documents.parquet"))).count()
    assert len(looks) == 1
    assert got == keyword.scan_search(spark.read.parquet(f"{d}/documents.parquet"), "the of and that", 10).collect()


@pytest.mark.parametrize("ids", ["id", "id * id * id * 1000003 - 5000000000", "cast(-id AS int)", "concat('d', id)", "if(id = 3, NULL, id)"])
def test_blocks_hold_the_whole_index(spark, monkeypatch, ids):
    """Whatever the kind of ids, in blocks that cut terms and slices that cut tables."""
    for name, n in (("BLOCK", 7), ("SLICE", 40), ("ROWS", 16)):
        monkeypatch.setattr(ix, name, n)
    texts_ = [None if i == 5 else "" if i == 9 else " ".join(["straße ÜBER über incomprehensibly incomprehensible"] * (i % 4) + ["abcdefgh abcdefghi"] + [f"t{j}" for j in range(i)]) for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts_)), "id long, text string").selectExpr(f"{ids} AS doc_id", "text").coalesce(3)
    rows = _tables_written(monkeypatch)
    made, plain = ix.InvertedIndex.build(docs).packed(), ix.InvertedIndex.build(docs)
    assert len(rows) == 1
    every = lambda df, like: sorted(map(str, df.select(*like.columns).collect()))
    assert made.postings.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
    for a, b in ((made.postings, plain.postings), (made.terms, plain.terms), (made.doc_stats, plain.doc_stats), (made.stats, plain.stats)):
        assert every(a, b) == every(b, b)
    for names in (("über", "t7", "none"), ("abcdefghi",), ()):
        for a, b in zip(made.of(names), plain.of(names), strict=True):
            assert every(a, b) == every(b, b)
    gone = docs.where("length(text) > 60").select("doc_id")
    for a, b in zip(made.live(gone).of(["t3", "straße"]), plain.live(gone).of(["t3", "straße"]), strict=True):
        assert every(a, b) == every(b, b)


def test_repeated_ids_are_no_blocks(spark):
    docs = spark.createDataFrame([(1, "aa bb aa"), (1, "aa"), (2, "cc")], "doc_id long, text string")
    made = ix.InvertedIndex.build(docs).packed()
    assert sorted(map(tuple, made.of(["aa", "cc"])[0].select("doc_id", "term", "tf").collect())) == [(1, "aa", 3), (2, "cc", 1)]


def test_order_and_kinds_of_words():
    r = np.random.default_rng(4)
    for _ in range(300):
        words = ["".join(r.choice(list("abé𐐀zß"), r.choice([1, 2, 4, 7, 8, 9, 12]))) for _ in range(int(r.integers(0, 60)))]
        data = np.frombuffer("".join(words).encode(), np.uint8)
        width = np.array([len(w.encode()) for w in words], np.int64)
        code, found = text._distinct(data, np.cumsum(width) - width, width)
        assert found.take(pa.array(code)).to_pylist() == words and len(set(found.to_pylist())) == len(found)
        assert found.take(pa.array(ix._sorted(found))).to_pylist() == sorted(found.to_pylist(), key=str.encode)


def test_index_search_writes_blocks(spark, tmp_path, monkeypatch):
    d, rows = _table_of_texts(spark, tmp_path), _tables_written(monkeypatch)
    got, docs = search.kw_index_topk(spark, d).collect(), spark.read.parquet(f"{d}/documents.parquet")
    assert sum(rows) * 100 < ix.postings(ix.tokenized(docs)).count()
    assert got == keyword.scan_search(docs, "the of and that", 10).collect()
