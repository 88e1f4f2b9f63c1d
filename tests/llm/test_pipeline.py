"""The pipeline's stages, each against the operator's brute-force counterpart, and as a whole."""

import base64
import sys
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline  # noqa: E402

from tessera.llm import bpe, mixing  # noqa: E402
from tests.llm.test_bpe import PATH, PATTERN  # noqa: E402
from tests.llm.test_jaccard import brute as near  # noqa: E402
from tests.llm.test_linededup import brute as lines  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_in_order(spark, sf):
    import tiktoken

    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    f = dict(corpus_pipeline.STAGES)
    good = f["quality classifier"](spark, docs, sf)
    assert good.columns == COLUMNS and 0 < good.count() < docs.count()
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r.doc_id for r in good.collect()}
    clean = [i for i, r in labels.items() if r.quality == 1 and r.toxic == 0]
    assert np.mean([i in kept for i in clean]) > 0.98
    assert np.mean([i in kept for i, r in labels.items() if r.quality == 0 or r.toxic == 1]) < 0.1
    rows = [(r.doc_id, r.text) for r in good.collect()]
    single = f["line dedup"](spark, good, sf)
    expected = {i: t for i, (t, _, dropped) in lines(rows).items() if not dropped or t.strip(" \t\r\n")}
    assert single.columns == COLUMNS and {r.doc_id: r.text for r in single.collect()} == expected
    assert all(r.n_chars == len(r.text) for r in single.collect() if r.text is not None)
    unique = f["n-gram Jaccard join"](spark, single, sf)
    parent = {i: i for i in expected}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in near(list(expected.items())):
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    firsts = {i for i in expected if root(i) == i}
    left = {r.doc_id for r in unique.collect()}
    assert unique.columns == COLUMNS and firsts <= left and len(left) <= 1.02 * len(firsts)
    mixed = f["mixing sources to target weights"](spark, unique, sf)
    plan = {(r.doc_id, r.source): r.copies for r in mixing.plan(unique).collect()}
    got = {}
    for r in mixed.collect():
        got[(r.doc_id, r.source)] = got.get((r.doc_id, r.source), 0) + 1
    assert mixed.columns == COLUMNS and got == {k: n for k, n in plan.items() if n}
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    known = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r.doc_id: r.text for r in mixed.collect()}
    for r in f["byte-level BPE"](spark, mixed, sf).collect():
        assert r.token_ids == known.encode_ordinary(texts[r.doc_id])


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 0 and out.columns == ["doc_id", "lang", "source", "n_chars", "n_tokens", "token_ids", "token_offsets"]
    assert bpe.decode(out).where("text IS NULL").count() == 0


def test_odd_documents(spark, sf, tmp_path):
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (2, None, "en", None, None), (3, "word " * 100_000, "en", "a", 500_000), (4, "plain words of a text", "en", "b", 21), (4, "plain words of a text", "en", "b", 21)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for table in (docs, docs.limit(0)):
        at = table
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, at, sf)
            out.write.mode("overwrite").parquet(f"{tmp_path}/{i}")
            at = spark.read.schema(out.schema).parquet(f"{tmp_path}/{i}")
        ids = {r.doc_id for r in at.collect()}
        assert ids <= {3, 4} and (table is docs or not ids)
    clash = docs.withColumn("keep", docs.lang).withColumn("n_dropped", docs.lang)
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, clash, sf)
        assert out.columns == [*COLUMNS, "keep", "n_dropped"] and {r.keep for r in out.collect()} | {r.n_dropped for r in out.collect()} <= {"en", None}


def test_repeated_rows_leave_one(spark, sf):
    """Equal rows, versions of one id, and copies under other ids are one document; rows without an id stay."""
    rows = [(7, "a b c d e f", "en", "x", 11)] * 3 + [(8, "A b c d e f", "en", "y", 11), (9, "other words than those", "en", "x", 22), (9, "yet another text of it", "en", "x", 22), (None, "no id here", "en", "x", 10), (None, "no id here", "en", "x", 10), (11, None, "en", "x", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = [corpus_pipeline.near_duplicates(spark, docs.repartition(n), sf).orderBy("doc_id", "text").collect() for n in (1, 4)]
    assert got[0] == got[1] and [r.doc_id for r in got[0]] == [None, None, 7, 9, 11]
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), sf).columns == COLUMNS


def test_quality_stage_by_hand(spark, sf):
    """What stays against the model's definition, document by document: sums of weights over distinct words and beginnings."""
    from tessera.llm import quality
    from tessera.llm.textops import chunks

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality.fit(docs, quality.graded(spark.read.parquet(f"{sf}/labels.parquet")))
    kept = {r.doc_id for r in corpus_pipeline.quality_filter(spark, docs, sf).collect()}
    for r in docs.collect():
        keep = False
        if r.text:
            t = next(chunks([r.text], 1 << 30))[2]
            _, slots, _, style, n = quality.features(t)
            if len(slots):
                f = sum(float(model["u"][x]) for x in set(slots.tolist())) + 20.0 * sum(float(model["u"][(1 << 20) + x]) for x in style.tolist()) / max(int(n[0]), 1)
                p = 1 / (1 + np.exp(model["th"][1] - f))
                if abs(p - quality.SELECT) < 1e-3:
                    continue
                keep = p >= quality.SELECT
        assert keep == (r.doc_id in kept), r.doc_id
