import math
from collections import Counter, defaultdict

import numpy as np

from tessera.llm import langid
from tessera.llm.textops import chunks


def brute(grams, n_langs_vocab):
    """Interpolated Kneser-Ney of one language by its definition: a function of a string of ORDER symbols."""
    top = langid.ORDER
    counts = {top: Counter(grams)}
    for m in range(top - 1, 0, -1):
        counts[m] = Counter(g[1:] for g in counts[m + 1])
    disc = {}
    for m, c in counts.items():
        n1, n2 = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        disc[m] = min(0.95, max(0.05, n1 / (n1 + 2 * n2))) if n1 + 2 * n2 else 0.5
    total, kinds = defaultdict(lambda: defaultdict(int)), defaultdict(lambda: defaultdict(int))
    for m, c in counts.items():
        for g, v in c.items():
            total[m][g[:-1]] += v
            kinds[m][g[:-1]] += 1

    def p(g):
        m = len(g)
        if m == 0:
            return 1 / n_langs_vocab
        t = total[m][g[:-1]]
        if not t:
            return p(g[1:])
        return max(counts[m][g] - disc[m], 0) / t + disc[m] * kinds[m][g[:-1]] / t * p(g[1:])

    return p


def grams_of(text):
    s, off = langid.symbols(next(chunks([text]))[2])
    x = "".join(map(chr, s))
    return [x[i : i + langid.ORDER] for i in range(len(x) - langid.ORDER + 1)]


def test_probabilities_by_definition():
    texts = {"aa": "the cat sat on the mat and the cat ran", "bb": "le chat est sur le tapis et le chat court"}
    lang, gram, n = [], [], []
    for name, t in texts.items():
        for g, c in Counter(grams_of(t)).items():
            lang.append(name), gram.append(g), n.append(c)
    m = langid.Model(lang, gram, np.array(n, float))
    vocabulary = len({g[-1] for g in gram}) + 1
    probs = [brute(grams_of(t), vocabulary) for t in texts.values()]
    for t in ("the mat sat", "le tapis zzz qq", "xyzzy"):
        total, _, size = m.score(*langid.symbols(next(chunks([t]))[2]))
        for i, p in enumerate(probs):
            assert math.isclose(total[0, i], sum(math.log(p(g)) for g in grams_of(t)), rel_tol=1e-4), (t, i)
        assert size[0] == len(grams_of(t))
    symbols = {g[-1] for g in gram} | {"\0"}
    assert math.isclose(sum(probs[0]("the"[:3] + c) for c in symbols), 1, rel_tol=1e-6)


def test_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "text")
    model = langid.train(docs.where("doc_id % 2 = 0"))
    got = langid.scores(docs.where("doc_id % 2 = 1"), model, "text", ["doc_id", "lang"], None).toPandas()
    got = got[got.n >= 40]
    assert (got.best == got.c1).mean() > 0.97


def test_rejection(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "text")
    noise = spark.createDataFrame([(10**9 + i, None, "".join(np.random.default_rng(i).choice(list("qxzjkvw"), 600))) for i in range(20)], docs.schema)
    out = langid.identify(docs.unionByName(noise), keep=["doc_id", "lang"]).toPandas()
    assert len(out) == docs.count() + 20
    assert not out[out.doc_id >= 10**9].accepted.any()
    known = out[(out.doc_id < 10**9) & out.pred_lang.notna() & (out.pred_lang == out.lang)]
    assert known.accepted.mean() > 0.99


def test_edges(spark):
    rows = [(1, "hello there my friend", "en"), (2, "bonjour mon ami cher", "fr"), (3, None, "en"), (4, "", "en"), (5, "12 34 !", "fr"), (6, "hello " * 100_000, None), (1, "hello there my friend", "en"), (7, "hello", "")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, accepted string")
    out = langid.identify(df)
    assert out.columns == ["doc_id", "text", "lang", *langid.ADDED] and out.count() == 8
    got = {r.doc_id: r for r in out.collect()}
    assert got[1].pred_lang == "en" and got[2].pred_lang == "fr" and got[6].pred_lang == "en"
    for i in (3, 4, 5):
        assert got[i].pred_lang is None and got[i].cross_entropy is None and got[i].accepted is False
    none = langid.identify(df.withColumn("lang", df.lang.substr(1, 0)))
    assert none.count() == 8 and {r.pred_lang for r in none.collect()} == {None}
    assert langid.identify(df.limit(0)).count() == 0


def test_models_in_parts(spark):
    """Models beyond what a task holds lose nothing: a rare language stays, scores are those of the models in one piece."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "lang", "text")
    rare = "zorblax quimby fentwick jaxopod wuzzle"
    docs = docs.unionByName(spark.createDataFrame([(10**9, "zz", rare), (10**9 + 1, None, "wuzzle jaxopod \u4e2d\u6587"), (10**9 + 2, None, "..."), (10**9 + 3, None, None)], docs.schema))
    model = langid.train(docs, max_grams=2000)
    assert "zz" in model.langs and len(model.parts) > 1
    columns = ["doc_id", "pred_lang", "cross_entropy", "margin", "accepted"]
    whole, got = ({r.doc_id: r for r in langid.identify(docs, keep=["doc_id", "lang"], max_grams=m).select(*columns).collect()} for m in (10**9, 2000))
    assert whole == got and got[10**9].pred_lang == got[10**9 + 1].pred_lang == "zz"


def test_limits_are_exact(spark):
    """The value of the exact rank, for many values and few."""
    rng = np.random.default_rng(4)
    rows = [("a" if i % 3 else "b", float(x), 1.0, 50) for i, x in enumerate(rng.normal(2, 0.3, 40_000))] + [("c", 1.5, 1.0, 9)]
    own = spark.createDataFrame(rows, "best string, ce double, var double, n long")
    for r in langid.limits_of(own, 0.01).collect():
        x = np.array([v for k, v, *_ in rows if k == r.lang])
        between = max(x.var() - 1 / (50 if r.lang != "c" else 9), 1e-6)
        z = np.sort((x - x.mean()) / np.sqrt(between + 1 / (50 if r.lang != "c" else 9)))
        assert math.isclose(r["limit"], z[max(1, math.ceil(0.99 * len(z))) - 1], abs_tol=1e-9)


def test_other_table_and_ties(spark):
    """A fitted model on texts it never saw: few are rejected wrongly. Equal models tie, and the first language wins."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "text")
    fitted = langid.fit(docs.where("doc_id % 2 = 0"), false_reject=0.005)
    got = langid.apply(docs.where("doc_id % 2 = 1"), fitted, keep=["doc_id", "lang"]).toPandas()
    right = got[got.pred_lang == got.lang]
    assert len(right) > 300 and right.accepted.mean() > 0.97
    same = spark.createDataFrame([(i, lang, f"one two three text {i % 2}") for i in range(8) for lang in ("zz", "mm", "aa")], "doc_id long, lang string, text string")
    assert {(r.pred_lang, r.margin) for r in langid.identify(same).collect()} == {("aa", 0.0)}
