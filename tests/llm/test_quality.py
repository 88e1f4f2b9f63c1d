import numpy as np
import pytest

from tessera.llm import quality
from tessera.llm.textops import chunks


def test_gradient():
    rng = np.random.default_rng(0)
    row, col = np.sort(rng.integers(0, 30, 200)), rng.integers(0, 8, 200)
    val, y = rng.normal(size=200), rng.integers(0, 3, 30)
    m, z, c = quality.Ordinal(), rng.normal(size=10) * 0.5, quality.Chunk(np.arange(8), np.searchsorted(row, np.arange(31)), col, val, y)
    _, g = m.loss(z, 8, c.gradient)
    for i in range(10):
        e = np.zeros(10)
        e[i] = 1e-5
        assert (m.loss(z + e, 8, c.gradient)[0] - m.loss(z - e, 8, c.gradient)[0]) / 2e-5 == pytest.approx(g[i], rel=1e-3, abs=1e-4)


def test_fit_against_plain_descent(monkeypatch):
    """Weights and thresholds against gradient descent on the likelihood written out row by row, both taken to the end."""
    monkeypatch.setattr(quality, "GAIN", 1e-12)
    rng = np.random.default_rng(1)
    x = (rng.random((60, 5)) < 0.4).astype(float)
    y = np.clip(np.round(x @ np.array([1.0, 1.0, -1.0, 0.5, 0.0]) + rng.normal(size=60) * 0.5), 0, 2).astype(int)
    row, col = np.nonzero(x)
    c = quality.Chunk(np.arange(5), np.searchsorted(row, np.arange(61)), col, x[row, col], y)
    w, th = quality.Ordinal(l2=1.0, steps=500).fit(5, c.gradient)

    def loss(v):
        cut = [-np.inf, v[5], v[5] + np.exp(v[6]), np.inf]
        s = lambda a: 1 / (1 + np.exp(-a))
        like = sum(np.log(s(cut[k + 1] - x[i] @ v[:5]) - s(cut[k] - x[i] @ v[:5])) for i, k in enumerate(y))
        return -like + 0.5 * v[:5] @ v[:5] + 0.5e-3 * v[5:] @ v[5:]

    v = np.zeros(7)
    for _ in range(3000):
        g = np.array([(loss(v + e) - loss(v - e)) / 2e-6 for e in np.eye(7) * 1e-6])
        v -= 0.02 * g
        if np.abs(g).max() < 1e-3:
            break
    assert np.allclose(w, v[:5], atol=0.01) and np.allclose(th, [v[5], v[5] + np.exp(v[6])], atol=0.01)


def test_chunks_make_the_model_of_one_piece(spark, sf, monkeypatch):
    """Partitioned fit, in several chunks, against all rows in one; every slot of the sample has its weight."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), quality.graded(spark.read.parquet(f"{sf}/labels.parquet"))
    rows = docs.join(labels, "doc_id").where("text IS NOT NULL").dropDuplicates(["doc_id"]).collect()
    whole = quality.train_arrays([r.text for r in rows], np.array([r.grade for r in rows]))
    monkeypatch.setattr(quality, "CHUNK_DOCS", 30)
    parted = quality.fit(docs, labels, max_train=200)  # its optimiser runs in a task, with the module's own settings

    def tails(m):
        return np.concatenate([quality.Scorer(m).tails(t)[0] for _, _, t in chunks([r.text for r in rows])])

    assert np.array_equal(whole["u"] != 0, parted["u"] != 0) and np.abs(tails(whole) - tails(parted)).mean() < 0.02
    monkeypatch.setattr(quality, "GAIN", 1e-10)
    monkeypatch.setattr(quality, "STEPS", 1000)
    whole = quality.train_arrays([r.text for r in rows], np.array([r.grade for r in rows]))
    parted = quality.trained([quality.chunk_of([r.text for r in rows[i::3]], np.array([r.grade for r in rows[i::3]])) for i in range(3)])
    assert np.abs(tails(whole) - tails(parted)).max() < 0.02
    with pytest.raises(ValueError):
        quality.fit(docs, labels, max_train=1 << 40)


def test_repeated_ids_train_alike(spark):
    """Of rows that share an id the same one trains, whatever the partitions."""
    rows = [(1, f"text number {i} of one id") for i in range(20)] + [(2, "another bad text")]
    labels = spark.createDataFrame([(1, 2), (2, 0)], "doc_id long, grade int")
    models = [quality.fit(spark.createDataFrame(rows, "doc_id long, text string").repartition(n), labels) for n in (1, 3, 5)]
    assert all(np.array_equal(m["u"], models[0]["u"]) for m in models)


def test_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), quality.graded(spark.read.parquet(f"{sf}/labels.parquet"))
    even = labels.where("doc_id % 2 = 0")
    model = quality.fit(docs, even)
    got = quality.score(docs.join(labels.where("doc_id % 2 = 1").select("doc_id"), "doc_id", "left_semi"), model, keep=["doc_id"]).join(labels, "doc_id").toPandas()
    good, toxic, low = (got[got.grade == g] for g in (2, 1, 0))
    assert good.keep.mean() > 0.99 and toxic.keep.mean() < 0.2 and low.keep.mean() < 0.05
    assert good.expected_grade.mean() > low.expected_grade.mean() + 1
    assert (got.p_ge_1 >= got.p_ge_2 - 1e-12).all() and np.allclose(got.expected_grade, got.p_ge_1 + got.p_ge_2)


def test_edges(spark):
    docs = spark.createDataFrame([(1, "good words here", 1), (2, "bad bad junk", 2), (3, None, 3), (4, "", 4), (5, "...", 5), (6, "good " * 200_000, 6), (1, "good words here", 1), (None, "good", 9)], "doc_id long, text string, keep int")
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, None), (2, 0, 1), (2, None, 0), (None, 1, 1), (77, 1, 0)], "doc_id long, quality int, toxic int")
    grades = {r.doc_id: r.grade for r in quality.graded(labels).collect()}
    assert grades == {1: 2, 2: 0, 77: 2}
    model = quality.fit(docs, quality.graded(labels))
    out = quality.score(docs, model)
    assert out.columns == ["doc_id", "text", *quality.SCORES] and out.count() == 8
    got = {r.doc_id: r for r in out.collect()}
    assert [got[i].p_ge_2 for i in (3, 4, 5)] == [None] * 3 and not any(got[i].keep for i in (3, 4, 5))
    assert got[1].expected_grade > got[2].expected_grade
    none = quality.fit(docs, quality.graded(labels.limit(0)))
    assert none is None
    kept = {r.doc_id: r.keep for r in quality.score(docs, None).collect()}
    assert kept[1] and kept[2] and not kept[3] and not kept[5]
    assert quality.score(docs.limit(0), model).count() == 0
    assert quality.fit(docs.limit(0), quality.graded(labels)) is None


def test_rare_telling_word_among_many_features():
    """More than 65,536 features more frequent than a telling word don't put it out."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    texts = [[] for _ in range(200)]
    for i, word in enumerate("".join(map(chr, w)) for w in rng.integers(97, 123, (30_000, 8))):
        for j in range(8):
            texts[(i + 25 * j) % 200].append(word)
    grades = np.full(200, 2)
    for i in range(0, 180, 30):
        texts[i].append("vilest")
        grades[i] = 1
    model = quality.train_arrays(pa.array([" ".join(x) for x in texts]), grades)
    assert np.count_nonzero(model["u"]) > 1 << 16
    assert (model["u"][quality.features(next(chunks(pa.array(["vilest"])))[2])[1]] != 0).all()
    plain, toxic = quality.Scorer(model).tails(next(chunks(pa.array(["some words", "some vilest words"])))[2])[0][:, 1]
    assert toxic < plain - 0.001
