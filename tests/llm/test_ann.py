import numpy as np

from tessera.llm import ann


def exact(x, k):
    d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    return np.argsort(d, 1, kind="stable")[:, :k]


def recall(rows, truth):
    got = {}
    for r in rows:
        got.setdefault(r.id, set()).add(r.neighbour)
    return np.mean([len(got.get(i, set()) & set(t.tolist())) / len(t) for i, t in enumerate(truth)])


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(5)


def test_recall_of_every_query(spark):
    rng = np.random.default_rng(0)
    x = (rng.normal(size=(12, 16))[rng.integers(0, 12, 3000)] + 0.6 * rng.normal(size=(3000, 16))).astype(np.float32)
    rows = ann.neighbours(frame(spark, x), shard_rows=400).collect()
    assert len(rows) == 30_000 and recall(rows, exact(x.astype(float), 10)) >= 0.9
    by = {}
    for r in rows:
        by.setdefault(r.id, []).append((r.rank, r.distance, r.neighbour))
        assert r.id != r.neighbour
    for i, got in by.items():
        got.sort()
        assert [g[0] for g in got] == list(range(1, 11)) and [g[1] for g in got] == sorted(g[1] for g in got)
        assert abs(got[0][1] - np.sqrt(((x[i] - x[got[0][2]]) ** 2).sum())) < 1e-3


def test_table(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    x = np.array([r.embedding for r in df.orderBy("vec_id").collect()], float)
    truth = exact(x, 10)
    assert recall(ann.neighbours(df).collect(), truth) >= 0.9
    asked = ann.op7_ann(spark, sf).collect()
    assert {r.id for r in asked} == set(range(0, len(x), 100)) and len(asked) == 10 * len(range(0, len(x), 100))
    assert np.mean([r.neighbour in truth[r.id] for r in asked]) >= 0.9


def test_exhaustive_with_copies(spark):
    """Exact neighbours over several batches and partitions, equal vectors by id."""
    rng = np.random.default_rng(8)
    x = np.repeat(rng.normal(size=(60, 8)), 20, 0).astype(np.float32)
    df = frame(spark, x).select("vec_id", "embedding")
    got = ann.exhaustive(df, [(i, x[i].tolist()) for i in (0, 25, 1199)], 30).collect()
    for i in (0, 25, 1199):
        want = ann._top(x[i], x, np.arange(len(x)), i, 30)[0].tolist()
        assert [r.id for r in sorted(got, key=lambda r: (r.d, r.id)) if r.query == i] == want


def test_queues_as_matrix_and_as_heap():
    rng = np.random.default_rng(9)
    tree, _ = ann.local_tree(rng.normal(size=(3000, 6)).astype(np.float32), 1)
    y = rng.normal(size=(300, 6)).astype(np.float32)
    whole = ann.order_of(tree)(y, 9)
    ann.MATRIX_NODES, kept = 0, ann.MATRIX_NODES
    try:
        assert np.mean(ann.order_of(tree)(y, 9) == whole) > 0.99
    finally:
        ann.MATRIX_NODES = kept


def test_edges(spark):
    rows = [(i, [float(i), 0.0]) for i in range(5)] + [(5, [4.0, 0.0]), (6, None), (7, [1.0]), (8, [float("nan"), 1.0]), (9, [1.0, None]), (None, [1.0, 1.0]), (0, [9.0, 9.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, distance string")
    got = ann.neighbours(df, k=10).collect()
    assert {r.id for r in got} == set(range(6)) and len(got) == 30
    assert [(r.neighbour, r.distance) for r in sorted(got, key=lambda r: r.rank) if r.id == 4][:2] == [(5, 0.0), (3, 1.0)]
    assert [r.neighbour for r in sorted(got, key=lambda r: r.rank) if r.id == 2][:2] == [1, 3]
    assert ann.neighbours(df.limit(0)).count() == 0
    assert ann.neighbours(df.limit(1)).count() == 0
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(300)], "vec_id long, embedding array<float>")
    assert ann.neighbours(same, k=3, shard_rows=50).count() == 900
    cos = ann.neighbours(spark.createDataFrame([(1, [1.0, 0.0]), (2, [5.0, 0.1]), (3, [0.0, 0.0])], "vec_id long, embedding array<float>"), k=1, metric="cosine").collect()
    assert {(r.id, r.neighbour) for r in cos} >= {(1, 2), (2, 1)} and next(r.distance for r in cos if r.id == 3) == 0.5


def test_copies_rank_by_id():
    """More equal or nearly equal vectors than are kept by float32 distance, in several leaves."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=(4, 16)) * 30
    x = np.concatenate((np.repeat(base[:1], 2000, 0), np.repeat(base[1:2], 300, 0) + 1e-5 * rng.normal(size=(300, 16)), base[2] + rng.normal(size=(700, 16)))).astype(np.float32)
    ids = np.arange(len(x))
    tree, members = ann.local_tree(x, 7)
    asked = np.concatenate((np.arange(0, 2000, 400), np.arange(2000, 2300, 40), np.arange(2300, 3000, 100)))
    query, got, d = ann.search_leaves(tree, members, ids, x, asked, x[asked], len(tree.leaves()), 10)
    for i in asked.tolist():
        truth = ann._top(x[i], x, ids, i, 10)
        assert got[query == i].tolist() == truth[0].tolist() and np.array_equal(d[query == i], truth[1])
