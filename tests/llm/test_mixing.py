import numpy as np

from tessera.llm import mixing


def table(spark, n=600):
    rng = np.random.default_rng(1)
    rows = [(i, f"s{int(i % 10 > 6) + int(i % 10 > 8)}", "x" * int(rng.integers(1, 200))) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, source string, text string")


def test_sums_and_parts(spark):
    docs = table(spark)
    plan = mixing.plan(docs).toPandas()
    assert len(plan) == 600
    assert ((plan.copies == np.floor(plan.expected)) | (plan.copies == np.ceil(plan.expected))).all()
    for _, g in plan.groupby("source"):
        assert abs((g.copies * g["size"]).sum() - (g.expected * g["size"]).sum()) <= g["size"].max()
    mass = plan.assign(m=plan["size"] * plan.expected).groupby("source").m.sum()
    weight = plan.groupby("source")["size"].sum() ** 0.5
    assert np.allclose(mass / mass.sum(), weight / weight.sum())
    rows = mixing.mixed(docs, mixing.plan(docs))
    assert rows.columns == docs.columns and rows.count() == plan.copies.sum()


def test_expectation_over_seeds(spark):
    docs, times = table(spark, 60), 16
    total = sum(mixing.plan(docs, seed=s).orderBy("doc_id").toPandas().copies for s in range(times))
    expected = mixing.plan(docs).orderBy("doc_id").toPandas().expected
    assert np.abs(total / times - expected).max() < 0.5 and abs((total / times - expected).mean()) < 0.03


def test_pairs_are_dependent():
    h = np.arange(400, dtype=np.uint64) * np.uint64(7919)
    p = np.full(400, 0.3)
    for seed in range(20):
        out, live = mixing.pivot(np.zeros(400, int), p, np.ones(400), h, seed)
        assert len(live) <= 1 and abs(out.sum() - 120) < 1e-6  # independent draws would differ by 9


def test_tree_and_partitions(spark, monkeypatch):
    docs = table(spark)
    whole = sorted(map(tuple, mixing.plan(docs).collect()))
    assert sorted(map(tuple, mixing.plan(docs.repartition(7)).collect())) == whole
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 8)
    monkeypatch.setattr(mixing, "FAN_IN", 4)
    plan = mixing.plan(docs).toPandas()
    assert len(plan) == 600
    for _, g in plan.groupby("source"):
        assert abs((g.copies * g["size"]).sum() - (g.expected * g["size"]).sum()) <= g["size"].max()


def test_targets_and_edges(spark):
    docs = spark.createDataFrame([(1, "a", "xy"), (1, "a", "xy"), (None, None, None), (3, "b", ""), (4, "c", "long " * 100_000)], "doc_id long, source string, text string")
    t = spark.createDataFrame([("a", 1.0), (None, 1.0), ("b", 2.0), ("nowhere", 9.0)], "source string, weight double")
    plan = {(r.doc_id, r.source): r for r in mixing.plan(docs, t, budget=80.0).collect()}
    assert plan[(4, "c")].copies == 0 and plan[(3, "b")].copies == 40 and plan[(None, None)].copies == 20
    assert plan[(1, "a")].size == 6 and plan[(1, "a")].copies in (3, 4)
    kept = mixing.mixed(docs, mixing.plan(docs, t, budget=80.0)).groupBy("source").count().collect()
    assert dict(map(tuple, kept))["a"] == 2 * plan[(1, "a")].copies
    assert mixing.plan(docs.limit(0)).count() == 0
    assert {r.copies for r in mixing.plan(docs, t.limit(0)).collect()} == {0}


def scalar_plan(units, seed=1, buckets=1, fan_in=64):
    """Pivotal rounding unit by unit in plain Python; units: {(source, h, doc_id): (size, expected)}."""
    mask = (1 << 64) - 1

    def mix(h):
        h ^= h >> 30
        h = h * 0xBF58476D1CE4E5B9 & mask
        h ^= h >> 27
        h = h * 0x94D049BB133111EB & mask
        return h ^ h >> 31

    p = {k: e - np.floor(e) for k, (_, e) in units.items()}
    part = {k: (k[1] % buckets) for k in units}
    todo = dict(part)
    while True:
        groups = {}
        for k in sorted(todo, key=lambda k: (k[0], k[1] & mask, k[2])):
            groups.setdefault((todo[k], k[0]), []).append(k)
        left = {}
        for (b, _), ks in groups.items():
            for k in ks:
                p[k] = 0.0 if p[k] < 1e-9 else 1.0 if p[k] > 1 - 1e-9 else p[k]
            live, turn = [k for k in ks if 0 < p[k] < 1], 0
            while len(live) > 1:
                for i, j in zip(live[::2], live[1::2]):
                    wi, wj = units[i][0], units[j][0]
                    up, down = min((1 - p[i]) * wi, p[j] * wj), min(p[i] * wi, (1 - p[j]) * wj)
                    u = (mix((i[1] & mask) * 0x9E3779B97F4A7C15 & mask ^ (j[1] & mask) ^ (seed + 1000003 * turn)) >> 11) / (1 << 53)
                    go = up if u * (up + down) < down else -down
                    p[i] += go / wi
                    p[j] -= go / wj
                    for k in (i, j):
                        p[k] = 0.0 if p[k] < 1e-9 else 1.0 if p[k] > 1 - 1e-9 else p[k]
                live, turn = [k for k in live if 0 < p[k] < 1], turn + 1
            left |= {k: b // fan_in for k in live}
        todo = left
        if buckets == 1:
            return p, set(todo)
        buckets = -(-buckets // fan_in)


def test_against_a_scalar_loop(spark, monkeypatch, sf):
    """Copies of every unit against pairs taken one by one; of each source only the root's residual is left to its own draw."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(mixing, "BUCKET_ROWS", 64)
    monkeypatch.setattr(mixing, "FAN_IN", 2)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = mixing.plan(docs).withColumn("h", F.xxhash64(F.lit(1), "doc_id", "source")).collect()
    units = {(r.source, r.h, r.doc_id): (r.size, r.expected) for r in rows}
    p, open_ = scalar_plan(units, buckets=-(-len(units) // 64), fan_in=2)
    for r in rows:
        k = (r.source, r.h, r.doc_id)
        assert r.copies - np.floor(r.expected) == p[k] or k in open_
    assert len(open_) <= len({r.source for r in rows})
    monkeypatch.undo()
    got = {(r.doc_id, r.source): r["count"] for r in mixing.op1_mixing(spark, sf).groupBy("doc_id", "source").count().collect()}
    assert got == {(r.doc_id, r.source): r.copies for r in mixing.plan(docs).collect() if r.copies}


def test_clashing_names_and_other_ids(spark):
    import pytest

    docs = spark.createDataFrame([(1, "a", "xy", 7, "k", 5), (2, "a", "z", 8, "l", 6)], "doc_id int, source string, text string, __i int, copies string, `of` int")
    t = spark.createDataFrame([("a", 1.0)], "source string, weight double")
    out = mixing.mixed(docs, mixing.plan(docs, t, budget=10.0))
    assert out.columns == docs.columns and {(r["__i"], r["copies"], r["of"]) for r in out.collect()} == {(7, "k", 5), (8, "l", 6)}
    with pytest.raises(ValueError):
        mixing.plan(docs.withColumn("doc_id", docs.text))
