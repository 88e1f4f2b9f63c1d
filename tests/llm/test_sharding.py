import numpy as np
from pyspark.sql import functions as F

from tessera.llm import sharding


def order(r):
    return tuple((x is not None, x if not isinstance(x, str) else x.encode()) if x is not None else (False, 0) for x in r)


def test_even_and_sorted(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), "hot" if i % 3 else f"s{i % 7}", "é" * int(rng.integers(0, 400))) for i in rng.permutation(3000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(6)
    out = sharding.shard(df, ["source", "doc_id"], 40_000)
    got = [(r.shard, r.source, r.doc_id, len((r.text or "").encode())) for r in out.withColumn("p", F.spark_partition_id()).orderBy("shard").collect()]
    assert sorted(r[2] for r in got) == list(range(3000))
    total = sum(r[3] for r in got)
    shards = -(-total // 40_000)
    size = np.zeros(shards)
    for s, *_, n in got:
        size[s] += n
    assert np.abs(size - total / shards).max() <= 2 * 0.02 * total / shards + 800
    by = {}
    for s, a, i, _ in got:
        by.setdefault(s, []).append((a.encode(), i))
    for s in range(1, shards):
        assert max(by[s - 1]) < min(by[s])
    parts = out.withColumn("p", F.spark_partition_id()).groupBy("shard").agg(F.countDistinct("p").alias("n")).collect()
    assert {r.n for r in parts} == {1}
    inside = out.rdd.glom().collect()
    for p in inside:
        keys = [(r.shard, r.source.encode(), r.doc_id) for r in p]
        assert keys == sorted(keys)


def test_edges(spark):
    rows = [(None, None, None), (1, "a", "x" * 100_000), (1, "a", "y"), (1, "a", "y"), (-5, "a\0b", ""), (2, "", "z"), (3, "é", "z")] + [(9, "t", "same")] * 50
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, source string, text string, shard int")
    out = sharding.shard(df, ["source", "doc_id"], 60)
    got = out.collect()
    assert len(got) == len(rows) and out.columns == ["shard", "doc_id", "source", "text"]
    keys = [((r.source is not None, (r.source or "").encode()), (r.doc_id is not None, r.doc_id or 0)) for r in sorted(got, key=lambda r: r.shard)]
    last = {}
    for r, k in zip(sorted(got, key=lambda r: r.shard), keys, strict=True):
        last.setdefault(r.shard, []).append(k)
    shards = sorted(last)
    for a, b in zip(shards, shards[1:]):
        assert max(last[a]) <= min(last[b])
    assert sharding.shard(df.limit(0), ["doc_id"], 10).count() == 0
    assert sharding.shard(df, ["doc_id"], 1 << 30).select("shard").distinct().count() == 1


def test_kinds_of_keys(spark):
    """Numbers, dates, times and bytes order by value, not as text."""
    import datetime as dt
    from decimal import Decimal

    import pytest

    n = 60
    rng = np.random.default_rng(3)
    doubles = [-3.0, 10.5, 9.0, -0.0, 0.0, float("inf"), float("-inf"), float("nan"), 1e-300, -1e300, *rng.normal(size=n - 10).tolist()]
    rows = [(i, x, float(np.float32(x)), Decimal(f"{(i * 37 % 101) - 50}.{i % 100:02d}"), dt.date(1900, 1, 1) + dt.timedelta(days=(i * 997) % 60000), dt.datetime(1960, 1, 1) + dt.timedelta(seconds=(i * 7919) % 10**6 * 1000), i % 2 == 0, bytes([i % 3, 0, (i * 7) % 256][: i % 4]), "x" * 20) for i, x in enumerate(doubles)]
    df = spark.createDataFrame(rows, "doc_id long, a double, b float, c decimal(12,2), d date, e timestamp, f boolean, g binary, text string").repartition(4)
    for c in "abcdefg":
        keys = [r[0] for r in sharding.shard(df.select("doc_id", c, "text"), [c, "doc_id"], 200).orderBy("shard", sharding.sort_key(df, [c, "doc_id"])).select(c).collect()]
        keys = [bytes(k) if isinstance(k, bytearray) else k for k in keys]
        want = sorted((r["abcdefg".index(c) + 1] for r in rows), key=lambda v: (v != v, 0.0 if v != v else v))
        assert [str(k) for k in keys] == [str(w) for w in want] or [float(k) for k in keys if k == k] == [float(w) for w in want if w == w], c
    with pytest.raises(ValueError):
        sharding.shard(df.withColumn("h", F.array("doc_id")), ["h"], 200)


def test_splitters_against_brute_force(spark, sf):
    """Every splitter is a key whose exact bytes below lie within the tolerance of its target, or no nearer key exists."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "text")
    out = sharding.shard(docs, ["source", "doc_id"], 20_000)
    rows = sorted(((r.source.encode(), r.doc_id, r.shard, len(r.text.encode()) if r.text else 0) for r in out.collect()), key=lambda r: r[:2])
    below = np.concatenate(([0], np.cumsum([r[3] for r in rows])))
    total, shards = below[-1], -(-below[-1] // 20_000)
    assert [r[2] for r in rows] == sorted(r[2] for r in rows) and len(rows) == docs.count()
    for s in range(1, shards):
        first = next((i for i, r in enumerate(rows) if r[2] >= s), len(rows))
        target = s * total / shards
        assert abs(below[first] - target) <= max(0.02 * total / shards, np.abs(below - target).min() + 1e-9)


def test_clashing_names(spark):
    df = spark.createDataFrame([(i, f"s{i % 3}", "t" * i, i, "q") for i in range(30)], "doc_id long, source string, text string, key int, row string")
    out = sharding.shard(df, ["source", "doc_id"], 100)
    assert out.columns == ["shard", *df.columns] and {(r.doc_id, r.key) for r in out.collect()} == {(i, i) for i in range(30)}
