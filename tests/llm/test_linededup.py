import numpy as np

from tessera.llm.linededup import Cuckoo, LineIndex
from tests.compare import connect, differences


def brute(rows, seen=None):
    seen, out = set() if seen is None else seen, {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        if t is None:
            out[i] = (None, 0, 0)
            continue
        kept, n = [], 0
        for line in t.split("\n"):
            n += 1
            key = line.strip(" \t\r")
            if key and key in seen:
                continue
            if key:
                seen.add(key)
            kept.append(line)
        out[i] = ("\n".join(kept), n, n - len(kept))
    return out


def shown(df):
    return {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in df.collect()}


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def random_rows(n, seed, start=0):
    rng = np.random.default_rng(seed)
    return [(start + i, "\n".join(f" line {rng.integers(0, 40)}" + " " * int(rng.integers(0, 3)) if rng.random() < 0.9 else "" for _ in range(int(rng.integers(0, 12))))) for i in range(n)]


def test_like_sql(spark, sf):
    from tessera.llm import linededup

    assert differences(linededup.op3_linededup(spark, sf), connect(sf), linededup.ORACLES["op3_linededup"]) == ""


def test_increments_and_deletions(spark):
    first, second = random_rows(40, 1), random_rows(40, 2, 100)
    index, seen = LineIndex(spark, shard_lines=50), set()
    assert shown(index.insert(frame(spark, first))) == brute(first, seen)
    assert shown(index.insert(frame(spark, second))) == brute(second, seen)
    gone = {i for i, _ in first if i % 3 == 0} | {12345}
    index.delete(spark.createDataFrame([(i,) for i in gone], "doc_id long"))
    left = [r for r in first + second if r[0] not in gone]
    assert shown(index.clean(frame(spark, left))) == brute(left)
    counts = {}
    for _, t in left:
        for line in t.split("\n"):
            if key := line.strip(" \t\r"):
                counts[key] = counts.get(key, 0) + 1
    assert sorted(r.n for r in index.counts().collect()) == sorted(counts.values())
    # a line that is gone altogether is kept again, as the filters forgot it
    index.delete(spark.createDataFrame([(i,) for i, _ in left], "doc_id long"))
    third = [(900 + i, t) for i, t in first]
    assert shown(index.insert(frame(spark, third))) == brute(third)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "a\na\n\na"), (4, "a"), (4, "a"), (5, "b\n" * 100_000), (None, "c\na")]
    df = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, n_dropped string")
    out = LineIndex(spark).insert(df).collect()
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in out}
    assert len(out) == 7 and got[1] == (None, 0, 0) and got[2] == ("", 1, 0) and got[3] == ("a\n", 4, 2) and got[4] == ("", 1, 1) and got[5][2] == 99_999 and got[None] == ("c", 2, 1)
    assert LineIndex(spark).insert(df.limit(0)).count() == 0


def test_cuckoo():
    rng = np.random.default_rng(0)
    a, b = (rng.integers(0, 1 << 63, 5000).astype(np.uint64) for _ in range(2))
    c = Cuckoo()
    c.add(a[:3000], b[:3000])
    c.add(a[3000:], b[3000:])
    assert c.holds(a, b).all()
    x, y = (rng.integers(0, 1 << 63, 20_000).astype(np.uint64) for _ in range(2))
    assert c.holds(x, y).mean() < 0.01
    c = Cuckoo.load(c.dump())
    c.remove(a[:4000], b[:4000])
    assert c.holds(a[4000:], b[4000:]).all() and c.holds(a[:4000], b[:4000]).mean() < 0.01
    c.add(a[:4000], b[:4000])
    assert c.holds(a, b).all()


def test_history_like_sql(spark, sf):
    from tessera.llm import linededup

    assert differences(linededup.linededup_history(spark, sf), connect(sf), linededup.ORACLES["linededup_history"]) == ""


def test_another_session_goes_on(spark, tmp_path):
    """A reopened index knows its lines; a named batch that is inserted again changes nothing; shards grow with the lines."""
    first, second = random_rows(40, 1), random_rows(300, 2, 100)
    path, seen = f"file://{tmp_path}/lines", set()
    a = LineIndex(spark, path, shard_lines=16)
    want = brute(first[:1], seen)
    assert shown(a.insert(frame(spark, first[:1]), batch="one")) == want and a.shards == 1
    b = LineIndex(spark, path, shard_lines=16)
    assert (b.shards, b.generation) == (1, 1)
    assert shown(b.insert(frame(spark, first[:1]), batch="one")) == want and b.generation == 1 and sorted(map(tuple, b.counts().collect())) == sorted(map(tuple, a.counts().collect()))
    assert shown(b.insert(frame(spark, first[1:]), batch="two")) == brute(first[1:], seen)
    c = LineIndex(spark, path, shard_lines=16)
    assert shown(c.insert(frame(spark, second), batch="three")) == brute(second, seen) and c.shards >= 64
    assert c.filters.count() == c.filters.select("shard").distinct().count() > 10


def test_failed_insert_leaves_the_state(spark, monkeypatch):
    import pytest

    index, rows = LineIndex(spark), random_rows(20, 3)
    index.insert(frame(spark, rows[:10]), batch="a")
    before = (index.generation, index.shards, index.counts().count())
    with monkeypatch.context() as m:
        m.setattr(index, "_commit", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            index.insert(frame(spark, rows[10:]), batch="b")
    assert (index.generation, index.shards, index.counts().count()) == before
    assert shown(index.insert(frame(spark, rows[10:]), batch="b")) == {i: v for i, v in brute(rows).items() if i >= 10}


def test_clashing_names_and_other_ids(spark):
    import pytest

    df = spark.createDataFrame([(1, "a\na", 7, "x", [1]), (2, "a\nb", 8, "y", None)], "doc_id int, text string, __id int, lines string, __drop array<int>")
    out = LineIndex(spark).insert(df)
    assert out.columns == [*df.columns, "n_lines", "n_dropped"]
    assert {(r.doc_id, r.text, r["__id"], r["lines"]) for r in out.collect()} == {(1, "a", 7, "x"), (2, "b", 8, "y")}
    with pytest.raises(ValueError):
        LineIndex(spark).insert(df.withColumn("doc_id", df.text))


def test_cuckoo_equal_fingerprints():
    """More equal fingerprints than two buckets hold, and their removal one by one."""
    c = Cuckoo()
    k = np.full(40, 77, np.uint64)
    c.add(k, k)
    assert sum(int((s != 0).sum()) for s in c.segments) == 40
    c.remove(k[:39], k[:39])
    assert sum(int((s != 0).sum()) for s in c.segments) == 1 and c.holds(k[:1], k[:1])[0]
    c.remove(k[:1], k[:1])
    assert not c.holds(k[:1], k[:1])[0]
