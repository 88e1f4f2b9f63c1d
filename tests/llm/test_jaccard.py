import re

import numpy as np
import pytest

from tessera.llm import jaccard
from tests.compare import connect


def grams(text):
    w = re.findall(r"[^\W_]+", text.lower())
    if not w:
        return set()
    return {tuple(w)} if len(w) < 3 else set(zip(w, w[1:], w[2:]))


def brute(rows, threshold=0.5):
    sets = [(i, grams(t)) for i, t in rows if t is not None and i is not None]
    out = {}
    for k, (i, a) in enumerate(sets):
        for j, b in sets[k + 1 :]:
            if i != j and a and b and (x := len(a & b) / len(a | b)) >= threshold:
                key = (min(i, j), max(i, j))
                out[key] = max(out.get(key, 0), round(x, 6))
    return out


def shown(df):
    return {(r.doc_a, r.doc_b): r.jaccard for r in df.collect()}


def brute_links(rows, threshold=0.5):
    """{doc_id: (class_id, links)} from all pairs."""
    ids = {i for i, _ in rows if i is not None}
    near, root = {i: set() for i in ids}, {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in brute(rows, threshold):
        near[a].add(b), near[b].add(a)
        x, y = sorted((top(a), top(b)))
        root[y] = x
    return {i: (top(i), len(near[i])) for i in ids}


def classes(df):
    rows = df.collect()
    assert df.columns == ["doc_id", "class_id", "links"] and len({r.doc_id for r in rows}) == len(rows)
    return {r.doc_id: (r.class_id, r.links) for r in rows}


def corpus(n=150, seed=0):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for i in range(n):
        if i and rng.random() < 0.6:
            base = rows[int(rng.integers(0, i))][1].split(" ")
            t = [w if rng.random() > rng.choice([0, 0.02, 0.05, 0.1, 0.3]) else str(rng.choice(words)) for w in base]
        else:
            t = [str(w) for w in rng.choice(words, int(rng.integers(20, 120)))]
        rows.append((i, " ".join(t)))
    return rows


def test_all_pairs(spark):
    rows = corpus()
    truth = brute(rows)
    got = shown(jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)))
    assert len(truth) > 50 and all(truth[k] == v for k, v in got.items()) and len(got) >= 0.97 * len(truth)


def test_table_against_sql(spark, sf):
    con = connect(sf)
    truth = {i: (c, n) for i, c, n in con.execute("SELECT doc_id, class_id, links FROM (" + jaccard.ORACLES["op9_jaccard"] + ")").fetchall()}
    got = classes(jaccard.op9_jaccard(spark, sf))
    assert got.keys() == truth.keys() and np.mean([got[k] == v for k, v in truth.items()]) >= 0.98


def near_copies(n=120):
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in range(80)]
    return [(i, " ".join(w if rng.random() > 0.01 else f"x{rng.integers(0, 999)}" for w in base)) for i in range(n)]


def test_blocks(spark, monkeypatch):
    """Components and runs of the tries in several blocks each."""
    rows = near_copies()
    rows += [(1000 + i, rows[i % 7][1]) for i in range(40)]
    whole = classes(jaccard.linked(spark.createDataFrame(rows, "doc_id long, text string")))
    assert whole == brute_links(rows)
    monkeypatch.setattr(jaccard, "BLOCK_GRAMS", 1000)
    monkeypatch.setattr(jaccard, "RUN", 8)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert classes(jaccard.linked(df)) == whole
    assert shown(jaccard.join(df)) == brute(rows)


def test_rows_stay_linear(spark):
    """A group of many near copies leaves the verifying tasks as counts and a forest, not as pairs."""
    rows = near_copies(300)
    j = jaccard.Join(spark.createDataFrame(rows, "doc_id long, text string"))
    assert j.found.where("kind = 2").count() == 0 and j.found.count() <= 2 * 300


def test_several_sets_of_one_id(spark):
    """Versions of an id link it to the partners of each, once, and their other members to nothing else."""
    a, b, c = "a b c d e f g h", "p q r s t u v w", "k l m n o k k l"
    rows = [(1, a), (1, b), (2, a), (3, b), (4, b + " x"), (4, a + " x"), (5, c), (6, c), (7, b), (7, b), (8, a + " y"), (8, c + " z")]
    assert classes(jaccard.linked(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))) == brute_links(rows)


def test_recall_at_a_low_threshold(spark):
    """Prefixes go shorter where the target takes it; a target out of reach is an error."""
    rng = np.random.default_rng(2)
    rows, words = [], [f"w{i}" for i in range(5000)]
    for i in range(150):
        base = [str(w) for w in rng.choice(words, 60)]
        keep = rng.integers(18, 30)
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(base[:keep] + [str(w) for w in rng.choice(words, 60 - keep)]))]
    truth = brute(rows, 0.25)
    got = shown(jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"), threshold=0.25))
    assert len(truth) > 50 and all(truth[k] == v for k, v in got.items()) and len(got) >= 0.98 * len(truth)
    with pytest.raises(ValueError):
        jaccard.floor_depth(0.02, 0.98)
    assert jaccard.floor_depth(0.5, 0.98) == 3 and jaccard.chosen_depth([(6, 0.95)], 0.5, 0.98, 3) > 3
    assert jaccard.chosen_depth([(6, 0.95)] * 1000 + [(4, 0.52)], 0.5, 0.98, 3) == 3


def test_long_runs_join_as_all_pairs(monkeypatch):
    """Spanning forests of long runs have, down to any depth, the components of all agreeing pairs."""
    rng = np.random.default_rng(6)
    n = 200
    proto = rng.integers(0, 1 << 63, (5, 4)).astype(np.uint64)
    flip = (rng.random((n, 256)) < 0.06).astype(np.uint8)
    sketch = proto[rng.integers(0, 5, n)] ^ np.packbits(flip, axis=1).view(np.uint64)
    key = np.where(rng.random((n, 6)) < 0.5, 0, 1) @ (1 << (10 * np.arange(5, -1, -1)))
    tree, part, node = np.repeat([0, 1], n // 2), np.zeros(n, np.int64), np.arange(n)
    got = jaccard.candidates(tree, part, key, node, sketch, 0.6, 1)
    assert len(got[0]) < 16 * n
    for depth in range(1, 7):
        i, j = np.triu_indices(n, 1)
        ok = (tree[i] == tree[j]) & (jaccard._depth(key[i] ^ key[j]) >= depth) & (jaccard._similar(sketch[i], sketch[j]) >= 0.6)
        mine = got[2] >= depth
        assert np.array_equal(jaccard._roots(n, got[0][mine], got[1][mine]), jaccard._roots(n, i[ok], j[ok]))


def test_groups(spark):
    rows = [(5, "a b c d e f"), (3, "a b c d e f"), (9, "A b, c d e f!"), (1, "z y x w"), (2, "lone words here now"), (4, "z y x w")]
    got = {r.doc_id: r.first for r in jaccard.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {5: 3, 3: 3, 9: 3, 1: 1, 4: 1, 2: 2}


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "..."), (4, "one"), (5, "One"), (6, "two words"), (7, "two words"), (7, "two words"), (8, "x y z " * 50_000), (9, "x y z " * 50_000 + "q"), (None, "one"), (10, "one"), (10, "two words")]
    df = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, jaccard string")
    got = shown(jaccard.join(df))
    assert got == brute(rows) and got[(4, 5)] == 1.0 and got[(6, 10)] == 1.0 and (8, 9) in got
    assert classes(jaccard.linked(df)) == brute_links(rows)
    assert jaccard.join(df.limit(0)).count() == 0 and jaccard.groups(df.limit(0)).count() == 0 and jaccard.linked(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 7])
def test_components(spark, n):
    edges = [(10 * c + i, 10 * c + i + 1) for c in range(n) for i in range(9 if c else 5)]
    got = {r.node: r.comp for r in jaccard.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}
    for a, b in edges:
        parent.setdefault(a, a), parent.setdefault(b, b)
        parent[b] = parent[a]
    assert got == {k: v for k, v in parent.items()}
