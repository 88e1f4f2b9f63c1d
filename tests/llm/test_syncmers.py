import numpy as np

from tessera.llm import syncmers
from tessera.llm.textops import chunks


def brute(text, k, s):
    t = "".join(" " if c.isspace() else c.lower() if len(c.lower()) == 1 else c for c in text)
    h = {}

    def of(x):
        if x not in h:
            tx = next(chunks([x]))[2]
            p = syncmers.prefix_hash(syncmers._symbols()[tx.cps])
            h[x] = int(syncmers.slice_hash(p, np.array([0]), np.array([len(x)]))[0])
        return h[x]

    if 0 < len(t) < k:
        return [0]
    out = []
    for i in range(len(t) - k + 1):
        inner = [of(t[i + j : i + j + s]) for j in range(k - s + 1)]
        if min(inner) in (inner[0], inner[-1]):
            out.append(i)
    return out


def test_like_brute_force(spark):
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("abC dé\n"), int(n))) for n in rng.integers(0, 120, 40)] + ["a" * 50, "ab" * 30, "", "x"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(3)
    got = {r.doc_id: r.positions for r in syncmers.fingerprint(df, k=12, s=4).collect()}
    assert got == {i: brute(t, 12, 4) for i, t in enumerate(texts)}


def test_anchors_are_free_of_context(spark):
    rng = np.random.default_rng(2)
    word = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(n))
    shared, a, b = word(60), word(30), word(17)
    df = spark.createDataFrame([(1, a + " " + shared + " " + word(20)), (2, b + "\n" + shared.upper().replace(" ", "\t")), (3, word(100))], "doc_id long, text string")
    f = syncmers.fingerprint(df)
    hits = syncmers.shared(f.where("doc_id = 1"), f.where("doc_id <> 1")).collect()
    assert {(r.id_a, r.id_b) for r in hits} == {(1, 2)}
    best = max(hits, key=lambda r: r.n)
    assert best.shift == len(b) - len(a) and best.from_a <= len(a) + 64 + 48 and best.to_a >= len(a) + len(shared) - 64 - 48


def test_passages_of_the_benchmark(spark):
    """Every benchmark text that stands in a document whole shares anchors with it at one distance."""
    sf = "/root/testdata/sf0.01"
    docs, items = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/benchmark.parquet")
    f = syncmers.fingerprint(docs)
    got = {(r.id_a, r.id_b) for r in syncmers.shared(f, syncmers.fingerprint(items.selectExpr("item_id AS doc_id", "text"))).where("n >= 2").collect()}
    fold = lambda t: "".join(" " if c.isspace() else c.lower() for c in t)
    texts = [(r.doc_id, fold(r.text)) for r in docs.collect() if r.text]
    whole = {(i, r.item_id) for r in items.collect() for i, t in texts if fold(r.text) in t}
    assert whole and whole <= got


def test_density():
    rng = np.random.default_rng(3)
    t = next(chunks(["".join(rng.choice(list("abcdefghijkl"), 200_000))]))[2]
    n = len(syncmers.anchors(t)[0])
    assert abs(n / 200_000 - 2 / (syncmers.K - syncmers.S + 1)) < 0.005


def test_edges(spark):
    df = spark.createDataFrame([(1, None, "k"), (2, "", "k"), (3, "short", "k"), (3, "short", "k"), (4, "ab " * 100_000, "k")], "doc_id long, text string, anchors string")
    out = syncmers.fingerprint(df)
    assert out.columns == ["doc_id", "positions", "anchors"]
    got = {r.doc_id: r for r in out.collect()}
    assert got[1].anchors is None and got[2].anchors == [] and got[3].positions == [0] and len(got[4].anchors) == len(got[4].positions) > 0
    assert syncmers.fingerprint(df.limit(0)).count() == 0
