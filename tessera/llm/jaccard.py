"""Operator 9: n-gram Jaccard join by a MinHash LSH forest with exact verification.

A document is its set of word 3-grams (lower case; letters and numbers). Documents of one and the same set are one node.
Each node has 256 MinHash values; 192 of them label its leaf in 32 prefix tries of six levels (ten bits a level), kept as
sorted 60-bit keys. Pairs that share a trie's prefix are candidates. Matching begins at full prefixes and is shortened level by
level; edges are kept down to the level that finds every band of similarity (0.05 wide) that holds an edge with the target
recall, and the shortest level looked at is the one that finds pairs at the threshold itself with it; a target that one level
can't reach is an error. One bit of each MinHash value makes a 256-bit sketch that travels along, so that prefixes
shared by chance go at once. What is left is joined to components, and within a component every pair is verified over the
whole sets of n-grams, so that no partner or candidate is cut off.

A group of near copies has as many pairs as the square of its size, so pairs stay in the task that verifies them: what leaves it
is the number of linked documents for each node and the edges of a spanning forest. Long runs of a trie and large
components are parted into blocks that meet two by two.

Shuffles: the signatures once by set, the trie rows (64 bytes, 32 a node) once by prefix, texts once to meet their component,
and those of components with several nodes once more to meet each other. Only lists of long runs, by their number, are broadcast.

Defined results: rows without an id have no result; an id without a text or a word is its own class and has no link; texts of
one or two words are one n-gram; rows that share an id are one document with several versions, linked to whatever one of them is
linked to, and not to itself; empty tables give no rows; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .textops import U64, Texts, chunks, mix64, words, written

N, THRESHOLD, TARGET = 3, 0.5, 0.98
TREES, LEVELS, BITS = 32, 6, 10
HASHES = 256
#: A candidate's sketch must give the threshold less so many standard deviations; the share of pairs at the threshold that it loses.
DEVIATIONS, SKETCH_LOSS = 4.5, 4e-6
#: N-grams of one block of a component; rows of one block of a long run; long runs that may be sent to all tasks.
BLOCK_GRAMS, RUN, MAX_HOT = 1 << 20, 1 << 15, 1 << 18

_rng = np.random.default_rng(20240717)
_A = _rng.integers(0, 1 << 32, HASHES, np.uint32) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, HASHES, np.uint32)
_MIX = [U64(int(x) | 1) for x in _rng.integers(1 << 40, 1 << 63, 8)]


def shingles(t: Texts, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): each document's distinct n-grams in sorted order."""
    h, _, _, at = words(t)
    count = np.diff(at)
    grams = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    doc = np.repeat(np.arange(len(t)), grams)
    first = np.repeat(at[:-1] - (np.cumsum(grams) - grams), grams) + np.arange(int(grams.sum()))
    g = np.zeros(len(first), U64)
    short = np.minimum(count, n)[doc]
    for k in range(n):
        ok = short > k
        g[ok] += h[first[ok] + k] * _MIX[k]
    g = mix64(g + short.astype(U64))
    order = np.argsort(g)
    d = doc[order]
    order = order[np.argsort(d.astype(np.uint16) if len(t) < 65536 else d, kind="stable")]
    g, doc = g[order], doc[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
    g, doc = g[new], doc[new]
    return g, np.searchsorted(doc, np.arange(len(t) + 1))


def set_hash(g: np.ndarray, start: np.ndarray, k: int = 5) -> np.ndarray:
    """A hash of each set; that of k = 5 is the name of its node."""
    return np.add.reduceat(mix64(g ^ _MIX[k]), start).view(np.int64) if len(start) else np.empty(0, np.int64)


def minhash(g: np.ndarray, off: np.ndarray) -> np.ndarray:
    """256 minima for each document that has an n-gram (rows of those that have none are absent)."""
    some = off[:-1][np.diff(off) > 0]
    x = (g >> U64(32)).astype(np.uint32)
    out = np.empty((len(some), HASHES), np.uint32)
    if not len(some):
        return out
    buf = np.empty_like(x)
    for k in range(HASHES):
        np.multiply(x, _A[k], out=buf)
        buf += _B[k]
        out[:, k] = np.minimum.reduceat(buf, some)
    return out


def labels(sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys of the tries, sketches of four 64-bit words)."""
    v = (sig * np.uint32(2654435761)) >> np.uint32(32 - BITS)
    keys = np.zeros((len(sig), TREES), np.int64)
    for level in range(LEVELS):
        keys = (keys << BITS) | v[:, level * TREES : (level + 1) * TREES].astype(np.int64)
    bits = ((sig * np.uint32(0x85EBCA6B)) >> np.uint32(31)).astype(np.uint8)
    return keys, np.packbits(bits, axis=1).view(np.uint64).view(np.int64)


def signatures(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, h1, h2, n, keys, sketch) of the documents that have an id and a word; h1, h2, n stand for the set."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for a, b, t in chunks(batch.column(1)):
                g, off = shingles(t)
                n = np.diff(off)
                has = np.flatnonzero(n > 0)
                if not len(has):
                    continue
                start = off[:-1][has]
                h1, h2 = (set_hash(g, start, k) for k in (5, 6))
                keys, sketch = labels(minhash(g, off))
                two = [pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), x.shape[1]).cast(pa.list_(pa.int64())) for x in (keys, sketch)]
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a).take(pa.array(has)), pa.array(h1), pa.array(h2), pa.array(n[has].astype(np.int32)), *two], names=["doc_id", "h1", "h2", "n", "keys", "sketch"])

    source = docs.select(F.col("doc_id").cast("long"), F.col(text)).where(F.col("doc_id").isNotNull() & F.col(text).isNotNull())
    return source.mapInArrow(run, "doc_id long, h1 long, h2 long, n int, keys array<long>, sketch array<long>")


def _similar(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity that two sketches give."""
    return 1 - np.bitwise_count(a ^ b).sum(-1, dtype=np.int64) / (HASHES / 2)


def seen(j, depth: int):
    """Probability that a pair of similarity j meets under a prefix of ``depth`` levels in one of the tries, and that its sketch
    passes."""
    j = np.asarray(j, float)
    return (1 - (1 - j**depth) ** TREES) * (1 - SKETCH_LOSS)


def floor_depth(threshold: float, target: float) -> int:
    """The deepest prefix under which pairs at the threshold itself are found with the target recall."""
    for depth in range(LEVELS, 0, -1):
        if seen(threshold, depth) >= target:
            return depth
    raise ValueError(f"{TREES} tries don't find pairs of similarity {threshold} with recall {target}")


def least_sketch(threshold: float) -> float:
    """Similarity that a candidate's sketch must give."""
    return threshold - DEVIATIONS * np.sqrt((1 - threshold**2) / HASHES)


def _depth(x: np.ndarray) -> np.ndarray:
    """Levels that two keys share, from their differing bits."""
    level = np.full(len(x), LEVELS, np.int32)
    some = x > 0
    level[some] = (BITS * LEVELS - 1 - np.floor(np.log2(x[some].astype(np.float64))).astype(np.int32)) // BITS
    return level


def candidates(tree: np.ndarray, part: np.ndarray, key: np.ndarray, node: np.ndarray, sketch: np.ndarray, least: float, floor: int):
    """(node, node, depth, similarity by sketch) of rows under one prefix of ``floor`` levels whose sketches agree. Prefixes are
    shortened level by level; what a longer one has joined isn't compared again. Runs of more than 16 rows give a spanning
    forest at every level in place of all pairs, so there are at most 15 edges a row, and the same components."""
    order = np.lexsort((node, key, part, tree))
    tree, part, key, node, sketch = tree[order], part[order], key[order], node[order], sketch[order]

    def breaks(top: np.ndarray, i: int = 0, j: int | None = None) -> np.ndarray:
        new = np.ones(len(top), bool)
        new[1:] = (top[1:] != top[:-1]) | (tree[i:j][1:] != tree[i:j][:-1]) | (part[i:j][1:] != part[i:j][:-1])
        return np.flatnonzero(new)

    start = breaks(key >> (BITS * (LEVELS - floor)))
    size = np.diff(np.append(start, len(key)))
    run = np.repeat(np.arange(len(start)), size)
    small = size <= 16
    out = []
    rows = np.flatnonzero(small[run] & (size[run] > 1))
    k = 1
    while len(rows):
        i = rows[rows + k < len(key)]
        i = i[run[i + k] == run[i]]
        if not len(i):
            break
        s = _similar(sketch[i], sketch[i + k])
        ok = s >= least
        out.append((node[i[ok]], node[i[ok] + k], _depth(key[i[ok]] ^ key[i[ok] + k]), s[ok]))
        rows, k = i, k + 1
    for r in np.flatnonzero(~small):
        i, j = start[r], start[r] + size[r]
        own, near, name = key[i:j], sketch[i:j], node[i:j]
        cluster = np.arange(j - i)
        for depth in range(LEVELS, floor - 1, -1):
            first = breaks(own >> (BITS * (LEVELS - depth)), i, j)
            for a, b in zip(first.tolist(), [*first[1:].tolist(), j - i], strict=True):
                left = np.arange(a, b)
                while len(left) and (cluster[left] != cluster[left[0]]).any():
                    inside = cluster[left] == cluster[left[0]]
                    front, left = left[inside].tolist(), left[~inside]
                    c = cluster[front[0]]
                    while front and len(left):
                        v = front.pop()
                        s = _similar(near[left], near[v])
                        hit = s >= least
                        if hit.any():
                            met, at = np.unique(cluster[left[hit]], return_index=True)
                            to = left[hit][at]  # one edge to each cluster that v meets
                            out.append((np.full(len(to), name[v]), name[to], np.full(len(to), depth, np.int32), s[hit][at]))
                            joins = np.isin(cluster[left], met)
                            front.extend(left[joins].tolist())
                            cluster[left[joins]] = c
                            left = left[~joins]
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def chosen_depth(found: list[tuple[int, float]], threshold: float, target: float, floor: int) -> int:
    """The deepest prefix that finds the pairs of every band of similarity (0.05 wide) that holds an edge with the target
    recall. ``found`` has (depth, similarity) of the edges, or of those of each depth and band."""
    bands = {int((s - threshold) / 0.05) for _, s in found if s >= threshold}
    low = [threshold + 0.05 * b for b in bands]
    return next((d for d in range(LEVELS, floor, -1) if all(seen(j, d) >= target for j in low)), floor)


def forest(nodes: DataFrame, threshold: float = THRESHOLD, target: float = TARGET) -> DataFrame:
    """Candidate edges (a, b) of (node, keys, sketch) at the depth that the target recall takes."""
    floor, least = floor_depth(threshold, target), float(least_sketch(threshold))

    def run(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        sketch = np.stack([np.asarray(t.column(f"s{i}"), np.int64) for i in range(4)], 1).view(np.uint64)
        a, b, depth, s = candidates(*(np.asarray(t.column(c), np.int64) for c in ("tree", "part", "key", "node")), sketch, least, floor)
        ok = a != b
        a, b, depth, s = a[ok], b[ok], depth[ok], s[ok]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(depth.astype(np.int32)), pa.array(s)], names=["a", "b", "depth", "s"])

    rows = nodes.select("node", *(F.col("sketch")[i].alias(f"s{i}") for i in range(4)), F.posexplode("keys").alias("tree", "key"))
    rows = rows.withColumn("tree", F.col("tree").cast("long")).withColumn("prefix", F.shiftright("key", BITS * (LEVELS - floor)))
    hot = written(rows.groupBy("tree", "prefix").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > RUN).select("tree", "prefix", F.ceil(F.col("c") / RUN).cast("long").alias("blocks")))
    many = hot.count()
    if many:  # long runs: blocks of them meet in tasks of their own
        rows = rows.join(F.broadcast(hot) if many <= MAX_HOT else hot, ["tree", "prefix"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
        rows = rows.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        rows = rows.withColumn("part", F.least("mine", "other") * F.col("blocks") + F.greatest("mine", "other"))
    else:
        rows = rows.withColumn("part", F.lit(0).cast("long"))
    rows = rows.select("node", "s0", "s1", "s2", "s3", "tree", "part", "key", "prefix").repartition("tree", "prefix", "part")
    found = written(rows.select("node", "s0", "s1", "s2", "s3", "tree", "part", "key").mapInArrow(run, "a long, b long, depth int, s double"))
    bands = found.where(F.col("s") >= threshold).select("depth", F.floor((F.col("s") - threshold) / 0.05).alias("band")).distinct().collect()
    depth = chosen_depth([(r.depth, threshold + 0.05 * r.band + 1e-9) for r in bands], threshold, target, floor)
    return found.where(F.col("depth") >= depth).select("a", "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): the least node of each node's component, by alternating large-star and small-star steps; minima are
    aggregated before they move, and what is kept between steps lies in the shared folder."""
    e = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    state = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("m"))
        e = both.where("b > a").join(low, "a").select(F.col("m").alias("a"), "b").distinct()
        # now each node hangs on the least of a neighbourhood; each node's parents are joined under the least of them
        e = e.join(e.groupBy("b").agg(F.min("a").alias("m")), "b")
        e = e.select("m", "b").unionByName(e.select("m", F.col("a").alias("b"))).where("m <> b").select(F.col("m").alias("a"), "b").distinct()
        e = written(e)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 1_000_000_007)).first()
        if now == state:
            break
        state = now
    return e.select(F.col("b").alias("node"), F.col("a").alias("comp")).unionByName(e.select(F.col("a").alias("node"), F.col("a").alias("comp")).distinct())


def verify(sets: list[np.ndarray], side: np.ndarray, cross: bool, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, Jaccard) of all pairs of sets, or of those across two sides, that reach the threshold."""
    size = np.array([len(s) for s in sets])
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    off = np.cumsum(size) - size
    flag = np.zeros(int(ids.max()) + 1, bool)
    a, b, j = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
    for i in range(len(sets) - 1):
        mine = ids[off[i] : off[i] + size[i]]
        flag[mine] = True
        both = np.add.reduceat(flag[ids[off[i + 1] :]], off[i + 1 :] - off[i + 1], dtype=np.int64)
        flag[mine] = False
        x = both / (size[i] + size[i + 1 :] - both)
        hit = x >= threshold
        if cross:
            hit &= side[i + 1 :] != side[i]
        to = np.flatnonzero(hit)
        if len(to):
            a.append(np.full(len(to), i))
            b.append(to + i + 1)
            j.append(x[to])
    return np.concatenate(a), np.concatenate(b), np.concatenate(j)


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The first member of each one's component."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, i, root[j])
        np.minimum.at(low, j, root[i])
        low = low[low]
        if (low == root).all():
            return root
        root = low


def verified(docs: DataFrame, comps: DataFrame, stats: DataFrame, threshold: float = THRESHOLD, text: str = "text", pairs: bool = False) -> DataFrame:
    """What exact verification of all pairs of nodes within a component finds, in rows (kind, a, b, x): 0, b documents are linked to
    node a; 1, an edge of the spanning forest; 2, a pair with its Jaccard, of nodes with ``listed`` members or of all where
    ``pairs`` is true. ``stats``: (node, rep, n, w, listed): an id that has the node's text, its n-grams, the documents that b
    counts."""
    c = comps.join(stats, "node")
    size = c.groupBy("comp").agg(F.ceil(F.sum("n") / BLOCK_GRAMS).cast("int").alias("blocks"))
    c = c.join(size, "comp").select("node", "rep", "comp", "blocks", "w", "listed")
    d = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col(text).alias("t")).where(F.col("t").isNotNull()).join(c.hint("shuffle_hash"), "rep")
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    d = d.withColumn("mine", mine).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    d = d.select("comp", F.least("mine", "j").alias("lo"), F.greatest("mine", "j").alias("hi"), "mine", "node", "w", "listed", "t")
    d = d.repartition("comp", "lo", "hi").sortWithinPartitions("comp", "lo", "hi", "node")
    names = ["kind", "a", "b", "x"]

    def group(rows):
        cross = rows[0][0][1] != rows[0][0][2]
        i, j, x = verify([r[5] for r in rows], np.array([r[1] for r in rows]), cross, threshold)
        node, w, listed = np.array([r[2] for r in rows]), np.array([r[3] for r in rows], np.int64), np.array([r[4] for r in rows])
        some = listed[i] | listed[j] | pairs
        yield 2, node[i[some]], node[j[some]], x[some]  # rows are sorted by node
        root = _roots(len(rows), i, j)
        ok = root != np.arange(len(rows))
        yield 1, node[root[ok]], node[ok], np.ones(int(ok.sum()))
        count = np.zeros(len(rows), np.int64)
        np.add.at(count, i, w[j])
        np.add.at(count, j, w[i])
        ok = count > 0
        yield 0, node[ok], count[ok], np.zeros(int(ok.sum()))

    def out(found):
        if found:
            kinds = np.repeat([f[0] for f in found], [len(f[1]) for f in found]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(kinds), *(pa.array(np.concatenate([f[i] for f in found])) for i in (1, 2, 3))], names=names)

    def run(batches):
        held: list[tuple] = []  # rows of the group that may go on in the next batch
        for batch in batches:
            key = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
            mine, node, w, listed = (batch.column(i).to_pylist() for i in range(3, 7))
            found = []
            for a, b, t in chunks(batch.column(7)):
                g, off = shingles(t)
                for i in range(a, b):
                    if held and held[0][0] != key[i]:
                        if len(held) > 1:
                            found.extend(group(held))
                        held = []
                    s = g[off[i - a] : off[i - a + 1]]
                    # An id may have other texts than the node's, and the node's in several rows.
                    if len(s) and not (held and held[-1][2] == node[i]) and set_hash(s, np.zeros(1, np.int64))[0] == node[i]:
                        held.append((key[i], mine[i], node[i], w[i], listed[i], s.copy()))
            yield from out(found)
        if len(held) > 1:
            yield from out(list(group(held)))

    return d.mapInArrow(run, "kind long, a long, b long, x double")


class Join:
    """The stages of a join over one table. A node is a set of n-grams, named by its hash; ``members`` holds (node, doc_id),
    ``several`` the ids that have several sets, ``found`` what verification found."""

    def __init__(self, docs: DataFrame, text: str = "text", threshold: float = THRESHOLD, target: float = TARGET, pairs: bool = False):
        sig = written(signatures(docs, text))
        nodes = sig.groupBy(F.col("h1").alias("node")).agg(F.first("keys").alias("keys"), F.first("sketch").alias("sketch"))
        self.members = written(sig.groupBy(F.col("h1").alias("node"), "doc_id").agg(F.max("n").alias("n")))
        self.several = written(self.members.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("doc_id"))
        one = self.members.join(self.several.withColumn("x", F.lit(True)), "doc_id", "left").groupBy("node")
        self.stats = one.agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.count_if(F.col("x").isNull()).alias("w"), F.coalesce(F.max("x"), F.lit(False)).alias("listed"))
        self.stats = written(self.stats)
        comps = components(forest(nodes, threshold, target))
        self.found = written(verified(docs, comps, self.stats, threshold, text, pairs))

    def pairs(self) -> DataFrame:
        """(a, b, jaccard): all of them where the join was made so, else those of listed nodes."""
        return self.found.where("kind = 2").select("a", "b", F.col("x").alias("jaccard"))

    def classes(self) -> DataFrame:
        """(doc_id, class_id) of the documents that have an n-gram: the least id of those linked to each other by pairs, by equal
        sets or by an id with several sets."""
        ids = self.members.join(self.several, "doc_id", "left_semi")
        ids = ids.join(ids.groupBy("doc_id").agg(F.min("node").alias("a")), "doc_id").select("a", F.col("node").alias("b"))
        comps = components(self.found.where("kind = 1").select("a", "b").unionByName(ids))
        m = self.members.select("node", "doc_id").join(comps, "node", "left").select("doc_id", F.coalesce("comp", "node").alias("comp"))
        least = m.groupBy("comp").agg(F.min("doc_id").alias("class_id"))
        return m.join(least, "comp").groupBy("doc_id").agg(F.min("class_id").alias("class_id"))

    def links(self) -> DataFrame:
        """(doc_id, links): how many other documents are linked to each that has an n-gram. Documents of one set are counted by
        their node; only ids with several sets are looked at one by one."""
        near = self.found.where("kind = 0").groupBy("a").agg(F.sum("b").alias("near"))
        node = self.stats.join(near, F.col("node") == F.col("a"), "left").select("node", (F.col("w") + F.coalesce("near", F.lit(0))).alias("around"))
        m = self.members.select("node", "doc_id")
        if self.several.isEmpty():
            return m.join(node, "node").select("doc_id", (F.col("around") - 1).alias("links"))
        p = self.pairs().select("a", "b")
        own = m.select(F.col("node").alias("a"), F.col("node").alias("b")).distinct()
        around = written(p.unionByName(p.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(own))
        multi = m.join(self.several, "doc_id", "left_semi")
        others = around.join(multi.select(F.col("node").alias("b"), F.col("doc_id").alias("y")), "b").groupBy("a").agg(F.countDistinct("y").alias("listed"))
        one = m.join(self.several, "doc_id", "left_anti").join(node, "node").join(others, F.col("node") == F.col("a"), "left")
        one = one.select("doc_id", (F.col("around") - 1 + F.coalesce("listed", F.lit(0))).alias("links"))
        reach = written(multi.join(around, F.col("node") == F.col("a")).select("doc_id", F.col("b").alias("node")).distinct())
        single = reach.join(self.stats, "node").groupBy("doc_id").agg(F.sum("w").alias("single"))
        listed = reach.join(multi.select("node", F.col("doc_id").alias("y")), "node").where("y <> doc_id").groupBy("doc_id").agg(F.countDistinct("y").alias("listed"))
        return one.unionByName(single.join(listed, "doc_id", "left").select("doc_id", (F.col("single") + F.coalesce("listed", F.lit(0))).alias("links")))


def linked(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD, target: float = TARGET) -> DataFrame:
    """(doc_id, class_id, links): one row for each id. class_id is the least id of the group of documents that pairs link, the id
    itself where there is none; links counts the documents whose similarity reaches the threshold, copies one by one."""
    j = Join(docs, text, threshold, target)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    out = ids.join(j.classes(), "doc_id", "left").join(j.links(), "doc_id", "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))


def join(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD, target: float = TARGET) -> DataFrame:
    """(doc_a, doc_b, jaccard): all pairs of documents that reach the threshold, doc_a < doc_b, copies expanded: for tables
    without large groups, or to be joined with a few ids."""
    j = Join(docs, text, threshold, target, pairs=True)
    m = j.members.select("node", "doc_id")
    a, b = m.select(F.col("node").alias("a"), F.col("doc_id").alias("x")), m.select(F.col("node").alias("b"), F.col("doc_id").alias("y"))
    twins = m.groupBy("node").count().where("count > 1").select(F.col("node").alias("a"), F.col("node").alias("b"), F.lit(1.0).alias("jaccard"))
    p = j.pairs().unionByName(twins).join(a, "a").join(b, "b").where("x <> y")
    p = p.select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"), F.round("jaccard", 6).alias("jaccard"))
    return p.groupBy("doc_a", "doc_b").agg(F.max("jaccard").alias("jaccard"))


def groups(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD, target: float = TARGET) -> DataFrame:
    """(doc_id, first): documents that are linked by pairs of the join, with the least id of their group. It is linear in
    the documents of a group: sets' members hang on their node, and nodes on the forest of their pairs."""
    return Join(docs, text, threshold, target).classes().withColumnRenamed("class_id", "first")


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of each document, and how many others have word 3-grams of a Jaccard similarity of 0.5 at least."""
    return linked(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op9_jaccard": op9_jaccard}
ORACLES = {
    "op9_jaccard": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g
  FROM w WHERE len(w) > 0
), n AS (SELECT doc_id, count(*) AS c FROM s GROUP BY doc_id
), p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE i / (nx.c + ny.c - i)::double >= 0.5
), d AS (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL
), r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x
)
SELECT d.doc_id, (SELECT min(y) FROM r WHERE r.x = d.doc_id) AS class_id, (SELECT count(*) FROM e WHERE e.x = d.doc_id) AS links FROM d
"""
}
