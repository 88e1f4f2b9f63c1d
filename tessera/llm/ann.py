"""Operator 7: approximate nearest neighbours by a hierarchical k-means tree with best-bin-first traversal.

The upper part of the tree is fitted over all vectors, level by level: each pass assigns every vector to its cell in the
tasks and sums up the cells there, so that only sums and counts of centroids move. Cells at that part's end are shards of
about ``SHARD_ROWS`` vectors; a shard is one task's data, which splits it further down to leaves, once; trees and leaves are kept
in a table. A query goes to the shards that a traversal of the upper tree reaches first, and in each to the leaves that a priority
queue of centroid distances gives next. Every vector is indexed and searched; which of them are queries is a parameter, and
the registered query takes those whose id 100 divides.

How many shards and leaves are visited is calibrated: sampled queries are searched exhaustively over all vectors, the turn
at which each true neighbour's shard and leaf would be visited is noted, and visits are widened until the target
recall (0.94 by default) is reached. Distances are exact, Euclidean or cosine.

Shuffles: vectors once to their shard, queries once to each shard that they visit, k results of each visit to their query. The
upper tree (a centroid for each SHARD_ROWS vectors) is what tasks get; its size is checked against ``MAX_TREE`` and the
shards grow where it would be larger.

Defined results: vectors that are null, of another length than ``dim`` (by default the most frequent length), or hold a
null, a NaN or an infinity are no queries and no neighbours; rows without an id neither; of rows that share an id the
least vector counts; a vector isn't its own neighbour, equal vectors of other ids are; equal distances rank by id; with fewer
than k others all of them are neighbours; a zero vector has cosine distance 0.5 to all but zero
vectors. Other columns aren't looked at.
"""

from __future__ import annotations

import heapq
import pickle
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .textops import U64, mix64, written

NEIGHBOURS, TARGET = 10, 0.94
BRANCH, SHARD_ROWS, LEAF_ROWS = 16, 16384, 64
SAMPLE_QUERIES, LLOYD = 512, 4
MAX_TREE = 64 << 20
#: Nodes of a tree whose queues are kept as a matrix.
MATRIX_NODES = 4096


def _matrix(column) -> np.ndarray:
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = np.asarray(a.flatten(), np.float32)
    return flat.reshape(len(a), -1) if len(a) else np.empty((0, 0), np.float32)


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances of rows to rows."""
    x, c = x.astype(np.float32), c.astype(np.float32)
    d = (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None, :]
    return np.maximum(d, 0)


def seed_centres(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means++ over distinct rows."""
    x = np.unique(x, axis=0)
    if len(x) <= k:
        return x
    out = [x[rng.integers(len(x))]]
    d = _distances(x, out[0][None, :])[:, 0]
    while len(out) < k and d.sum() > 0:
        out.append(x[rng.choice(len(x), p=d / d.sum())])
        d = np.minimum(d, _distances(x, out[-1][None, :])[:, 0])
    return np.array(out)


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, steps: int = LLOYD) -> tuple[np.ndarray, np.ndarray]:
    """(centres, assignment); centres without a row are left out."""
    c = seed_centres(x, k, rng).astype(np.float64)
    for _ in range(steps):
        a = _distances(x, c).argmin(1)
        n = np.bincount(a, minlength=len(c))
        for j in np.flatnonzero(n):
            c[j] = x[a == j].mean(0)
    a = _distances(x, c).argmin(1)
    used, a = np.unique(a, return_inverse=True)
    return c[used], a


class Tree:
    """Nodes with the centres of their children; a leaf has none. Node 0 is the root."""

    def __init__(self):
        self.children: list[np.ndarray | None] = [None]
        self.centres: list[np.ndarray | None] = [None]

    def split(self, node: int, centres: np.ndarray) -> np.ndarray:
        new = np.arange(len(self.children), len(self.children) + len(centres))
        self.children += [None] * len(centres)
        self.centres += [None] * len(centres)
        self.children[node], self.centres[node] = new, centres.astype(np.float32)
        return new

    def leaves(self) -> list[int]:
        return [i for i, c in enumerate(self.children) if c is None]

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row, by greedy descent."""
        at = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if self.children[node] is None or not len(rows):
                at[rows] = node
                continue
            best = _distances(x[rows], self.centres[node]).argmin(1)
            for j, child in enumerate(self.children[node]):
                todo.append((child, rows[best == j]))
        return at

    def visit(self, q: np.ndarray):
        """Leaves in best-bin-first order: descend to the nearest child, and go on with the nearest cell put aside."""
        heap, turn = [(0.0, 0, 0)], 1
        while heap:
            node = heapq.heappop(heap)[2]
            while self.children[node] is not None:
                d = self.centres[node] - q
                d = np.einsum("ij,ij->i", d, d)
                best = int(d.argmin())
                for j, child in enumerate(self.children[node]):
                    if j != best:
                        heapq.heappush(heap, (float(d[j]), turn, int(child)))
                        turn += 1
                node = int(self.children[node][best])
            yield node


class Frontier:
    """Best-bin-first for many queries at once: a priority queue for each query is a row of a matrix, with a column for each node
    of the tree; all queries take their nearest cell in the same step. For trees of some hundred nodes."""

    def __init__(self, tree: Tree):
        n = len(tree.children)
        dim = next((c.shape[1] for c in tree.centres if c is not None), 0)
        self.own = np.zeros((n, dim), np.float32)
        widest = max((len(c) for c in tree.children if c is not None), default=1)
        self.child = np.full((n, widest), n)  # column n stands for no child
        self.leaf = np.array([c is None for c in tree.children])
        for node, c in enumerate(tree.children):
            if c is not None:
                self.child[node, : len(c)] = c
                self.own[c] = tree.centres[node]

    def visits(self, q: np.ndarray, limit: int) -> np.ndarray:
        """(queries, limit) leaves in the order of their visits, -1 after the last."""
        n, rows = len(self.leaf), np.arange(len(q))
        out = np.full((len(q), min(limit, int(self.leaf.sum()))), -1)
        if n == 1:
            out[:] = 0
            return out
        far = np.concatenate((_distances(q, self.own), np.full((len(q), 1), np.inf, np.float32)), 1)
        queue = np.full((len(q), n + 1), np.inf, np.float32)
        queue[:, 0] = 0
        for step in range(out.shape[1]):
            at = queue.argmin(1)
            queue[rows, at] = np.inf
            todo = rows[~self.leaf[at]]
            while len(todo):
                c = self.child[at[todo]]
                d = far[todo[:, None], c]
                queue[todo[:, None], c] = d
                best = c[np.arange(len(todo)), d.argmin(1)]
                queue[todo, best] = np.inf
                at[todo] = best
                todo = todo[~self.leaf[best]]
            out[:, step] = at
        return out


def local_tree(x: np.ndarray, seed: int) -> tuple[Tree, dict[int, np.ndarray]]:
    """A tree over the rows with leaves of LEAF_ROWS at most (more only where rows are equal), and the leaves' rows."""
    tree, rng, rows = Tree(), np.random.default_rng(seed), {}
    todo = [(0, np.arange(len(x)))]
    while todo:
        node, r = todo.pop()
        if len(r) <= LEAF_ROWS:
            rows[node] = r
            continue
        c, a = kmeans(x[r], min(BRANCH, -(-len(r) // LEAF_ROWS) + 1), rng)
        if len(c) < 2:
            rows[node] = r
            continue
        for j, child in enumerate(tree.split(node, c)):
            todo.append((int(child), r[a == j]))
    return tree, rows


def prepared(vectors: DataFrame, id_: str, vec: str, dim: int | None, metric: str) -> tuple[DataFrame, int]:
    """(id, v array<float>) of the vectors that can be searched, and their length."""
    v = vectors.select(F.col(id_).cast("long").alias("id"), F.col(vec).cast("array<float>").alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    if dim is None:
        top = v.groupBy(F.size("v").alias("d")).count().where("d > 0").orderBy(F.desc("count"), "d").first()
        dim = int(top["d"]) if top else 0
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = v.where((F.size("v") == dim) & ~F.coalesce(bad, F.lit(True))).groupBy("id").agg(F.min("v").alias("v"))
    if metric == "cosine":
        norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
        v = v.select("id", F.when(norm > 0, F.transform("v", lambda x: (x / norm).cast("float"))).otherwise(F.col("v")).alias("v"))
    elif metric != "euclidean":
        raise ValueError(f"no metric {metric!r}")
    return written(v), dim


def upper_tree(v: DataFrame, n: int, dim: int, shard_rows: int = SHARD_ROWS) -> Tree:
    """The tree whose leaves are shards, fitted over all vectors."""
    shard_rows = max(shard_rows, -(-n * dim * 4 // MAX_TREE))
    tree, counts = Tree(), {0: n}
    spark = v.sparkSession
    while True:
        wide = {node: min(BRANCH, -(-c // shard_rows)) for node, c in counts.items() if c > shard_rows}
        if not wide:
            return tree
        # Rows of each wide cell, chosen by hash, give the first centres.
        shared = spark.sparkContext.broadcast(tree)
        each = 8 * BRANCH

        def draw(batches):
            best: dict[int, list[tuple[int, int, list]]] = {}
            for b in batches:
                if not b.num_rows:
                    continue
                ids, x = np.asarray(b.column(0), np.int64), _matrix(b.column(1))
                h = (mix64(ids.view(U64) + U64(99)) >> U64(1)).view(np.int64)
                at = shared.value.assign(x)
                for node in np.unique(at):
                    if int(node) in wide:
                        r = np.flatnonzero(at == node)
                        r = r[np.argsort(h[r], kind="stable")[:each]]
                        best[int(node)] = sorted(best.get(int(node), []) + [(int(h[i]), int(ids[i]), x[i].tolist()) for i in r])[:each]
            out = [(k, *r) for k, rows in best.items() for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.float32())))], names=["node", "h", "id", "v"])

        w = Window.partitionBy("node").orderBy("h", "id")
        rows = v.mapInArrow(draw, "node long, h long, id long, v array<float>").withColumn("r", F.row_number().over(w)).where(F.col("r") <= each).select("node", "v").orderBy("node", "r").collect()
        split: dict[int, np.ndarray] = {}
        for node in wide:
            x = np.array([r.v for r in rows if r.node == node], np.float32)
            split[node] = seed_centres(x, wide[node], np.random.default_rng(node))
        wide = {k: c for k, c in split.items() if len(c) > 1}
        if not wide:
            return tree
        new: dict[int, int] = {}
        for turn in range(LLOYD + 1):
            centres = spark.sparkContext.broadcast(split)
            last = turn == LLOYD

            def add(batches):
                sums: dict[tuple[int, int], np.ndarray] = {}
                for b in batches:
                    if not b.num_rows:
                        continue
                    x = _matrix(b.column(1))
                    at = shared.value.assign(x)
                    for node in np.unique(at):
                        if int(node) not in wide:
                            continue
                        y = x[at == node]
                        a = _distances(y, centres.value[int(node)]).argmin(1)
                        for j in np.unique(a):
                            s = np.concatenate(([float((a == j).sum())], y[a == j].sum(0, dtype=np.float64)))
                            key = (int(node), int(j))
                            sums[key] = sums[key] + s if key in sums else s
                keys = sorted(sums)
                cols = np.array([sums[k] for k in keys]).reshape(len(keys), dim + 1)
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), *(pa.array(cols[:, i]) for i in range(dim + 1))], names=["node", "j", *(f"s{i}" for i in range(dim + 1))])

            kinds = "node long, j long, " + ", ".join(f"s{i} double" for i in range(dim + 1))
            got = v.mapInArrow(add, kinds).groupBy("node", "j").agg(*(F.sum(f"s{i}").alias(f"s{i}") for i in range(dim + 1))).collect()
            total: dict[tuple[int, int], np.ndarray] = {(r.node, r.j): np.array(r[2:], float) for r in got}
            if last:
                for node in sorted(wide):
                    keep = [j for j in range(len(split[node])) if (node, j) in total]
                    for child, j in zip(tree.split(node, split[node][keep]), keep, strict=True):
                        new[int(child)] = int(total[(node, j)][0])
            else:
                split = {k: np.array([total[(k, j)][1:] / total[(k, j)][0] if (k, j) in total else c[j] for j in range(len(c))]) for k, c in split.items() if k in wide}
        counts = {k: c for k, c in counts.items() if k not in wide and c <= shard_rows} | new


def _top(q: np.ndarray, x: np.ndarray, ids: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest rows (ids, distances) to q without itself; equal distances by id."""
    d = ((x.astype(np.float64) - q.astype(np.float64)) ** 2).sum(1)
    d[ids == own] = np.inf
    n = min(k, int(np.isfinite(d).sum()))
    if n == 0:
        return np.empty(0, np.int64), np.empty(0)
    cut = np.partition(d, n - 1)[n - 1]
    r = np.flatnonzero(d <= cut)
    r = r[np.lexsort((ids[r], d[r]))[:n]]
    return ids[r], d[r]


def search_leaves(tree: Tree, members: dict[int, np.ndarray], ids: np.ndarray, x: np.ndarray, own: np.ndarray, y: np.ndarray, leaves: int, k: int, block: int = 1024):
    """(query, id, squared distance) of the k nearest rows in the leaves that each query visits. Queries are taken leaf by
    leaf, so that a leaf's distances are one product of matrices; a few more than k are kept for the exact distances. Where the last of these
    lies within the rounding of the k-th, as among copies, all rows of the query's leaves are taken exactly."""
    keep, out, front = k + 6, [], Frontier(tree)
    # Of float32 distances by |a|^2 - 2ab + |b|^2: a rounding for each term of the sums, over (|a| + |b|)^2.
    slack, far = 2 * (x.shape[1] + 8) * float(np.finfo(np.float32).eps), np.sqrt((x.astype(np.float64) ** 2).sum(1).max(initial=0))
    for at in range(0, len(y), block):
        q, o = y[at : at + block], own[at : at + block]
        seen = front.visits(q, leaves)
        order = np.argsort(seen, axis=None, kind="stable")
        who_of, leaf_of = order // seen.shape[1], seen.reshape(-1)[order]
        names, first = np.unique(leaf_of, return_index=True)
        best = np.full((len(q), keep), np.inf, np.float32)
        row = np.zeros((len(q), keep), np.int64)
        for leaf, w in zip(names.tolist(), np.split(who_of, first[1:]), strict=True):
            r = members[leaf]
            d = _distances(q[w], x[r])
            d[o[w][:, None] == ids[r][None, :]] = np.inf
            better = d.min(1) < best[w].max(1)
            w, d = w[better], d[better]
            if not len(w):
                continue
            d = np.concatenate((best[w], d), 1)
            i = np.concatenate((row[w], np.broadcast_to(r, (len(w), len(r)))), 1)
            cut = np.argpartition(d, keep - 1, 1)[:, :keep]
            best[w], row[w] = np.take_along_axis(d, cut, 1), np.take_along_axis(i, cut, 1)
        exact = ((x[row].astype(np.float64) - q[:, None, :].astype(np.float64)) ** 2).sum(2)
        exact[np.isinf(best)] = np.inf
        names = ids[row]
        order = np.lexsort((names, exact), axis=1)[:, :k]
        exact, names = np.take_along_axis(exact, order, 1), np.take_along_axis(names, order, 1)
        # Whatever was left out has a float32 distance of at least the greatest kept: by more than the rounding above the k-th?
        bound = slack * (far + np.sqrt((q.astype(np.float64) ** 2).sum(1))) ** 2
        for i in np.flatnonzero(~np.isinf(best).any(1) & (best.max(1) - bound <= exact[:, -1])).tolist():
            r = np.concatenate([members[leaf] for leaf in seen[i].tolist() if leaf >= 0])
            names[i], exact[i] = _top(q[i], x[r], ids[r], o[i], k)
        ok = np.isfinite(exact)
        out.append((np.repeat(o, ok.sum(1)), names[ok], exact[ok]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))


def exhaustive(v: DataFrame, queries: list[tuple[int, list]], k: int) -> DataFrame:
    """(query, id, d): exact neighbours of a few queries over all vectors. A task holds one batch and k rows a query."""
    own, y = np.array([q for q, _ in queries], np.int64), np.array([x for _, x in queries], np.float32)
    qs = v.sparkSession.sparkContext.broadcast((own, y))

    def run(batches):
        own, y = qs.value
        best = [(np.empty(0, np.int64), np.empty(0))] * len(own)
        for b in batches:
            if not b.num_rows or not len(own):
                continue
            ids, x = np.asarray(b.column(0), np.int64), _matrix(b.column(1))
            near = _distances(y, x)
            slack = 4 * (x.shape[1] + 8) * float(np.finfo(np.float32).eps) * (np.sqrt((y * y).sum(1)) + np.sqrt((x * x).sum(1).max())) ** 2
            for i in range(len(own)):
                limit = best[i][1][-1] if len(best[i][1]) == k else np.inf
                if k + 1 < len(ids):  # one of them may be the query itself
                    limit = min(limit, float(np.partition(near[i], k)[k]) + slack[i])
                r = np.flatnonzero(near[i] <= limit + slack[i])
                if len(r):
                    a, d = _top(y[i], x[r], ids[r], own[i], k)
                    a, d = np.concatenate((best[i][0], a)), np.concatenate((best[i][1], d))
                    order = np.lexsort((a, d))[:k]
                    best[i] = a[order], d[order]
        n = [len(a) for a, _ in best]
        if sum(n):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, n)), pa.array(np.concatenate([a for a, _ in best])), pa.array(np.concatenate([d for _, d in best]))], names=["query", "id", "d"])

    w = Window.partitionBy("query").orderBy("d", "id")
    return v.mapInArrow(run, "query long, id long, d double").withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select("query", "id", "d")


def order_of(tree: Tree):
    """A function that gives (queries, limit) leaves in the order of their visits: all queries at once where a row for each query
    over all nodes is small, else query by query."""
    if len(tree.children) <= MATRIX_NODES:
        front = Frontier(tree)
        return lambda y, limit: np.concatenate([front.visits(part, limit) for part in np.array_split(y, -(-len(y) // 256))])
    return lambda y, limit: np.array([list(islice(tree.visit(q), limit)) for q in y], np.int64)


def _shards(v: DataFrame, tree: Tree) -> DataFrame:
    """(shard, id, v)."""
    shared = v.sparkSession.sparkContext.broadcast(tree)

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(shared.value.assign(_matrix(b.column(1)))), b.column(0), b.column(1)], names=["shard", "id", "v"])

    return v.mapInArrow(run, "shard long, id long, v array<float>")


class Index:
    """The vectors by shard and leaf, and each shard's own tree: all of it in tables, made once and searched again and again."""

    def __init__(self, vectors: DataFrame, id_: str = "vec_id", vec: str = "embedding", metric: str = "euclidean", dim: int | None = None, shard_rows: int = SHARD_ROWS):
        self.id_, self.vec, self.metric = id_, vec, metric
        self.v, self.dim = prepared(vectors, id_, vec, dim, metric)
        self.tree = upper_tree(self.v, self.v.count(), self.dim, shard_rows)
        self.shards = len(self.tree.leaves())

        def build(data: pa.Table) -> pa.Table:
            data = data.sort_by("id")
            local, members = local_tree(_matrix(data.column("v")), 7)
            leaf = np.empty(data.num_rows, np.int64)
            for node, r in members.items():
                leaf[r] = node
            n = len(leaf)
            tree = pa.array([pickle.dumps(local), *[None] * (n - 1)], pa.binary())
            return pa.table({"shard": data.column("shard"), "id": data.column("id"), "v": data.column("v"), "leaf": pa.array(leaf), "tree": tree})

        rows = _shards(self.v, self.tree)
        self.rows = written(rows.groupBy("shard").applyInArrow(build, "shard long, id long, v array<float>, leaf long, tree binary"))

    def ask(self, queries: DataFrame, visits: int) -> DataFrame:
        """(shard, query, q) of the shards that each query (id, v) visits."""
        shared, n = self.v.sparkSession.sparkContext.broadcast(self.tree), min(visits, self.shards)

        def route(batches):
            first = order_of(shared.value)
            for b in batches:
                if b.num_rows:
                    to = first(_matrix(b.column(1)), n)
                    at = pa.array(np.repeat(np.arange(len(to)), n))
                    yield pa.RecordBatch.from_arrays([pa.array(to.reshape(-1)), b.column(0).take(at), b.column(1).take(at)], names=["shard", "query", "q"])

        return queries.mapInArrow(route, "shard long, query long, q array<float>")

    def calibrate(self, k: int, target: float, sample: int = SAMPLE_QUERIES) -> tuple[int, int]:
        """(shards, leaves of each) that reach the target recall on sampled queries, whose neighbours are known exactly."""
        queries = self.v.orderBy(F.xxhash64("id"), "id").limit(sample)
        truth = exhaustive(self.v, [(r.id, list(r.v)) for r in queries.collect()], k)
        truth = truth.join(self.rows.select("id", "shard", "leaf"), "id").groupBy("query").agg(F.collect_list("shard").alias("shards"), F.collect_list("leaf").alias("leaves"))
        shared = self.v.sparkSession.sparkContext.broadcast(self.tree)

        def turns(batches):
            for b in batches:
                out = []
                for q, shards, leaves in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                    want, turn = set(shards), {}
                    for i, node in enumerate(shared.value.visit(np.array(q, np.float32))):
                        if node in want:
                            turn[node] = i
                            if len(turn) == len(want):
                                break
                    out += [(s, x, turn[s], q) for s, x in zip(shards, leaves, strict=True)]
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=["shard", "leaf", "turn", "q"])

        wanted = written(queries.join(truth, F.col("id") == F.col("query")).select("v", "shards", "leaves").mapInArrow(turns, "shard long, leaf long, turn long, q array<float>"))
        trees = self.rows.where("tree IS NOT NULL").select("shard", "tree")

        def run(tree: pa.Table, asked: pa.Table) -> pa.Table:
            turn = leaf = np.empty(0, np.int64)
            if asked.num_rows:
                local = pickle.loads(tree.column("tree")[0].as_py())
                seen = Frontier(local).visits(_matrix(asked.column("q")), len(local.children))
                turn, leaf = np.asarray(asked.column("turn"), np.int64), (seen == np.asarray(asked.column("leaf"))[:, None]).argmax(1)
            return pa.table({"turn": pa.array(turn), "leaf": pa.array(leaf.astype(np.int64))})

        found = trees.groupBy("shard").cogroup(wanted.groupBy("shard")).applyInArrow(run, "turn long, leaf long").toArrow()
        if not found.num_rows:
            return 1, 1
        turn, leaf = np.asarray(found.column("turn")), np.asarray(found.column("leaf"))
        t = n = 1
        while (turn < t).mean() < 1 - (1 - target) * 0.4:
            t += 1
        while ((turn < t) & (leaf < n)).mean() < target:
            n += 1
        return t, n

    def search(self, queries: DataFrame, k: int, visits: int, leaves: int) -> DataFrame:
        """(query, id, d, rank) of the queries (id, v) in the shards and leaves that they visit."""

        def search(data: pa.Table, asked: pa.Table) -> pa.Table:
            out = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
            if data.num_rows and asked.num_rows:
                local = pickle.loads(data.filter(pc.is_valid(data.column("tree"))).column("tree")[0].as_py())
                ids, x, leaf = np.asarray(data.column("id"), np.int64), _matrix(data.column("v")), np.asarray(data.column("leaf"), np.int64)
                order = np.argsort(leaf, kind="stable")
                names, first = np.unique(leaf[order], return_index=True)
                members = dict(zip(names.tolist(), np.split(order, first[1:]), strict=True))
                out = search_leaves(local, members, ids, x, np.asarray(asked.column("query"), np.int64), _matrix(asked.column("q")), leaves, k)
            return pa.table({c: pa.array(a) for c, a in zip(("query", "id", "d"), out, strict=True)})

        found = self.rows.groupBy("shard").cogroup(self.ask(queries, visits).groupBy("shard")).applyInArrow(search, "query long, id long, d double")
        w = Window.partitionBy("query").orderBy("d", "id")
        return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def neighbours(vectors: DataFrame, id_: str = "vec_id", vec: str = "embedding", k: int = NEIGHBOURS, target: float = TARGET, metric: str = "euclidean", dim: int | None = None, shard_rows: int = SHARD_ROWS, every: int = 1) -> DataFrame:
    """(id, neighbour, rank, distance), rank from 1, among all vectors, for every vector whose id ``every`` divides."""
    index = Index(vectors, id_, vec, metric, dim, shard_rows)
    visits, leaves = index.calibrate(k, target)
    found = index.search(index.v.where(F.col("id") % every == 0), k, visits, leaves)
    distance = F.sqrt("d") if metric == "euclidean" else F.greatest(F.col("d") / 2, F.lit(0.0))
    return found.select(F.col("query").alias("id"), F.col("id").alias("neighbour"), "rank", F.round(distance, 6).alias("distance"))


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest neighbours, among all embeddings, of each whose id 100 divides."""
    return neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), every=100)


QUERIES = {"op7_ann": op7_ann}
ORACLES: dict[str, str] = {}
