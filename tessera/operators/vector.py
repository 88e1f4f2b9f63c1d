"""Exact vector search: every live vector of the right length is scored; nothing is found for k = 0 or a query of another
length. Scores are rounded before they are ranked; ties go to the lower id."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.vectors import similarity
from tessera.operators.index import without
from tessera.operators.topk import top, top_by
from tessera.plans.settings import METRICS, InvalidConfig

DIGITS = 6
#: Bytes of query vectors that are sent to all tasks; larger sets of queries are cut into blocks that meet the vectors in a shuffle.
QUERY_BYTES = 32 << 20


def search(vectors: DataFrame, query: Sequence[float], k: int = 10, metric: str = "cosine", dim: int | None = None, tombstones: DataFrame | None = None, id_: str = "doc_id", vec: str = "embedding") -> DataFrame:
    """(doc_id, score) of the k most similar vectors."""
    v = without(vectors.select(F.col(id_).alias("doc_id"), F.col(vec).alias("v")), tombstones)
    if k <= 0 or (dim is not None and len(query) != dim):
        return v.select("doc_id", F.lit(0.0).alias("score")).limit(0)
    score = F.round(similarity(metric, F.col("v"), list(query)), DIGITS)
    return top(v.where(F.size("v") == len(query)).select("doc_id", score.alias("score")).where("score IS NOT NULL"), k)


def guarded(vectors: DataFrame, dim: int, vec: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """(rows whose vector has the length, rows that are refused)."""
    ok = F.coalesce(F.size(vec) == dim, F.lit(False)) & ~F.coalesce(F.exists(vec, lambda x: x.isNull()), F.lit(False))
    return vectors.where(ok), vectors.where(~ok)


def _matrix(column: pa.Array) -> np.ndarray:
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(a.flatten(), np.float64).reshape(len(a), -1)


#: Metrics by distance; "distance" is that of ``nearest``, whose scores are distances below 0.
FAR = ("euclidean", "distance")
#: Queries and rows whose products are made at once.
QUERIES_AT_ONCE, ROWS_AT_ONCE = 1024, 4096
#: Queries from which products cost more than an exchange of the vectors, so that these are dealt to all cores; a small table is one file, which one task reads.
DEALT = 1024


def _exact(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """The rounded score of each pair of rows, in double precision."""
    if metric in FAR:
        d = np.sqrt(((x - q) ** 2).sum(1))
        return np.round(1 / (1 + d) if metric == "euclidean" else -d, DIGITS)
    dots = np.einsum("ij,ij->i", q, x)
    if metric == "dot":
        return np.round(dots, DIGITS)
    norm = np.sqrt((q * q).sum(1)) * np.sqrt((x * x).sum(1))
    return np.round(np.clip(np.divide(dots, norm, out=np.zeros_like(dots), where=norm > 0), 0, 1), DIGITS)


class _Lists:
    """The k best rows so far of each of a block of queries.

    Products in single precision rule out what lies below a query's k-th score by more than their error can be; what is left,
    which is little once a first tile is done, is scored in double precision. So every pair is looked at, and the result is the
    exact one. A later tile of greater ids loses ties."""

    def __init__(self, qid: np.ndarray, q: np.ndarray, k: int, metric: str):
        self.qid, self.q, self.k, self.metric = qid, q, max(k, 0), metric
        self.ids, self.scores = np.full((len(q), self.k), np.iinfo(np.int64).max), np.full((len(q), self.k), -np.inf)
        self.size = np.sqrt((q * q).sum(1))
        self.key = np.divide(q, self.size[:, None], out=np.zeros_like(q), where=self.size[:, None] > 0) if metric == "cosine" else q
        self.last = np.iinfo(np.int64).min

    def _bound(self, some: slice, later: bool, error: np.ndarray) -> np.ndarray:
        """The least product with which a row can still enter each list."""
        t = self.scores[some, -1] + (0.5 if later else -0.5) * 10.0**-DIGITS
        if self.metric in FAR:
            least = self._product(some, t)
        else:
            least = t.copy()
            if self.metric == "cosine":
                least[t <= 0] = -np.inf
                if later:
                    least[self.scores[some, -1] >= 1] = np.inf
                    least[(self.size[some] == 0) & (self.scores[some, -1] >= 0)] = np.inf
        return least - error

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        if not len(ids) or not len(self.q) or not self.k:
            return
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        later = bool(ids[0] > self.last)
        size = np.sqrt((x * x).sum(1))
        rows = np.divide(x, size[:, None], out=np.zeros_like(x), where=size[:, None] > 0) if self.metric == "cosine" else x
        q = self.key
        if self.metric in FAR:
            q, rows = np.column_stack([q, np.ones(len(q))]), np.column_stack([rows, -(size**2) / 2])
        most = max(float(np.abs(q).max(initial=0)), float(np.abs(rows).max(initial=0)))
        least = min(float(np.abs(a[a != 0]).min(initial=1)) for a in (q, rows))
        kind, unit = (np.float32, 2.0**-24) if most < 1e15 and least > 1e-15 else (np.float64, 2.0**-53)
        width = np.sqrt((rows * rows).sum(1)).max()
        error = 2 * (q.shape[1] + 8) * unit * np.sqrt((q * q).sum(1)) * width + 1e-12 * (1 + self.size**2)
        q, rows = q.astype(kind), rows.astype(kind)
        for a in range(0, len(ids), ROWS_AT_ONCE):
            tile, own = rows[a : a + ROWS_AT_ONCE].T, slice(a, a + ROWS_AT_ONCE)
            for b in range(0, len(q), QUERIES_AT_ONCE):
                some = slice(b, b + QUERIES_AT_ONCE)
                near = q[some] @ tile
                bound = self._bound(some, later, error[some])
                if (self.scores[some, -1] == -np.inf).any() and near.shape[1] > self.k:  # a first k-th product, of which every list has k rows
                    kth = self._tied(some, np.partition(near, -self.k, 1)[:, -self.k].astype(float) - error[some]) - error[some]
                    bound = np.where(self.scores[some, -1] == -np.inf, kth, bound)
                bound = np.nextafter(bound.astype(kind), kind(-np.inf))
                self._enter(b, near, bound, ids[own], x[own])
        self.last = max(self.last, int(ids[-1]))

    def _product(self, some: slice, t: np.ndarray) -> np.ndarray:
        """The product q * x - x * x / 2 of a row whose score is t; none where no row has it."""
        far = -t if self.metric == "distance" else np.divide(1, t, out=np.full_like(t, np.inf), where=t > 0) - 1
        return np.where(far >= 0, (self.size[some] ** 2 - far * far) / 2, np.inf)

    def _tied(self, some: slice, product: np.ndarray) -> np.ndarray:
        """The least product of a row whose rounded score can tie with that of this one."""
        if self.metric in FAR:
            far = np.sqrt(np.maximum(self.size[some] ** 2 - 2 * product, 0))
            return self._product(some, (1 / (1 + far) if self.metric == "euclidean" else -far) - 1.001 * 10.0**-DIGITS)
        if self.metric == "cosine":  # below 0 all are 0
            return np.where(product > 10.0**-DIGITS, product - 1.001 * 10.0**-DIGITS, -np.inf)
        return product - 1.001 * 10.0**-DIGITS

    def _enter(self, b: int, near: np.ndarray, bound: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        each = max(1, (1 << 20) // near.shape[1])
        for c in range(0, len(near), each):
            row, col = np.nonzero(near[c : c + each] >= bound[c : c + each, None])
            if not len(row):
                continue
            at = row + b + c
            which, n = np.unique(at, return_counts=True)
            ids_all = np.concatenate([self.ids[which].ravel(), ids[col]])
            scores = np.concatenate([self.scores[which].ravel(), _exact(self.q[at], x[col], self.metric)])
            of = np.concatenate([np.repeat(which, self.k), at])
            order = np.lexsort((ids_all, -scores, of))
            first = np.cumsum(n + self.k) - n - self.k
            take = order[(first[:, None] + np.arange(self.k)[None, :]).ravel()]
            self.ids[which], self.scores[which] = ids_all[take].reshape(-1, self.k), scores[take].reshape(-1, self.k)

    def rows(self):
        """(qid, id, score)."""
        there = self.scores > -np.inf
        return np.broadcast_to(self.qid[:, None], there.shape)[there], self.ids[there], self.scores[there]


def nearest(qid: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(qid, id, distance): the k rows of least rounded distance of each query, ties by id."""
    lists = _Lists(qid, q, k, "distance")
    lists.add(ids, x)
    of, found, score = lists.rows()
    return of, found, -score


def batch_search(vectors: DataFrame, queries: DataFrame, dim: int, k: int = 10, metric: str = "cosine", id_: str = "doc_id", vec: str = "embedding", qid: str = "qid", qvec: str = "embedding") -> DataFrame:
    """(qid, doc_id, score, rank): the k most similar vectors of each of many queries, as products of matrices.

    Each task gives its k best of each query, which are all that is shuffled. Query vectors are broadcast up to
    ``QUERY_BYTES``; beyond that blocks of queries are joined to blocks of vectors.
    """
    if metric not in METRICS:
        raise InvalidConfig(f"no metric {metric!r}")
    v = guarded(vectors.select(F.col(id_).cast("long").alias("doc_id"), F.col(vec).cast("array<double>").alias("v")), dim, "v")[0].where("doc_id IS NOT NULL")
    q = guarded(queries.select(F.col(qid).cast("long").alias("qid"), F.col(qvec).cast("array<double>").alias("v")), dim, "v")[0].where("qid IS NOT NULL")
    kinds, names = "qid long, doc_id long, score double", ["qid", "doc_id", "score"]
    n = q.count()

    if n * dim * 8 <= QUERY_BYTES:
        t = q.toArrow()
        shared = v.sparkSession.sparkContext.broadcast((np.asarray(t.column("qid"), np.int64), _matrix(t.column("v")) if t.num_rows else np.empty((0, dim))))

        def run(batches):
            lists = _Lists(*shared.value, k, metric)
            for b in batches:
                if b.num_rows:
                    lists.add(np.asarray(b.column(0), np.int64), _matrix(b.column(1)))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in lists.rows()], names=names)

        if n >= DEALT:
            v = v.repartition(v.sparkSession.sparkContext.defaultParallelism, "doc_id")
        found = v.mapInArrow(run, kinds)
    else:
        # A grid of tiles as large as a task holds: a vector is copied once for each block of queries, a query for each part of vectors.
        blocks, parts = -(-n * dim * 8 // QUERY_BYTES), max(1, -(-v.count() * dim * 8 // QUERY_BYTES))
        cut = q.withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(blocks)))
        spread = v.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)))
        left = spread.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
        right = cut.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
        # a tile is much work on few bytes, so each has a partition of its own, which it shares with no other by its hash or its size
        tile = (F.col("part") * blocks + F.col("block")).cast("int")
        left, right = (x.withColumn("tile", tile).repartitionById(blocks * parts, F.col("tile")) for x in (left, right))

        def meet(data: pa.Table, asked: pa.Table) -> pa.Table:
            rows = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
            if data.num_rows and asked.num_rows:
                lists = _Lists(np.asarray(asked.column("qid"), np.int64), _matrix(asked.column("v")), k, metric)
                lists.add(np.asarray(data.column("doc_id"), np.int64), _matrix(data.column("v")))
                rows = lists.rows()
            return pa.table(dict(zip(names, map(pa.array, rows), strict=True)))

        found = left.groupBy("tile").cogroup(right.groupBy("tile")).applyInArrow(meet, kinds)
    return top_by(found, "qid", k)
