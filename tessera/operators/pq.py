"""Product quantization: vectors are cut into m subspaces, and each part is replaced by its nearest of up to 256 centroids.

Training is Lloyd's algorithm for all subspaces at once: in each pass tasks assign all parts and add them up, so that
m x 256 sums move, whatever the number of vectors. The codebook has that size too, so it can be sent to all tasks.
Its first centroids are spread over a sample of ``init_sample`` vectors (a documented bound on a fit's start).
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.vectors import distance
from tessera.operators.index import without
from tessera.operators.topk import top
from tessera.plans.settings import InvalidConfig, PqConfig
from tessera.sources import generations
from tessera.sources.scratch import written

DIGITS = 6
#: Rows whose codes are sought at once; their distances from all centroids stay in a core's cache.
ENCODED_AT_ONCE = 2048


def _matrix(column: pa.Array) -> np.ndarray:
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(a.flatten(), np.float64).reshape(len(a), -1)


def _squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None, :], 0)


def spread(x: np.ndarray, k: int) -> np.ndarray:
    """k first centroids: the row nearest the mean, then always the row farthest from those taken; without repetitions."""
    x = np.unique(x, axis=0)
    if len(x) <= k:
        return x
    out = [x[int(((x - x.mean(0)) ** 2).sum(1).argmin())]]
    d = ((x - out[0]) ** 2).sum(1)
    while len(out) < k:
        out.append(x[int(d.argmax())])
        d = np.minimum(d, ((x - out[-1]) ** 2).sum(1))
    return np.array(out)


@dataclass
class Codebook:
    """``centroids[m]``: an array (centroids, dim / m) of each subspace."""

    centroids: list[np.ndarray]

    @property
    def m(self) -> int:
        return len(self.centroids)

    @property
    def dim(self) -> int:
        return sum(c.shape[1] for c in self.centroids)

    def parts(self, x: np.ndarray) -> list[np.ndarray]:
        return np.split(x, np.cumsum([c.shape[1] for c in self.centroids])[:-1], axis=1)

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Codes (rows, m); of equally near centroids the first."""
        return np.stack([_squared(p, c).argmin(1) for p, c in zip(self.parts(x), self.centroids, strict=True)], 1).astype(np.int32)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([c[codes[:, i]] for i, c in enumerate(self.centroids)], 1)

    def table(self, query: Sequence[float]) -> list[list[float]]:
        """Squared distances of the query's parts to all centroids."""
        if len(query) != self.dim:
            raise InvalidConfig(f"the query has {len(query)} dimensions, the codebook {self.dim}")
        q = np.array(query, float)[None, :]
        return [((c - p) ** 2).sum(1).tolist() for p, c in zip(self.parts(q), self.centroids, strict=True)]

    def compression_ratio(self) -> float:
        """Bytes of 32-bit vectors by bytes of codes."""
        return self.dim * 4 / self.m

    def frame(self, spark: SparkSession) -> DataFrame:
        """(subspace, centroid, vec), to be stored."""
        rows = [(s, i, [float(x) for x in v]) for s, c in enumerate(self.centroids) for i, v in enumerate(c)]
        return spark.createDataFrame(rows, "subspace int, centroid int, vec array<double>")

    @staticmethod
    def of(frame: DataFrame) -> Codebook:
        by: dict[int, list[list[float]]] = {}
        for r in frame.orderBy("subspace", "centroid").collect():  # m x 256 rows
            by.setdefault(r.subspace, []).append(list(r.vec))
        return Codebook([np.array(by[s]) for s in sorted(by)])


def train(vectors: DataFrame, dim: int, cfg: PqConfig | None = None, id_: str = "doc_id", vec: str = "embedding") -> Codebook:
    """The codebook of all vectors of length ``dim``; a centroid without vectors stays where it is."""
    cfg = cfg or PqConfig()
    cfg.check(dim)
    d = dim // cfg.m
    v = vectors.select(F.col(id_).alias("id"), F.col(vec).cast("array<double>").alias("v")).where((F.size("v") == dim) & ~F.exists("v", lambda x: x.isNull()))
    context = v.sparkSession.sparkContext
    # read again in each pass, so it is dealt to all cores once: a table of a few files is a few tasks' work
    v = written(v.repartition(context.defaultParallelism))
    first = v.orderBy(F.xxhash64("id"), "id").limit(cfg.init_sample).select("v").toArrow()
    if not first.num_rows:
        raise InvalidConfig("no vector to train on")
    x = _matrix(first.column("v"))
    book = Codebook([spread(x[:, s * d : (s + 1) * d], cfg.centroids) for s in range(cfg.m)])
    before = None
    sums = ", ".join(f"s{i} double" for i in range(d))
    for _ in range(cfg.max_iter):
        shared = context.broadcast(book)

        def add(batches, shared=shared):
            b, acc = shared.value, {}
            for batch in batches:
                for start in range(0, batch.num_rows, ENCODED_AT_ONCE):
                    for s, p in enumerate(b.parts(_matrix(batch.column(0).slice(start, ENCODED_AT_ONCE)))):
                        dist = _squared(p, b.centroids[s])
                        at = dist.argmin(1)
                        k = len(b.centroids[s])
                        row = np.column_stack([np.bincount(at, minlength=k), np.bincount(at, dist[np.arange(len(p)), at], minlength=k), *(np.bincount(at, p[:, i], minlength=k) for i in range(p.shape[1]))])
                        acc[s] = acc[s] + row if s in acc else row
            for s, rows in acc.items():
                some = np.flatnonzero(rows[:, 0])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), s, np.int32)), pa.array(some.astype(np.int32)), *(pa.array(rows[some, i]) for i in range(rows.shape[1]))], names=["subspace", "centroid", "n", "loss", *(f"s{i}" for i in range(rows.shape[1] - 2))])

        got = v.select("v").mapInArrow(add, f"subspace int, centroid int, n double, loss double, {sums}")
        got = got.groupBy("subspace", "centroid").agg(*(F.sum(c).alias(c) for c in got.columns[2:])).collect()
        loss = sum(r.loss for r in got)
        new = [c.copy() for c in book.centroids]
        for r in got:
            new[r.subspace][r.centroid] = np.array(r[4:]) / r.n
        book = Codebook(new)
        shared.unpersist()
        if before is not None and before - loss <= cfg.tol * max(before, 1e-12):
            break
        before = loss
    return book


def encoded(vectors: DataFrame, book: Codebook, id_: str = "doc_id", vec: str = "embedding") -> DataFrame:
    """(doc_id, codes) of the vectors that fit the codebook."""
    dim = book.dim
    v = vectors.select(F.col(id_).alias("doc_id"), F.col(vec).cast("array<double>").alias("v")).where((F.size("v") == dim) & ~F.exists("v", lambda x: x.isNull()))
    shared = vectors.sparkSession.sparkContext.broadcast(book)

    def run(batches):
        for b in batches:
            if b.num_rows:
                codes = shared.value.encode(_matrix(b.column(1)))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.FixedSizeListArray.from_arrays(pa.array(codes.reshape(-1)), codes.shape[1]).cast(pa.list_(pa.int32()))], names=["doc_id", "codes"])

    return v.mapInArrow(run, f"doc_id {v.schema['doc_id'].dataType.simpleString()}, codes array<int>")


def errors(vectors: DataFrame, book: Codebook, id_: str = "doc_id", vec: str = "embedding") -> DataFrame:
    """(doc_id, error): the distance of each vector from what its codes stand for, in one pass and without a join."""
    dim = book.dim
    v = vectors.select(F.col(id_).alias("doc_id"), F.col(vec).cast("array<double>").alias("v")).where((F.size("v") == dim) & ~F.exists("v", lambda x: x.isNull()))
    shared = vectors.sparkSession.sparkContext.broadcast(book)

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, ENCODED_AT_ONCE):
                x = _matrix(b.column(1).slice(at, ENCODED_AT_ONCE))
                back = shared.value.decode(shared.value.encode(x))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(x)), pa.array(np.sqrt(((back - x) ** 2).sum(1)))], names=["doc_id", "error"])

    return v.mapInArrow(run, f"doc_id {v.schema['doc_id'].dataType.simpleString()}, error double")


def decoded(codes: DataFrame, book: Codebook) -> DataFrame:
    """(doc_id, vec): the vectors that the codes stand for."""
    shared = codes.sparkSession.sparkContext.broadcast(book)

    def run(batches):
        for b in batches:
            if b.num_rows:
                x = shared.value.decode(np.asarray(b.column(1).flatten(), np.int64).reshape(b.num_rows, -1))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), x.shape[1]).cast(pa.list_(pa.float64()))], names=["doc_id", "vec"])

    return codes.select("doc_id", "codes").mapInArrow(run, f"doc_id {codes.schema['doc_id'].dataType.simpleString()}, vec array<double>")


def search(codes: DataFrame, book: Codebook, query: Sequence[float], k: int = 10) -> DataFrame:
    """(doc_id, distance): the k least distances by table look-up, in generated code."""
    tables = [F.array(*(F.lit(x) for x in row)) for row in book.table(query)]
    total = F.lit(0.0)
    for i, t in enumerate(tables):
        total = total + F.get(t, F.get("codes", F.lit(i)))
    return top(codes.select("doc_id", F.round(F.sqrt(total), DIGITS).alias("distance")), k, "distance", largest=False)


def reranked(found: DataFrame, vectors: DataFrame, query: Sequence[float], k: int = 10, id_: str = "doc_id", vec: str = "embedding") -> DataFrame:
    """(doc_id, distance): a short list ordered anew by the exact distances of the raw vectors. Pass several times k rows.
    How the two are joined is left to the planner, which knows the list's size."""
    v = vectors.select(F.col(id_).alias("doc_id"), F.col(vec).alias("v"))
    j = v.join(found.select("doc_id"), "doc_id")
    return top(j.select("doc_id", F.round(distance(F.col("v"), list(query)), DIGITS).alias("distance")), k, "distance", largest=False)


def with_error(codes: DataFrame, book: Codebook, vectors: DataFrame, id_: str = "doc_id", vec: str = "embedding") -> DataFrame:
    """(doc_id, codes, error): how far each vector lies from what its codes stand for, to be stored beside them."""
    v = vectors.select(F.col(id_).alias("doc_id"), F.col(vec).alias("v"))
    back = decoded(codes, book).join(v, "doc_id").select("doc_id", distance(F.col("vec"), F.col("v")).alias("error"))
    return codes.select("doc_id", "codes").join(back, "doc_id")


def exact_search(codes: DataFrame, book: Codebook, vectors: DataFrame, query: Sequence[float], k: int = 10, id_: str = "doc_id", vec: str = "embedding") -> DataFrame:
    """(doc_id, distance): the k nearest by their raw vectors. A vector's distance lies within its ``error`` of that of its codes, so
    only those are read whose least possible distance isn't beyond the k-th of the greatest possible ones, however many that are."""
    tables = [F.array(*(F.lit(x) for x in row)) for row in book.table(query)]
    total = F.lit(0.0)
    for i, t in enumerate(tables):
        total = total + F.get(t, F.get("codes", F.lit(i)))
    near = codes.select("doc_id", F.sqrt(total).alias("d"), "error")
    most = top(near.select("doc_id", (F.col("d") + F.col("error")).alias("distance")), k, "distance", largest=False).agg(F.max("distance").alias("most"), F.count(F.lit(1)).alias("n")).first()
    bound = most.most * (1 + 1e-9) + 1e-9 if most.n == k else float("inf")
    return reranked(near.where(F.col("d") - F.col("error") <= bound), vectors, query, k, id_, vec)


def should_train(vectors: DataFrame, least: int) -> bool:
    """Whether there are ``least`` vectors; it stops counting there."""
    return vectors.limit(least).count() >= least


def auto_train(vectors: DataFrame, dim: int, least: int, cfg: PqConfig | None = None, id_: str = "doc_id", vec: str = "embedding") -> Codebook | None:
    """A codebook once there are vectors enough, None before."""
    return train(vectors, dim, cfg, id_, vec) if should_train(vectors, least) else None


def memory(codes: DataFrame, book: Codebook) -> DataFrame:
    """(n, code_bytes, raw_bytes, codebook_bytes, ratio) in one row."""
    n = F.count(F.lit(1))
    return codes.agg(
        n.alias("n"), (n * book.m).alias("code_bytes"), (n * book.dim * 4).alias("raw_bytes"),
        F.lit(sum(c.size for c in book.centroids) * 4).cast("long").alias("codebook_bytes"), F.lit(book.compression_ratio()).alias("ratio"),
    )


class PqStore:
    """Codes in a folder. Vectors that come before there is a codebook wait as they are; ``train`` makes one and encodes them."""

    def __init__(self, spark: SparkSession, path: str, dim: int, cfg: PqConfig | None = None):
        self.spark, self.path, self.dim, self.cfg = spark, path, dim, cfg or PqConfig()
        self.cfg.check(dim)

    def _now(self, name: str, ddl: str) -> DataFrame:
        return generations.current(self.spark, f"{self.path}/{name}", ddl)

    def book(self) -> Codebook | None:
        frame = self._now("book", "subspace int, centroid int, vec array<double>")
        return None if frame.isEmpty() else Codebook.of(frame)

    def codes(self) -> DataFrame:
        """(doc_id, codes); all codes are 0 for vectors that wait."""
        zero = F.array_repeat(F.lit(0), self.cfg.m)
        return self._now("codes", "doc_id long, codes array<int>").unionByName(self.waiting().select("doc_id", zero.alias("codes")))

    def waiting(self) -> DataFrame:
        return self._now("waiting", "doc_id long, embedding array<float>")

    def add(self, vectors: DataFrame, id_: str = "doc_id", vec: str = "embedding") -> None:
        """Adds vectors; one that is there already is replaced."""
        v = vectors.select(F.col(id_).cast("long").alias("doc_id"), F.col(vec).cast("array<float>").alias("embedding"))
        book = self.book()
        new = v.where(F.size("embedding") == self.dim) if book is None else encoded(v, book)
        new = written(new)
        self.remove(new)
        generations.append(new, f"{self.path}/{'waiting' if book is None else 'codes'}")

    def train(self) -> Codebook:
        """A codebook of the vectors that wait, which then are codes."""
        book = train(self.waiting(), self.dim, self.cfg)
        generations.replace(book.frame(self.spark), f"{self.path}/book")
        generations.append(encoded(self.waiting(), book), f"{self.path}/codes")
        generations.replace(self.waiting().limit(0), f"{self.path}/waiting")
        return book

    def remove(self, ids: DataFrame) -> None:
        """Takes vectors (doc_id) away; unknown ids change nothing."""
        for name, ddl in (("codes", "doc_id long, codes array<int>"), ("waiting", "doc_id long, embedding array<float>")):
            now = self._now(name, ddl)
            if not now.join(ids.select("doc_id"), "doc_id", "left_semi").isEmpty():
                generations.replace(without(now, ids), f"{self.path}/{name}")

    def contains(self, ids: DataFrame) -> DataFrame:
        """Those of the ids (doc_id) that are there."""
        return ids.join(self.codes().select("doc_id"), "doc_id", "left_semi")

    def count(self) -> int:
        return self.codes().count()


class VectorCache:
    """Raw vectors of the documents that short lists held last, at most ``capacity``: the exact re-ranking of a search reads only
    those that aren't here. The one used longest ago goes first."""

    def __init__(self, capacity: int = 10_000):
        self.capacity, self.hits, self.misses = capacity, 0, 0
        self._rows: OrderedDict[int, np.ndarray] = OrderedDict()

    def __len__(self) -> int:
        return len(self._rows)

    def get(self, id_: int) -> np.ndarray | None:
        if id_ not in self._rows:
            self.misses += 1
            return None
        self.hits += 1
        self._rows.move_to_end(id_)
        return self._rows[id_]

    def put(self, id_: int, v: Sequence[float]) -> None:
        self._rows[id_] = np.asarray(v, np.float32)
        self._rows.move_to_end(id_)
        while len(self._rows) > self.capacity:
            self._rows.popitem(last=False)

    def remove(self, id_: int) -> None:
        self._rows.pop(id_, None)

    def reranked(self, found: DataFrame, vectors: DataFrame, query: Sequence[float], k: int = 10, id_: str = "doc_id", vec: str = "embedding") -> list[tuple[int, float]]:
        """(doc_id, distance) of the k nearest of a short list, which comes to the driver."""
        ids = [r.doc_id for r in found.select("doc_id").collect()]
        have = {i: self.get(i) for i in ids}
        if lacking := [i for i, v in have.items() if v is None]:
            for r in vectors.where(F.col(id_).isin(lacking)).select(F.col(id_).alias("i"), F.col(vec).alias("v")).collect():
                self.put(r.i, r.v)
                have[r.i] = np.asarray(r.v, np.float32)
        q = np.asarray(query, float)
        return sorted(((i, round(float(np.sqrt(((v - q) ** 2).sum())), DIGITS)) for i, v in have.items() if v is not None), key=lambda x: (x[1], x[0]))[:k]
