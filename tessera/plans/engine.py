"""The engine: documents in a folder, searched by keywords, vectors or both.

Writes append commands to the store's log. ``refresh`` folds the log and writes the current documents and their inverted
index (and their graphs, where the settings ask for approximate search) as the next generation, which searches then read. A search that asks for what was
written since reads the documents of the log's end beside the last generation, without a refresh.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.functions.text import analyse
from tessera.operators import filters as flt
from tessera.operators import graph, hybrid, keyword, vector
from tessera.operators.index import InvertedIndex, without
from tessera.operators.topk import top
from tessera.plans.commands import Command
from tessera.plans.metrics import Metrics
from tessera.plans.settings import BadRequest, DocumentNotFound, EngineError, IndexNotReady, InvalidConfig, InvalidEmbeddingDimensions, Settings
from tessera.sources import snapshot
from tessera.sources.documents import DocumentStore
from tessera.sources.scratch import written
from tessera.streaming.changelog import CHANGELOG, DOCUMENT, fold, next_ids, schema

MODES = ("keyword", "vector", "hybrid")


@dataclass(frozen=True)
class SearchRequest:
    mode: str = "hybrid"
    query: str | None = None
    embedding: Sequence[float] | None = None
    k: int = 10
    weight: float = 0.5
    filters: list[flt.Filter] = field(default_factory=list)
    min_applied: int = 0
    wait_seconds: float = 0.0
    fresh: bool = False
    approximate: bool = False


@dataclass(frozen=True)
class SearchResponse:
    """``hits`` (doc_id, score) are what was found, k at most, ``matched`` their number, ``total_hits`` the size of the corpus, and
    ``took_ms`` the time of the whole search."""

    hits: list[tuple[int, float]]
    total_hits: int
    took_ms: float
    spark: SparkSession = field(repr=False)

    @property
    def matched(self) -> int:
        return len(self.hits)

    @property
    def results(self) -> DataFrame:
        """The hits as (doc_id, score, highlights)."""
        return self.spark.createDataFrame([(i, s, []) for i, s in self.hits], "doc_id long, score double, highlights array<string>")


def _metadata(m: dict | None) -> dict | None:
    """Metadata with its free fields as pairs."""
    return m and {**m, "custom": None if m.get("custom") is None else list(dict(m["custom"]).items())}


class Engine:
    def __init__(self, spark: SparkSession, path: str, settings: Settings | None = None):
        self.spark, self.path, self.settings = spark, path, settings or Settings()
        self.store = DocumentStore(spark, path, self.settings.dim)
        self.metrics, self._position, self._generation, self._visible = Metrics(), self.store.applied(), 0, 0
        self._next = (self.store.log().agg(F.max("doc_id").alias("m")).first().m or 0) + 1
        self._index: InvertedIndex | None = None
        self._docs, self._total, self._graphs = spark.createDataFrame([], DOCUMENT), 0, None
        if self._position:
            self.refresh()

    # writes

    def _check(self, embedding) -> None:
        if embedding is not None and len(embedding) != self.settings.dim:
            raise InvalidEmbeddingDimensions(f"{len(embedding)} dimensions where {self.settings.dim} are expected")

    def _write(self, rows: list[tuple]) -> int:
        self._position += 1
        at = int(time.time())
        names = schema(CHANGELOG).names
        full = [dict(zip(names, (self._position, i, *r[:4], _metadata(r[4]), at), strict=True)) for i, r in enumerate(rows)]
        table = pa.Table.from_pylist(full, to_arrow_schema(schema(CHANGELOG)))
        self.store.append(self.spark.createDataFrame(table, schema(CHANGELOG)).coalesce(1))
        return self._position

    def index(self, docs: Sequence[dict]) -> list[int]:
        """Upserts documents (content, embedding, metadata?, id?) in one batch, in order; at the first that is wrong it ends with the error,
        and those before it are written."""
        ids, good, error = [], [], None
        for d in docs:
            try:
                self._check(d.get("embedding"))
                if d.get("content") is None or d.get("embedding") is None:
                    raise BadRequest("a document has a content and an embedding")
            except EngineError as e:
                error = e
                break
            good.append(d)
            ids.append(int(d["id"]) if d.get("id") is not None else self._next)
            self._next = max(self._next, ids[-1] + 1)
        if good:
            self._write([("Index", i, d["content"], [float(x) for x in d["embedding"]], d.get("metadata")) for i, d in zip(ids, good, strict=True)])
        self.metrics.count("documents_indexed_total", len(ids))
        if error:
            raise error
        return ids

    def index_frame(self, docs: DataFrame) -> int:
        """Upserts a DataFrame (id, content, embedding, metadata); returns the position."""
        self._position += 1
        self.store.put(docs, self._position, int(time.time()))
        return self._position

    def index_new(self, docs: DataFrame, order: str = "item_id") -> int:
        """Indexes a DataFrame (content, embedding, metadata, and a column that tells rows apart) under new ids."""
        taken = self.spark.createDataFrame([(self._next - 1,)], "id long")
        given = written(next_ids(taken, docs, [order]))
        position = self.index_frame(given)
        self._next += given.count()
        return position

    def update(self, doc_id: int, content: str | None = None, embedding: Sequence[float] | None = None, metadata: dict | None = None) -> int:
        self._check(embedding)
        if self.store.get(doc_id).isEmpty():
            raise DocumentNotFound(str(doc_id))
        return self._write([("Update", doc_id, content, None if embedding is None else [float(x) for x in embedding], metadata)])

    def delete(self, ids: Sequence[int]) -> int:
        """Ids that aren't there change nothing."""
        self.metrics.count("documents_deleted_total", len(ids))
        return self._write([("Delete", int(i), None, None, None) for i in ids])

    def apply(self, c: Command):
        """Carries out a command; what the method of its kind returns."""
        if c.name in ("IndexDocument", "BatchIndex"):
            return self.index(c.documents)
        if c.name in ("DeleteDocument", "BatchDelete"):
            return self.delete(c.ids)
        if c.name == "UpdateDocument":
            return self.update(c.ids[0], c.change.content, c.change.embedding, c.change.metadata)
        if c.name == "UpdateSettings":
            return self.update_settings(**c.settings)
        return self.optimize() if c.name == "OptimizeIndex" else self.compact()

    def update_settings(self, **changes) -> Settings:
        """Other settings from here on; text analysis takes effect with the next refresh. The vectors' length can't change while
        there are documents."""
        new = replace(self.settings, **changes)
        if new.dim != self.settings.dim and not self.store.documents().isEmpty():
            raise InvalidConfig(f"the documents have {self.settings.dim} dimensions")
        self.settings, self.store.dim = new, new.dim
        return new

    def refresh(self) -> int:
        """Makes all writes visible; returns the position."""
        began, self._generation = time.time(), self._generation + 1
        at = f"{self.path}/visible/{self._generation}-{int(began * 1000)}"
        self.store.documents().write.parquet(f"{at}/documents")
        self._docs = self.spark.read.schema(DOCUMENT).parquet(f"{at}/documents")
        InvertedIndex.build(self._docs, self.settings.tokenizer, "id", "content").save(f"{at}/index")
        self._index = InvertedIndex.load(self.spark, f"{at}/index")
        self._total = self._docs.count()
        self._graphs = None
        if self.settings.approximate:
            graph.built(self._docs, self.settings.dim, id_="id").write.parquet(f"{at}/graphs")
            self._graphs = self.spark.read.parquet(f"{at}/graphs")
        self._visible = self._position
        self.metrics.gauge("applied_position", self._visible)
        self.metrics.observe("index_seconds", time.time() - began)
        return self._visible

    def optimize(self) -> None:
        """Nothing to do: files are laid out when they are written."""

    def compact(self) -> None:
        """Writes the log anew without what is superseded."""
        self.store.compact()

    # reads

    def documents(self) -> DataFrame:
        return self._docs

    def get(self, doc_id: int) -> dict:
        row = self.store.get(doc_id).first()
        if row is None:
            raise DocumentNotFound(str(doc_id))
        return row.asDict(recursive=True)

    def total(self) -> int:
        return self._total

    def fresh(self) -> tuple[DataFrame, InvertedIndex | None]:
        """(documents, index) with what was written since the last refresh: documents that the log's end touches are folded and
        analysed anew, all others are those of the last generation."""
        late = self.store.log().where(F.col("raft_index") > self._visible)
        touched = written(late.select("doc_id").distinct())
        if touched.isEmpty():
            return self._docs, self._index
        new = written(fold(self.store.log().join(touched, "doc_id", "left_semi").select(schema(CHANGELOG).names), self.settings.dim))
        docs = without(self._docs, touched, "id").unionByName(new)
        delta = InvertedIndex.build(new, self.settings.tokenizer, "id", "content")
        return docs, delta if self._index is None else self._index.with_delta(delta, touched)

    def search(self, r: SearchRequest) -> SearchResponse:
        began = time.time()
        if r.mode not in MODES:
            raise BadRequest(f"no mode {r.mode!r}")
        if r.mode != "vector" and r.query is None or r.mode != "keyword" and r.embedding is None:
            raise BadRequest(f"a {r.mode} search lacks its query")
        if r.min_applied > self._visible:
            if r.wait_seconds > 0 and r.min_applied <= self._position:
                self.refresh()
            else:
                raise IndexNotReady(f"position {r.min_applied} isn't visible yet, {self._visible} is")
        rows = self._found(r).select("doc_id", "score").collect()  # k at most
        self.metrics.count("searches_total", label=r.mode)
        took = time.time() - began
        self.metrics.observe("search_seconds", took)
        return SearchResponse([(x.doc_id, x.score) for x in rows], self._total, took * 1000, self.spark)

    def _keyword(self, r: SearchRequest, k: int, docs: DataFrame, index: InvertedIndex | None) -> DataFrame:
        terms = analyse(r.query or "", self.settings.tokenizer)
        if not terms or k <= 0 or index is None:
            return keyword._none(self.spark)
        return top(flt.restrict(keyword.scores(index, terms, self.settings.bm25), docs, r.filters), k)

    def _vector(self, r: SearchRequest, k: int, docs: DataFrame) -> DataFrame:
        q = list(r.embedding or ())
        if r.approximate and self._graphs is not None and not r.fresh and not r.filters:
            return top(graph.scored(graph.find(self._graphs, [(0, q)], self.settings.dim, k)).select("doc_id", "score"), k)
        return vector.search(flt.apply_filters(docs, r.filters), q, k, self.settings.metric, self.settings.dim, id_="id")

    def _found(self, r: SearchRequest) -> DataFrame:
        docs, index = self.fresh() if r.fresh else (self._docs, self._index)
        if r.mode == "keyword":
            return self._keyword(r, r.k, docs, index)
        if r.mode == "vector":
            return self._vector(r, r.k, docs)
        return hybrid.fuse(self._keyword(r, 2 * r.k, docs, index), self._vector(r, 2 * r.k, docs), r.k, r.weight)

    # snapshots and state

    def snapshot(self, path: str) -> None:
        snapshot.save(self.store.documents(), path, self._position)
        self.metrics.count("snapshots_total")

    def restore(self, path: str) -> None:
        """Replaces all documents by those of a snapshot."""
        docs, self._position = snapshot.load(self.spark, path)
        both = docs.withColumn("op", F.explode(F.when(F.col("updated_at") > F.col("created_at"), F.array(F.lit("Index"), F.lit("Update"))).otherwise(F.array(F.lit("Index")))))
        index = F.col("op") == "Index"
        self.store.replace(
            both.select(
                F.lit(self._position).cast("long").alias("raft_index"), F.when(index, 0).otherwise(1).alias("ordinal"), "op", F.col("id").alias("doc_id"),
                "content", "embedding", "metadata", F.when(index, F.col("created_at")).otherwise(F.col("updated_at")).alias("at"),
            )
        )
        self._next = (self.store.log().agg(F.max("doc_id").alias("m")).first().m or 0) + 1
        self.refresh()

    def status(self) -> dict:
        """What there is, and what it runs on."""
        c = self.spark.sparkContext
        return {**self.health(), "path": self.path, "generation": self._generation, "dimensions": self.settings.dim, "metric": self.settings.metric, "spark": c.version, "cores": c.defaultParallelism}

    def health(self) -> dict:
        return {"status": "ok", "documents": self.total(), "applied": self._visible, "pending": self._position - self._visible}
