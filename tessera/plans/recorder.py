"""An engine that records what is done to it, in the form that the history checks read."""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import DataFrame

from tessera.operators.invariants import HISTORY
from tessera.plans.engine import Engine, SearchRequest, SearchResponse
from tessera.plans.settings import DocumentNotFound, EngineError


class Recorder:
    """Passes calls on to an engine; failed ones are recorded too, and raise as they would."""

    def __init__(self, engine: Engine):
        self.engine, self.rows = engine, []

    def _run(self, op: str, call, doc_id: int | None = None, doc_ids: list[int] | None = None, query: str | None = None, seen=None):
        began, ok, out = time.time_ns(), True, None
        try:
            out = call()
            return out
        except EngineError:
            ok = False
            raise
        finally:
            ids, found, position = seen(out) if seen and ok else (doc_ids, None, None)
            self.rows.append((len(self.rows) + 1, op, doc_id, ids, query, began, time.time_ns(), ok, found, position))

    def index(self, docs: Sequence[dict]) -> list[int]:
        return self._run("BatchIndex", lambda: self.engine.index(docs), seen=lambda ids: (ids, None, self.engine._position))

    def update(self, doc_id: int, **fields) -> int:
        return self._run("Update", lambda: self.engine.update(doc_id, **fields), doc_id, seen=lambda p: (None, None, p))

    def delete(self, ids: Sequence[int]) -> int:
        return self._run("BatchDelete", lambda: self.engine.delete(ids), seen=lambda p: (list(ids), None, p))

    def get(self, doc_id: int) -> dict | None:
        """The document, None where there is none."""

        def call():
            try:
                return self.engine.get(doc_id)
            except DocumentNotFound:
                return None

        return self._run("Get", call, doc_id, seen=lambda d: (None, d is not None, None))

    def search(self, request: SearchRequest) -> SearchResponse:
        """Recording the results runs the search (k rows)."""
        return self._run("Search", lambda: self.engine.search(request), query=request.query, seen=lambda r: ([x.doc_id for x in r.results.select("doc_id").collect()], None, None))

    def history(self) -> DataFrame:
        return self.engine.spark.createDataFrame(self.rows, HISTORY)
