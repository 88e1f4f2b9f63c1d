"""Predicates over documents. All filters of a search must hold; an empty list holds always. They are plain column
predicates, so that they reach the scan."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Filter:
    """Build one by ``tag``, ``source``, ``date_range`` or ``custom``."""

    kind: str
    key: str | None = None
    value: str | None = None
    start: int | None = None
    end: int | None = None

    @classmethod
    def tag(cls, tag: str) -> Filter:
        return cls("tag", value=tag)

    @classmethod
    def source(cls, source: str) -> Filter:
        return cls("source", value=source)

    @classmethod
    def date_range(cls, start: int, end: int) -> Filter:
        """Both ends count; seconds."""
        return cls("date_range", start=start, end=end)

    @classmethod
    def custom(cls, key: str, value: str) -> Filter:
        return cls("custom", key=key, value=value)

    def predicate(self, metadata: str = "metadata", created: str = "created_at") -> Column:
        if self.kind == "tag":
            return F.array_contains(F.col(f"{metadata}.tags"), F.lit(self.value))
        if self.kind == "source":
            return F.col(f"{metadata}.source") == self.value
        if self.kind == "date_range":
            return F.col(created).between(self.start, self.end)
        return F.try_element_at(F.col(f"{metadata}.custom"), F.lit(self.key)) == self.value


def matching(filters: list[Filter], metadata: str = "metadata", created: str = "created_at") -> Column:
    return reduce(lambda a, b: a & b, (f.predicate(metadata, created) for f in filters), F.lit(True))


def apply_filters(docs: DataFrame, filters: list[Filter], metadata: str = "metadata", created: str = "created_at") -> DataFrame:
    return docs.where(matching(filters, metadata, created)) if filters else docs


def restrict(found: DataFrame, docs: DataFrame, filters: list[Filter], id_: str = "id") -> DataFrame:
    """Rows (doc_id, ...) of documents that the filters keep."""
    if not filters:
        return found
    return found.join(apply_filters(docs, filters).select(F.col(id_).alias("doc_id")), "doc_id", "left_semi")
