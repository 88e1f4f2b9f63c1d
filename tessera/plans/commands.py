"""Commands as values: what they are called, whether they change documents, and their rows in the changelog."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Name of each kind, and whether it changes documents.
KINDS = {
    "IndexDocument": True, "UpdateDocument": True, "DeleteDocument": True, "BatchIndex": True, "BatchDelete": True,
    "OptimizeIndex": False, "CompactIndex": False, "UpdateSettings": False,
}
_OPS = {"Index": "IndexDocument", "Update": "UpdateDocument", "Delete": "DeleteDocument"}


@dataclass(frozen=True)
class Change:
    """The fields that an update sets; those that are None stay as they are."""

    content: str | None = None
    embedding: Sequence[float] | None = None
    metadata: dict | None = None

    def having(self, **fields: Any) -> Change:
        """The same with further fields set."""
        return replace(self, **fields)

    @property
    def empty(self) -> bool:
        return self.content is None and self.embedding is None and self.metadata is None

    def applied(self, doc: dict, at: int) -> dict:
        """The document with the change made at a time."""
        new = {k: v for k, v in (("content", self.content), ("embedding", self.embedding), ("metadata", self.metadata)) if v is not None}
        return {**doc, **new, "updated_at": at}


@dataclass(frozen=True)
class Command:
    name: str
    ids: tuple[int, ...] = ()
    documents: tuple[dict, ...] = ()
    change: Change = field(default_factory=Change)
    settings: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.name not in KINDS:
            raise ValueError(f"no command {self.name!r}")

    @property
    def modifies_documents(self) -> bool:
        return KINDS[self.name]


def name_of(op: Column) -> Column:
    """The command's name by the changelog's op; null for what is no command."""
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in _OPS.items() for x in kv)), op)


def modifies(name: Column) -> Column:
    return F.coalesce(name.isin(*(k for k, v in KINDS.items() if v)), F.lit(False))
