"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import ann, bpe, chat, jaccard, langid, linededup, mixing, quality, sharding, syncmers

MODULES = (mixing, bpe, linededup, quality, sharding, syncmers, ann, langid, jaccard, chat)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
