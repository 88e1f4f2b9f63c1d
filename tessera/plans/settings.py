"""Settings and errors."""

from __future__ import annotations

from dataclasses import dataclass, field


class EngineError(Exception):
    """Base of all errors of the engine."""


class BadRequest(EngineError):
    """A search that lacks what its mode needs."""


class DocumentNotFound(EngineError):
    """An update or a look-up of a document that isn't there."""


class InvalidEmbeddingDimensions(EngineError):
    """A vector of another length than the settings say."""


class IndexNotReady(EngineError):
    """The index didn't reach the wanted position in time."""


class UnsupportedSnapshot(EngineError):
    """A snapshot written by a later version."""


class InvalidConfig(EngineError, ValueError):
    """Settings that contradict each other."""


@dataclass(frozen=True)
class TokenizerConfig:
    """Text analysis. ``mode``: 'simple' (runs of letters and digits, wholly in the JVM) or 'uax29' (Unicode words)."""

    lowercase: bool = True
    remove_stopwords: bool = False
    stem: bool = False
    min_len: int = 2
    max_len: int = 50
    mode: str = "simple"
    stopwords: tuple[str, ...] | None = None

    def __post_init__(self):
        if self.mode not in ("simple", "uax29"):
            raise InvalidConfig(f"no tokenizer mode {self.mode!r}")
        if self.min_len > self.max_len:
            raise InvalidConfig("min_len is above max_len")


@dataclass(frozen=True)
class Bm25Params:
    k1: float = 1.2
    b: float = 0.75
    delta: float = 1.0


@dataclass(frozen=True)
class PqConfig:
    """Product quantization: ``m`` subspaces of ``centroids`` each (at most 256, one byte a code)."""

    m: int = 8
    centroids: int = 256
    max_iter: int = 100
    tol: float = 1e-6
    init_sample: int = 20_000

    def check(self, dim: int) -> None:
        if self.m <= 0 or dim % self.m:
            raise InvalidConfig(f"{dim} dimensions can't be cut into {self.m} subspaces")
        if not 0 < self.centroids <= 256:
            raise InvalidConfig("a subspace has 1 to 256 centroids")


METRICS = ("cosine", "euclidean", "dot")


@dataclass(frozen=True)
class Settings:
    dim: int = 384
    metric: str = "cosine"
    tokenizer: TokenizerConfig = field(default_factory=TokenizerConfig)
    bm25: Bm25Params = field(default_factory=Bm25Params)
    pq: PqConfig = field(default_factory=lambda: PqConfig(m=24))
    approximate: bool = False

    def __post_init__(self):
        if self.metric not in METRICS:
            raise InvalidConfig(f"no metric {self.metric!r}")
        if self.dim <= 0:
            raise InvalidConfig("a vector has one dimension at least")


PROFILES = {"low-latency": PqConfig(m=48), "balanced": PqConfig(m=24), "high-throughput": PqConfig(m=12)}
