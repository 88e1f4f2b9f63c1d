"""Vector similarities in double precision.

Against a fixed query vector the sum is written out over the positions, which generated code runs without an array in
between; pairs of columns use higher-order functions. Vectors of different lengths have similarity 0; a null vector or
one with a null in it has a null similarity.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.plans.settings import METRICS, InvalidConfig

#: Longer query vectors are literal arrays under higher-order functions: generated methods have a size limit.
WRITTEN_OUT = 256


def _sum(terms: list[Column]) -> Column:
    """Balanced, so that expressions stay shallow."""
    while len(terms) > 1:
        terms = [reduce(Column.__add__, terms[i : i + 2]) for i in range(0, len(terms), 2)]
    return terms[0] if terms else F.lit(0.0)


def _fold(a: Column, b: Column, f) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double")))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def raw_dot(a: Column, b: Column | Sequence[float]) -> Column:
    if isinstance(b, Column):
        return _fold(a, b, lambda x, y: x * y)
    if len(b) > WRITTEN_OUT:
        return raw_dot(a, F.array(*(F.lit(float(x)) for x in b)))
    return _sum([F.get(a, F.lit(i)).cast("double") * F.lit(float(x)) for i, x in enumerate(b)])


def squared_norm(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))


def distance_squared(a: Column, b: Column | Sequence[float]) -> Column:
    if isinstance(b, Column):
        return _fold(a, b, lambda x, y: (x - y) * (x - y))
    if len(b) > WRITTEN_OUT:
        return distance_squared(a, F.array(*(F.lit(float(x)) for x in b)))
    gaps = [F.get(a, F.lit(i)).cast("double") - F.lit(float(x)) for i, x in enumerate(b)]
    return _sum([g * g for g in gaps])


def _same_length(a: Column, b, value: Column) -> Column:
    size = F.size(b) if isinstance(b, Column) else F.lit(len(b))
    ok = F.when(F.size(a) == size, value).otherwise(F.lit(0.0))
    none = a.isNull() | b.isNull() if isinstance(b, Column) else a.isNull()
    return F.when(none, F.lit(None).cast("double")).otherwise(ok)


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """x within the bounds; null stays null."""
    return F.when(x < low, F.lit(low)).when(x > high, F.lit(high)).otherwise(x)


def cosine(a: Column, b: Column | Sequence[float]) -> Column:
    """Between 0 and 1; 0 where a vector has no length."""
    other = squared_norm(b) if isinstance(b, Column) else F.lit(float(sum(float(x) ** 2 for x in b)))
    norm = F.sqrt(squared_norm(a)) * F.sqrt(other)
    return _same_length(a, b, clamp(F.when(norm == 0, F.lit(0.0)).otherwise(raw_dot(a, b) / norm)))


def euclidean(a: Column, b: Column | Sequence[float]) -> Column:
    """1 / (1 + distance)."""
    return _same_length(a, b, 1 / (1 + F.sqrt(distance_squared(a, b))))


def dot(a: Column, b: Column | Sequence[float]) -> Column:
    return _same_length(a, b, raw_dot(a, b))


def distance(a: Column, b: Column | Sequence[float]) -> Column:
    return F.sqrt(distance_squared(a, b))


def similarity(metric: str, a: Column, b: Column | Sequence[float]) -> Column:
    try:
        return {"cosine": cosine, "euclidean": euclidean, "dot": dot}[metric](a, b)
    except KeyError:
        raise InvalidConfig(f"no metric {metric!r}; there are {METRICS}") from None


def normalized(score: Column, best: Column) -> Column:
    """score / best within 0 and 1; 0 where best is 0."""
    return F.when(best == 0, F.lit(0.0)).otherwise(clamp(score / F.when(best != 0, best)))
