"""Operator 5: sharding by histogram sort.

Rows are cut into shards of even bytes along the order of a key. Splitters are found by counting: all partitions count the
exact bytes below each candidate boundary, the driver keeps the interval that holds each target, and new candidates (keys
drawn by hash within the open intervals) refine it, until every splitter's count is within the tolerance of its target or
its interval holds a single key. Then the rows are exchanged once, straight to their shard, and sorted there.

The counting passes read a table of (key, bytes) alone, written once. The driver holds a few candidates for each shard
(about 100 bytes each; at 1 GB a shard, 100 TB make 100,000 shards).

Defined results: keys compare column by column, null before all else, numbers, dates and times by value (NaN above all, minus
zero as zero), text by its bytes; a column of another kind is an error; rows are told apart within equal
keys by a hash of the text, so only repeated rows can't be parted and share a shard; a null text has 0 bytes; a key heavier
than a shard makes that shard too large, and shards may then be empty; an empty table gives no rows. A column of the
input called shard is replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textops import written

SHARD_BYTES = 32 << 20
TOLERANCE = 0.02
CANDIDATES = 16


@F.pandas_udf(T.LongType())
def _float_order(x: pd.Series) -> pd.Series:
    """Longs that order as the numbers do: minus zero is zero, NaN is above all."""
    v = x.to_numpy(float, na_value=np.nan) + 0.0
    bits = np.where(np.isnan(v), np.nan, v).view(np.int64)
    bits = np.where(np.isnan(v), np.int64(0x7FF8000000000000), bits)
    return pd.Series(bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF)))


def _code(df: DataFrame, c: str) -> Column:
    """A hexadecimal string that orders as a column's values do."""
    kind, x = df.schema[c].dataType, F.col(f"`{c}`")
    if isinstance(kind, T.BooleanType):
        x = x.cast("int")
    elif isinstance(kind, T.DateType):
        x = F.unix_date(x)
    elif isinstance(kind, T.TimestampType):
        x = F.unix_micros(x)
    elif isinstance(kind, T.TimestampNTZType):
        x = F.unix_micros(F.to_utc_timestamp(x, "UTC"))
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        x = _float_order(x.cast("double"))
    elif isinstance(kind, T.DecimalType):
        digits = F.lpad(F.replace(F.format_number(F.abs(x), kind.scale), F.lit(","), F.lit("")), kind.precision + 2, "0")
        turned = F.translate(digits, "0123456789", "9876543210")
        return F.hex(F.encode(F.when(x < 0, F.concat(F.lit("0"), turned)).otherwise(F.concat(F.lit("1"), digits)), "UTF-8"))
    elif isinstance(kind, T.BinaryType):
        # zero bytes become 00 01, so that 00 00 ends a value
        return F.concat(F.replace(F.regexp_replace(F.regexp_replace(F.hex(x), "(..)", "$1."), r"00\.", "0001."), F.lit("."), F.lit("")), F.lit("0000"))
    elif isinstance(kind, T.StringType):
        return F.concat(F.hex(F.encode(F.replace(x, F.lit("\0"), F.lit("\0\x01")), "UTF-8")), F.lit("0000"))
    elif not isinstance(kind, T.IntegralType):
        raise ValueError(f"no order for {c}, of type {kind.simpleString()}")
    return F.lpad(F.hex(x.cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")


def sort_key(df: DataFrame, by: list[str], text: str = "text") -> Column:
    """A hexadecimal string that orders as the columns do, with a hash of the text at its end."""
    parts = [F.when(F.col(f"`{c}`").isNull(), F.lit("00")).otherwise(F.concat(F.lit("01"), _code(df, c))) for c in by]
    return F.concat(*parts, F.lpad(F.hex(F.xxhash64(f"`{text}`")), 16, "0"))


def _bytes(column) -> np.ndarray:
    """Fixed-width bytes of a column of ASCII strings."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.empty(0, "S1")
    width = max(1, pc.max(pc.binary_length(column)).as_py())
    wide = pc.ascii_rpad(column.cast(pa.string()), width, "\0").cast(pa.binary()).cast(pa.binary(width))
    return np.frombuffer(wide.buffers()[1], f"S{width}", len(wide), wide.offset * width)


def _at(bounds: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """How many bounds lie at or below each key."""
    width = max(bounds.dtype.itemsize, keys.dtype.itemsize)
    return np.searchsorted(bounds.astype(f"S{width}"), keys.astype(f"S{width}"), "right")


def counts_below(sizes: DataFrame, probes: np.ndarray) -> np.ndarray:
    """Exact bytes of the rows below each probe (sorted keys)."""

    def run(batches):
        total = np.zeros(len(probes) + 1, np.int64)
        for b in batches:
            if b.num_rows:
                np.add.at(total, _at(probes, _bytes(b.column(0))), np.asarray(b.column(1), np.int64))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["i", "n"])

    found = sizes.select("k", "n").mapInArrow(run, "i long, n long").groupBy("i").agg(F.sum("n")).collect()
    total = np.zeros(len(probes) + 1, np.int64)
    for i, n in found:
        total[i] = n
    return np.cumsum(total)[: len(probes)]


def draw(sizes: DataFrame, bounds: np.ndarray, wanted: np.ndarray, each: int, salt: int) -> np.ndarray:
    """Up to ``each`` keys of each wanted interval between bounds (interval i begins at bound i - 1), chosen by hash."""

    def run(batches):
        best: dict[int, list[tuple[int, bytes]]] = {}
        for b in batches:
            if not b.num_rows:
                continue
            keys = np.unique(_bytes(b.column(0)))
            at = _at(bounds, keys) if len(bounds) else np.zeros(len(keys), np.int64)
            starts = np.zeros(len(keys), bool) if not len(bounds) else np.isin(keys, bounds)
            ok = np.isin(at, wanted) & ~starts
            keys, at = keys[ok], at[ok]
            h = np.fromiter((hash_bytes(k, salt) for k in keys), np.uint64, len(keys))
            order = np.lexsort((h, at))
            first = np.searchsorted(at[order], at[order])
            for i in order[np.arange(len(order)) - first < each]:
                best.setdefault(int(at[i]), []).append((int(h[i]), bytes(keys[i])))
        rows = [(i, k.decode()) for i, x in best.items() for _, k in sorted(x)[:each]]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], names=["i", "k"])

    from pyspark.sql import Window

    found = sizes.select("k", "n").mapInArrow(run, "i long, k string").distinct()
    w = Window.partitionBy("i").orderBy(F.xxhash64(F.lit(salt), "k"), "k")
    rows = found.withColumn("r", F.row_number().over(w)).where(F.col("r") <= each).select("k").collect()
    return np.array(sorted(r[0].encode() for r in rows), dtype="S") if rows else np.empty(0, "S1")


def first_draw(sizes: DataFrame, rows: int, each: int) -> np.ndarray:
    """About ``each`` keys of the whole, those whose hash falls below a bound: nothing is ranked and no task sees them all."""
    grain = 1 << 40
    bound = -(-grain * each // max(1, rows))
    found = sizes.where(F.pmod(F.xxhash64(F.lit(0), "k"), F.lit(grain)) < bound).select("k").distinct().toArrow()
    return np.unique(_bytes(found.column("k")))


def hash_bytes(b: bytes, salt: int) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(b, salt)


def splitters(sizes: DataFrame, shards: int, total: int, rows: int, tolerance: float = TOLERANCE) -> np.ndarray:
    """Up to shards - 1 keys, each the first of its shard."""
    if shards < 2:
        return np.empty(0, "S1")
    target = np.arange(1, shards) * (total / shards)
    slack = tolerance * total / shards
    known: dict[bytes, int] = {}
    probes, turn = first_draw(sizes, rows, CANDIDATES * shards), 0
    if not len(probes):
        probes = draw(sizes, np.empty(0, "S1"), np.array([0]), CANDIDATES, 0)
    while len(probes):
        for k, n in zip(probes, counts_below(sizes, probes), strict=True):
            known[bytes(k)] = int(n)
        keys = np.array(sorted(known), dtype="S")
        below = np.array([known[bytes(k)] for k in keys])
        hi = np.searchsorted(below, target, "left")  # first key with as many bytes below as the target
        near = np.minimum(np.abs(below[np.minimum(hi, len(keys) - 1)] - target), np.abs(below[np.maximum(hi - 1, 0)] - target))
        open_ = np.unique(hi[near > slack])
        if not len(open_):
            break
        turn += 1
        probes = draw(sizes, keys, open_, CANDIDATES, turn)  # none where the interval holds its first key only
    if not known:
        return np.empty(0, "S1")
    out, at = [], 0
    for t, h in zip(target, hi, strict=True):
        a, b = max(h - 1, 0), min(h, len(keys) - 1)
        at = max(at, a if abs(below[a] - t) <= abs(below[b] - t) else b)
        out.append(keys[at])
    return np.array(out, dtype="S")


def shard(docs: DataFrame, by: list[str], shard_bytes: int = SHARD_BYTES, tolerance: float = TOLERANCE, text: str = "text") -> DataFrame:
    """The rows with ``shard`` (0, 1, ...), each shard in one partition in the order of its keys. A row travels as one, whatever
    its columns are called."""
    key, rest = sort_key(docs, by, text), [c for c in docs.columns if c != "shard"]
    sizes = written(docs.select(key.alias("k"), F.coalesce(F.octet_length(f"`{text}`"), F.lit(0)).cast("long").alias("n")))
    n_rows, total = sizes.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    shards = max(1, -(-total // shard_bytes))
    bounds = splitters(sizes, shards, total, n_rows, tolerance)

    @F.pandas_udf("int")
    def shard_of(k):
        keys = _bytes(pa.array(k, pa.string()))
        return pd.Series((_at(bounds, keys) if len(bounds) else np.zeros(len(keys), np.int64)).astype(np.int32))

    rows = docs.select(F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in rest)).alias("row"), key.alias("key")).withColumn("shard", shard_of("key"))
    rows = rows.repartitionById(int(shards), F.col("shard")).sortWithinPartitions("shard", "key")
    return rows.select("shard", *(F.col("row")[c].alias(c) for c in rest))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in even shards along source and doc_id."""
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"), ["source", "doc_id"])


QUERIES = {"op5_sharding": op5_sharding}
ORACLES: dict[str, str] = {}
