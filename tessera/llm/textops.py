"""Vectorised text kernel shared by the operators of this subpackage.

A batch of texts becomes one array of code points with document offsets; words, hashes of slices and
character classes are then array operations, so that no Python code runs per character or per word.
"""

from __future__ import annotations

import os
import sys
import unicodedata
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Characters that one pass over the arrays takes at most, unless a single text is longer.
CHUNK_CHARS = 1 << 19

_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]
_tables: dict[str, np.ndarray] = {}

NEWLINE, SPACE = 10, 32


def checkpoint_dir(spark) -> str:
    """The folder that the cluster shares (``spark.checkpoint.dir``). Where none is set, a local master, as in tests, gets one of this
    process; on a cluster that is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    set_already = spark.sparkContext.getCheckpointDir()
    if at is None and set_already is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir names no folder that the cluster shares")
        import atexit
        import shutil
        import tempfile

        own = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        at = f"file://{own}"
    if set_already is None:
        spark.sparkContext.setCheckpointDir(at)
    return at or set_already


def own_folder(spark) -> str:
    """The application's folder in it: what lies there can be deleted once the application has ended."""
    return f"{checkpoint_dir(spark)}/tessera-{spark.sparkContext.applicationId}"


def delete(spark, path: str) -> None:
    """Deletes a folder of tables that nothing reads any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def written(df, spark=None):
    """``df`` as a table in the shared folder, read again: it cuts the lineage and survives the loss of executors."""
    spark = spark or df.sparkSession
    path = f"{own_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def long_id(df, name: str = "doc_id"):
    """The id column as a long; ids of another kind than integers are an error here, not in a task."""
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    kind = df.schema[name].dataType
    if not isinstance(kind, (T.IntegralType, T.NullType)):
        raise ValueError(f"{name} must be of an integer type, not {kind.simpleString()}")
    return F.col(f"`{name}`").cast("long")


def mix64(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 over unsigned 64-bit values."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def _cached(name: str, make) -> np.ndarray:
    if name not in _tables:
        _tables[name] = make()
    return _tables[name]


def _lower(cp: int) -> int:
    low = chr(cp).lower()
    return ord(low) if len(low) == 1 else cp


def lower_table() -> np.ndarray:
    """Code point to its lower case, where that is a single code point."""
    return _cached("lower", lambda: np.fromiter((_lower(c) for c in range(sys.maxunicode + 1)), np.uint32, sys.maxunicode + 1))


def hash_table() -> np.ndarray:
    """A random odd value for each code point."""
    return _cached("hash", lambda: mix64(np.arange(sys.maxunicode + 1, dtype=U64) + U64(0x51ED27)) | U64(1))


def lower_hash_table() -> np.ndarray:
    return _cached("lower_hash", lambda: hash_table()[lower_table()])


def category_table() -> np.ndarray:
    """0 other, 1 letter, 2 number, 3 white space, for each code point."""

    def make():
        out = np.zeros(sys.maxunicode + 1, np.uint8)
        for c in range(sys.maxunicode + 1):
            k = unicodedata.category(chr(c))[0]
            out[c] = 1 if k == "L" else 2 if k == "N" else 0
        for c in [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]:
            out[c] = 3
        return out

    return _cached("category", make)


def word_table() -> np.ndarray:
    """True for letters and numbers."""
    return _cached("word", lambda: (category_table() == 1) | (category_table() == 2))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers 0 .. n-1 of the hash base and of its inverse."""
    if len(_powers[0]) < n:
        size = max(n, CHUNK_CHARS + 64, 2 * len(_powers[0]))
        for k, b in enumerate((_BASE, _INV)):
            p = np.full(size, b, U64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


class Texts:
    """Texts as code points ``cps`` with document offsets ``off`` (one more than documents)."""

    __slots__ = ("cps", "off", "raw", "raw_off")

    def __init__(self, cps: np.ndarray, off: np.ndarray, raw: bytes = b"", raw_off: np.ndarray | None = None):
        self.cps, self.off, self.raw, self.raw_off = cps, off, raw, raw_off

    def __len__(self) -> int:
        return len(self.off) - 1


def _array(texts) -> pa.Array:
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not isinstance(texts, pa.Array):
        texts = pa.array(texts, pa.large_string())
    return pc.fill_null(texts.cast(pa.large_string()), "")


def chunks(texts, chars: int | None = None) -> Iterator[tuple[int, int, Texts]]:
    """(first, last + 1, Texts) for runs of documents of about ``chars`` characters; nulls count as empty."""
    a = _array(texts)
    size = np.asarray(pc.binary_length(a), np.int64)
    at, total = 0, np.concatenate(([0], np.cumsum(size)))
    while at < len(a):
        to = max(at + 1, int(np.searchsorted(total, total[at] + (chars or CHUNK_CHARS), "right")) - 1)
        part = a.slice(at, to - at)
        raw_off = np.concatenate(([0], np.cumsum(size[at:to])))
        start = np.frombuffer(part.buffers()[1], np.int64)[part.offset]
        data = part.buffers()[2]
        raw = data[start : start + int(raw_off[-1])].to_pybytes() if data is not None and raw_off[-1] else b""
        cps = np.frombuffer(raw.decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
        off = np.concatenate(([0], np.cumsum(np.asarray(pc.utf8_length(part), np.int64))))
        if len(cps) != off[-1]:  # bytes that aren't UTF-8: the offsets come from what was decoded
            each = [raw[i:j].decode("utf-8", "replace") for i, j in zip(raw_off[:-1], raw_off[1:], strict=True)]
            cps = np.frombuffer("".join(each).encode("utf-32-le", "surrogatepass"), np.uint32)
            off = np.concatenate(([0], np.cumsum([len(x) for x in each])))
        yield at, to, Texts(cps, off, raw, raw_off)
        at = to


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Prefix sums of values times powers of the base; one more entry than values."""
    p = np.empty(len(values) + 1, U64)
    p[0] = 0
    np.cumsum(values * powers(len(values) + 1)[0][: len(values)], out=p[1:])
    return p


def slice_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the slices, wherever they lie."""
    return mix64((prefix[end] - prefix[start]) * powers(len(prefix))[1][start])


def runs(mask: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True that don't cross a document's edge."""
    n = len(mask)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    first = np.empty(n, bool)
    first[0] = True
    np.logical_not(mask[:-1], out=first[1:])
    inner = off[1:-1]
    first[inner[inner < n]] = True
    first &= mask
    last = np.empty(n, bool)
    last[-1] = True
    np.logical_not(mask[1:], out=last[:-1])
    inner = inner[inner > 0]
    last[inner - 1] = True
    last &= mask
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def words(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of the lower-case word, start, end, words before each document) of all runs of letters and numbers."""
    start, end = runs(word_table()[t.cps], t.off)
    h = slice_hash(prefix_hash(lower_hash_table()[t.cps]), start, end)
    return h, start, end, np.searchsorted(start, t.off)


def ragged(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... (count[0] of them), start[1], ..."""
    total = int(count.sum())
    out = np.ones(total, np.int64)
    if not total:
        return out
    some = count > 0
    s, c = start[some], count[some]
    head = np.cumsum(c) - c
    out[head] = s
    out[head[1:]] -= s[:-1] + c[:-1] - 1
    return np.cumsum(out)


def lists(values: np.ndarray, off: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """An Arrow list array without copying values."""
    return pa.ListArray.from_arrays(pa.array(off.astype(np.int32), pa.int32()), pa.array(values, kind))


class HashMap:
    """Open-addressing map of 64-bit keys to positions of insertion, looked up by whole arrays."""

    def __init__(self, bits: int = 12):
        self._grow(bits)
        self.n = 0

    def _grow(self, bits: int) -> None:
        self.bits = bits
        self.keys = np.zeros(1 << bits, U64)
        self.vals = np.full(1 << bits, -1, np.int32)

    def get(self, k: np.ndarray) -> np.ndarray:
        """Positions, -1 where absent."""
        mask = (1 << self.bits) - 1
        at = (k >> U64(64 - self.bits)).astype(np.int64)
        out = self.vals[at]
        open_ = np.flatnonzero((self.keys[at] != k) & (out >= 0))
        at = at[open_]
        while len(open_):
            at = (at + 1) & mask
            v = self.vals[at]
            hit = (self.keys[at] == k[open_]) | (v < 0)
            out[open_[hit]] = v[hit]
            open_, at = open_[~hit], at[~hit]
        return out

    def _place(self, k: np.ndarray, v: np.ndarray) -> None:
        mask = (1 << self.bits) - 1
        at = (k >> U64(64 - self.bits)).astype(np.int64)
        todo = np.arange(len(k))
        while len(todo):
            a = at[todo]
            free = self.vals[a] < 0
            first = np.zeros(len(todo), bool)
            first[np.unique(a, return_index=True)[1]] = True
            win = free & first
            self.keys[a[win]] = k[todo[win]]
            self.vals[a[win]] = v[todo[win]]
            todo = todo[~win]
            at[todo] = (at[todo] + 1) & mask

    def add(self, k: np.ndarray) -> None:
        """Distinct keys that aren't there yet get the next positions."""
        v = np.arange(self.n, self.n + len(k), dtype=np.int32)
        while (self.n + len(k)) * 2 > 1 << self.bits:
            keys, vals = self.keys[self.vals >= 0], self.vals[self.vals >= 0]
            self._grow(self.bits + 1)
            self._place(keys, vals)
        self._place(k, v)
        self.n += len(k)


def tokenizer_file(name: str, folder: str | None = None) -> str:
    return os.path.join(folder or "/opt/tokenizers", name)
