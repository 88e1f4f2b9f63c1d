"""Operator 2: byte-level BPE encoding and decoding.

Pre-tokens are found without a regular expression: every code point gets a class, every class a transition function of a
small automaton, and the functions are composed by a blocked associative scan (composition is a table over the
automaton's transition monoid). The slices between boundaries are looked up by hash in a cache; slices not seen before
are merged pair by pair, many at once. Token offsets are kept, and decoding is a gather over the vocabulary's bytes.

Nothing is shuffled: encoding is one pass of ``mapInArrow`` over the scan.

Defined results: a null text gives null ids; an empty text gives no ids; rows are independent, so that repeated rows give
repeated results and an empty table an empty one; other columns are left alone (a column of the input whose name is taken
by an output column is replaced).
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textops import U64, HashMap, Texts, category_table, chunks, hash_table, lists, mix64, prefix_hash, ragged, slice_hash, tokenizer_file

VOCABULARY = "byte_bpe_50k.tiktoken"

# Classes of code points. The contractions need the letters s t d m, l, v r, e apart from the others.
OTHER, LETTER, NUMBER, SPACE, WHITE, APOS, LS, LL, LV, LR, LE = range(11)
_LETTERS = (LETTER, LS, LL, LV, LR, LE)


class _Automaton:
    """States tell what the pre-token that holds the last code point is; a boundary lies before a code point where
    entering it starts another. Contractions are one token only if the apostrophe starts one; two-letter ones need a
    look at the next code point, which the classes of pairs (class, next class) provide."""

    # states: 0 start of text, 1 other, 2 letters, 3 numbers, 4 blank that joins what follows, 5 white space,
    # 6 apostrophe before a one-letter ending, 7 apostrophe before a two-letter ending, 8 its first letter, 9 closed
    STATES = 10

    def __init__(self) -> None:
        symbols = ["other", "letter", "number", "glue", "lone", "white", "close1", "close2"]
        self.symbol = {s: i for i, s in enumerate(symbols)}
        n = self.STATES
        step = np.zeros((len(symbols), n), np.uint8)
        cut = np.zeros((len(symbols), n), bool)
        for s in range(n):
            for name, i in self.symbol.items():
                if s == 6:  # the next is the one letter of a contraction
                    to, b = 9, False
                elif s == 7:
                    to, b = 8, False
                elif s == 8:
                    to, b = 9, False
                elif name == "other":
                    to, b = 1, s not in (1, 4)
                elif name in ("close1", "close2"):  # an apostrophe that could begin a contraction
                    if s in (1, 4):
                        to, b = 1, False  # it goes on with a run of others
                    else:
                        to, b = (6 if name == "close1" else 7), True
                elif name == "letter":
                    to, b = 2, s not in (2, 4)
                elif name == "number":
                    to, b = 3, s not in (3, 4)
                elif name == "glue":
                    to, b = 4, True
                elif name == "lone":
                    to, b = 9, True
                else:
                    to, b = 5, s != 5
                step[i, s], cut[i, s] = to, b
        self.step, self.cut = step, cut
        # The transition monoid: all functions that words of symbols give, with their composition.
        known: dict[bytes, int] = {}
        elements: list[np.ndarray] = []

        def number(f: np.ndarray) -> int:
            key = f.tobytes()
            if key not in known:
                known[key] = len(elements)
                elements.append(f)
            return known[key]

        self.identity = number(np.arange(n, dtype=np.uint8))
        self.of_symbol = np.array([number(step[i]) for i in range(len(symbols))], np.uint8)
        at = 0
        while at < len(elements):
            for i in range(len(symbols)):
                number(step[i][elements[at]])
            at += 1
        self.size = len(elements)
        assert self.size < 65536
        self.apply = np.stack(elements)
        kind = np.uint8 if self.size <= 256 else np.uint16
        self.then = np.empty((self.size, self.size), kind)
        for a in range(self.size):
            for b in range(self.size):
                self.then[a, b] = known[elements[b][elements[a]].tobytes()]
        self.of_symbol = self.of_symbol.astype(kind)


def scan(f: np.ndarray, then: np.ndarray, identity: int, block: int = 64) -> np.ndarray:
    """Inclusive scan of monoid elements under ``then`` (a composition table): blocks side by side, then their totals."""
    n = len(f)
    if n <= block:
        out = f.copy()
        for i in range(1, n):
            out[i] = then[out[i - 1], f[i]]
        return out
    rows = -(-n // block)
    grid = np.full(rows * block, identity, f.dtype)
    grid[:n] = f
    grid = np.ascontiguousarray(grid.reshape(rows, block).T)
    for j in range(1, block):
        grid[j] = then[grid[j - 1], grid[j]]
    before = np.empty(rows, f.dtype)
    before[0] = identity
    before[1:] = scan(grid[-1], then, identity, block)[:-1]
    return then[before[None, :], grid].T.reshape(-1)[:n]


_state: dict[str, object] = {}


def _automaton() -> _Automaton:
    if "fsm" not in _state:
        _state["fsm"] = _Automaton()
        table = np.array([OTHER, LETTER, NUMBER, WHITE], np.uint8)[category_table()]
        table[32], table[39] = SPACE, APOS
        for c in "stdm":
            table[ord(c)] = LS
        for c, k in (("l", LL), ("v", LV), ("r", LR), ("e", LE)):
            table[ord(c)] = k
        _state["class"] = table
    return _state["fsm"]


def boundaries(t: Texts) -> np.ndarray:
    """Starts of the pre-tokens of all documents, in code points."""
    fsm, n = _automaton(), len(t.cps)
    if not n:
        return np.empty(0, np.int64)
    c = _state["class"][t.cps]
    first = np.zeros(n + 1, bool)
    first[t.off] = True
    first = first[:n]
    nxt, nxt2 = np.zeros(n, np.uint8), np.zeros(n, np.uint8)  # 0 (other) past the end of a document
    nxt[:-1] = c[1:]
    nxt[:-1][first[1:]] = 0
    nxt2[:-1] = nxt[1:]
    nxt2[:-1][first[1:]] = 0
    letter = np.isin(c, _LETTERS)
    sym = np.zeros(n, np.uint8)
    sym[letter] = fsm.symbol["letter"]
    sym[c == NUMBER] = fsm.symbol["number"]
    white = (c == SPACE) | (c == WHITE)
    after = np.zeros(n, bool)  # the next code point of the document is white space
    after[:-1] = white[1:] & ~first[1:]
    ends = np.ones(n, bool)  # it is the document's last
    ends[:-1] = first[1:]
    last = white & ~after & ~ends  # of a run of white space that something follows
    sym[white] = fsm.symbol["white"]
    sym[last] = np.where(c[last] == SPACE, fsm.symbol["glue"], fsm.symbol["lone"])
    apos = c == APOS
    sym[apos & (nxt == LS)] = fsm.symbol["close1"]
    sym[apos & (((nxt == LR) | (nxt == LV)) & (nxt2 == LE) | (nxt == LL) & (nxt2 == LL))] = fsm.symbol["close2"]
    f = fsm.of_symbol[sym]
    # Every document begins in state 0: its first code point's function doesn't depend on the state before.
    reset = _resets(fsm)
    f[first] = reset[sym[first]]
    states = fsm.apply[scan(f, fsm.then, fsm.identity), 0]
    before = np.empty(n, np.uint8)
    before[0] = 0
    before[1:] = states[:-1]
    before[first] = 0
    return np.flatnonzero(fsm.cut[sym, before] | first)


def _resets(fsm: _Automaton) -> np.ndarray:
    """For each symbol the constant function to where state 0 goes; added to the monoid once."""
    if "resets" not in _state:
        n, consts = fsm.STATES, []
        elements = [*fsm.apply]
        known = {e.tobytes(): i for i, e in enumerate(elements)}
        for i in range(len(fsm.step)):
            g = np.full(n, fsm.step[i, 0], np.uint8)
            if g.tobytes() not in known:
                known[g.tobytes()] = len(elements)
                elements.append(g)
            consts.append(known[g.tobytes()])
        at = 0
        while at < len(elements):
            for i in range(len(fsm.step)):
                g = fsm.step[i][elements[at]]
                if g.tobytes() not in known:
                    known[g.tobytes()] = len(elements)
                    elements.append(g)
            at += 1
        kind = np.uint8 if len(elements) <= 256 else np.uint16
        fsm.apply, fsm.size = np.stack(elements), len(elements)
        fsm.then = np.array([[known[b[a].tobytes()] for b in elements] for a in elements], kind)
        fsm.of_symbol = fsm.of_symbol.astype(kind)
        _state["resets"] = np.array(consts, kind)
    return _state["resets"]


class Codec:
    """A vocabulary of byte strings with ranks, its pair table, and the cache of merged slices."""

    def __init__(self, path: str, cache: int = 1 << 21, raw: bytes | None = None):
        lines = (raw or open(path, "rb").read()).splitlines()
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.ranks, self.limit = ranks, cache
        size = max(ranks.values()) + 1
        by = [b""] * size
        for b, i in ranks.items():
            by[i] = b
        self.length = np.array([len(b) for b in by], np.int64)
        self.pool = np.frombuffer(b"".join(by), np.uint8)
        self.start = np.cumsum(self.length) - self.length
        self.byte_id = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        a, b, c = [], [], []
        for token, i in ranks.items():
            for k in range(1, len(token)):
                x, y = ranks.get(token[:k]), ranks.get(token[k:])
                if x is not None and y is not None:
                    a.append(x), b.append(y), c.append(i)
        keys = self._pair(np.array(a), np.array(b))
        order = np.argsort(keys, kind="stable")
        keys, rank = keys[order], np.array(c, np.int32)[order]
        self.pairs = HashMap(int(np.ceil(np.log2(4 * len(keys)))))
        self.pairs.add(keys)
        self.pair_rank = np.append(rank, np.int32(2**31 - 1))
        self.clear()

    @staticmethod
    def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix64((a.astype(U64) << U64(32)) | b.astype(U64))

    def clear(self) -> None:
        self.words, self.ids = HashMap(14), np.empty(1 << 12, np.int32)
        self.used, self.at, self.n = 0, np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        ok = (a >= 0) & (b >= 0)
        out = np.full(a.shape, 2**31 - 1, np.int32)
        out[ok] = self.pair_rank[self.pairs.get(self._pair(a[ok], b[ok]))]
        return out

    def merge(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of the byte slices and their number for each, merged step by step in all slices at once."""
        out: list[np.ndarray | None] = [None] * len(start)
        order = np.argsort(size, kind="stable")
        at = 0
        while at < len(order):
            length = int(size[order[at]])
            to = int(np.searchsorted(size[order], length + length // 8, "right"))
            rows = order[at:to]
            if length > 96:
                for r in rows:
                    out[r] = self._merge_one(data[start[r] : start[r] + size[r]])
                at = to
                continue
            for k in range(0, len(rows), 20000):
                self._merge_grid(data, start, size, rows[k : k + 20000], out)
            at = to
        count = np.array([len(x) for x in out], np.int32)
        return np.concatenate(out) if out else np.empty(0, np.int32), count

    def _merge_grid(self, data, start, size, rows, out) -> None:
        width = int(size[rows].max())
        if not width:
            for r in rows:
                out[r] = np.empty(0, np.int32)
            return
        col = np.arange(width)
        take = start[rows][:, None] + col
        inside = col < size[rows][:, None]
        ids = np.where(inside, self.byte_id[data[np.where(inside, take, 0)]], -1).astype(np.int32)
        rank = np.full(ids.shape, 2**31 - 1, np.int32)
        rank[:, :-1] = self._rank(ids[:, :-1], ids[:, 1:])
        live = np.arange(len(rows))
        whole = ids
        while width > 1:
            j = rank.argmin(1)
            k = np.arange(len(j))
            best = rank[k, j]
            on = best < 2**31 - 1
            if not on.all():
                done = ~on
                whole[live[done], : ids.shape[1]] = ids[done]
                whole[live[done], ids.shape[1] :] = -1
                live, ids, rank, j, best = live[on], ids[on], rank[on], j[on], best[on]
                k = np.arange(len(j))
            if not len(j):
                break
            ids[k, j] = best  # the rank of a pair is the id of what it makes
            w = ids.shape[1]
            shift = np.arange(w - 1)[None, :]
            shift = shift + (shift > j[:, None])
            ids = np.take_along_axis(ids, shift, 1)
            rank = np.take_along_axis(rank, shift, 1)
            if w - 1 > 1:
                right = np.minimum(j + 1, w - 2)
                rank[k, j] = np.where(j + 1 < w - 1, self._rank(ids[k, j], ids[k, right]), 2**31 - 1)
                left = np.maximum(j - 1, 0)
                fresh = self._rank(ids[k, left], ids[k, j])
                rank[k, left] = np.where(j > 0, fresh, rank[k, left])
            else:
                rank[:] = 2**31 - 1
        if len(live):
            whole[live, : ids.shape[1]] = ids
            whole[live, ids.shape[1] :] = -1
        n = (whole >= 0).sum(1)
        flat = whole[whole >= 0]
        for r, x in zip(rows, np.split(flat, np.cumsum(n)[:-1]), strict=True):
            out[r] = x

    def _merge_one(self, data: np.ndarray) -> np.ndarray:
        """The same for a long slice: a heap of pairs over a linked list."""
        ids = self.byte_id[data].tolist()
        n = len(ids)
        nxt, prv, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        by = self.ranks
        text = [bytes([b]) for b in data.tolist()]
        heap = [(by[text[i] + text[i + 1]], i, text[i], text[i + 1]) for i in range(n - 1) if text[i] + text[i + 1] in by]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            if not alive[i] or text[i] != a or (j := nxt[i]) >= n or text[j] != b:
                continue
            text[i], alive[j], nxt[i] = a + b, False, nxt[j]
            ids[i] = rank
            if nxt[j] < n:
                prv[nxt[j]] = i
            for x, y in ((prv[i], i), (i, nxt[i])):
                if x >= 0 and y < n and (m := text[x] + text[y]) in by:
                    heapq.heappush(heap, (by[m], x, text[x], text[y]))
        return np.array([ids[i] for i in range(n) if alive[i]], np.int32)

    def _learn(self, keys: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        ids, count = self.merge(data, start, size)
        n = self.words.n
        while len(self.at) < n + len(keys):
            self.at, self.n = np.append(self.at, np.zeros_like(self.at)), np.append(self.n, np.zeros_like(self.n))
        while len(self.ids) < self.used + len(ids):
            self.ids = np.append(self.ids, np.empty_like(self.ids))
        self.ids[self.used : self.used + len(ids)] = ids
        self.at[n : n + len(keys)] = self.used + np.cumsum(count) - count
        self.n[n : n + len(keys)] = count
        self.used += len(ids)
        self.words.add(keys)

    def encode(self, t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, byte offset of each token in its document, first token of each document and the end)."""
        cut = boundaries(t)
        width = np.ones(len(t.cps), np.int64)
        width += t.cps >= 0x80
        width += t.cps >= 0x800
        width += t.cps >= 0x10000
        byte = np.concatenate(([0], np.cumsum(width)))
        end = np.append(cut[1:], len(t.cps))
        if not len(cut):
            return np.empty(0, np.int32), np.empty(0, np.int32), np.zeros(len(t) + 1, np.int64)
        key = slice_hash(prefix_hash(hash_table()[t.cps]), cut, end) ^ (end - cut).astype(U64)
        data = np.frombuffer(t.raw, np.uint8)
        where = self.words.get(key)
        new = np.flatnonzero(where < 0)
        if len(new):
            if self.words.n > self.limit:
                self.clear()
                new = np.arange(len(key))
            fresh, first = np.unique(key[new], return_index=True)
            s, e = byte[cut[new[first]]], byte[end[new[first]]]
            self._learn(fresh, data, s, e - s)
            where = self.words.get(key) if len(new) == len(key) else where
            where[new] = self.words.get(key[new])
        count = self.n[where].astype(np.int64)
        ids = self.ids[ragged(self.at[where], count)]
        total = np.concatenate(([0], np.cumsum(count)))
        first = total[np.searchsorted(cut, t.off)]
        size = self.length[ids]
        begin = np.cumsum(size) - size
        doc_bytes = byte[t.off]
        # A clash of two slices' hashes would show here as bytes that differ; the slices are then merged themselves.
        if len(begin) and (begin[-1] + size[-1] != len(data) or not np.array_equal(self.bytes_of(ids), data)):
            ids, count = self.merge(data, byte[cut], byte[end] - byte[cut])
            first = np.concatenate(([0], np.cumsum(count)))[np.searchsorted(cut, t.off)]
            size = self.length[ids]
            begin = np.cumsum(size) - size
        return ids, (begin - np.repeat(doc_bytes[:-1], np.diff(first))).astype(np.int32), first

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        return self.pool[ragged(self.start[ids], self.length[ids])]

    def decode(self, ids: np.ndarray, off: np.ndarray) -> pa.Array:
        """Texts of the documents whose tokens lie between the offsets."""
        end = np.concatenate(([0], np.cumsum(self.length[ids])))[off]
        raw = self.bytes_of(ids).tobytes()
        try:
            raw.decode("utf-8")
            return pa.LargeStringArray.from_buffers(len(off) - 1, pa.py_buffer(end.astype(np.int64).tobytes()), pa.py_buffer(raw))
        except UnicodeDecodeError:
            return pa.array([raw[i:j].decode("utf-8", "replace") for i, j in zip(end[:-1], end[1:], strict=True)], pa.large_string())


def codec(path: str, shared=None) -> Codec:
    """The codec of a vocabulary file, kept for the life of the Python worker. ``shared`` is a broadcast of the file, so that it need
    lie on the driver only."""
    if ("codec", path) not in _state:
        _state[("codec", path)] = Codec(path, raw=None if shared is None else shared.value)
    return _state[("codec", path)]


def _shared(spark: SparkSession, path: str):
    """The vocabulary, a few MB, for all tasks."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def _encoded(path: str, shared, batch: pa.RecordBatch, text: str, check: bool) -> Iterator[list[pa.Array]]:
    c, column = codec(path, shared), batch.column(batch.schema.names.index(text))
    valid = np.asarray(pc.is_valid(column))
    for a, b, t in chunks(column):
        ids, at, off = c.encode(t)
        none = ~valid[a:b]
        mask = pa.array(none) if none.any() else None
        of = pa.array(off.astype(np.int32))
        n = pa.array(np.diff(off).astype(np.int32), mask=none)
        if mask is None:
            two = [lists(ids, off, pa.int32()), lists(at, off, pa.int32())]
        else:
            two = [pa.ListArray.from_arrays(of, pa.array(x, pa.int32()), mask=mask) for x in (ids, at)]
        out = [n, *two]
        if check:
            out.append(pa.array(np.asarray(pc.equal(c.decode(ids, off), pc.fill_null(column.slice(a, b - a), "").cast(pa.large_string()))), mask=none))
        yield a, b, out


def encode(docs: DataFrame, text: str = "text", keep: list[str] | None = None, vocabulary: str | None = None, check: bool = False) -> DataFrame:
    """``keep`` columns (all but the text by default) with n_tokens, token_ids and token_offsets (the byte where each token
    begins); ``check`` adds round_trip, true where decoding the ids gives back the text."""
    path = vocabulary or tokenizer_file(VOCABULARY)
    shared = _shared(docs.sparkSession, path)
    added = ["n_tokens", "token_ids", "token_offsets", *(["round_trip"] if check else [])]
    keep = [c for c in (keep if keep is not None else [c for c in docs.columns if c != text]) if c not in added]
    ints = T.ArrayType(T.IntegerType())
    fields = [docs.schema[c] for c in keep] + [T.StructField("n_tokens", T.IntegerType()), T.StructField("token_ids", ints), T.StructField("token_offsets", ints)]
    if check:
        fields.append(T.StructField("round_trip", T.BooleanType()))
    names = [*keep, *added]
    inside = [f"c{i}" for i in range(len(keep))]

    def run(batches):
        for batch in batches:
            for a, b, out in _encoded(path, shared, batch, "t", check):
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(len(keep))), *out], names=[*inside, *added])

    source = docs.select(*(F.col(f"`{c}`").alias(i) for c, i in zip(keep, inside, strict=True)), F.col(text).alias("t"))
    plain = T.StructType([T.StructField(i, f.dataType) for i, f in zip([*inside, *added], fields, strict=True)])
    return source.mapInArrow(run, plain).toDF(*names)


def decode(tokens: DataFrame, ids: str = "token_ids", out: str = "text", vocabulary: str | None = None) -> DataFrame:
    """All columns with ``out``, the text of the ids (null where they are null; bytes that aren't UTF-8 are replaced)."""
    path = vocabulary or tokenizer_file(VOCABULARY)

    shared = _shared(tokens.sparkSession, path)

    @F.pandas_udf(T.StringType())
    def text_of(column):
        c = codec(path, shared)
        import pandas as pd

        valid = column.notna().to_numpy()
        parts = [np.asarray(x, np.int64) if v else np.empty(0, np.int64) for x, v in zip(column, valid, strict=True)]
        off = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)
        got = c.decode(np.concatenate(parts) if parts else np.empty(0, np.int64), off).to_pandas()
        return pd.Series(got).where(pd.Series(valid), None)

    return tokens.withColumn(out, text_of(F.col(ids)))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded, with offsets and the round trip's outcome."""
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), keep=["doc_id"], check=True)


QUERIES = {"op2_bpe": op2_bpe}
ORACLES: dict[str, str] = {}
