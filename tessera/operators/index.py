"""The inverted index as tables.

``postings (term, doc_id, tf, doc_len[, positions])``, ``doc_stats (doc_id, doc_len)``, ``terms (term, df, total_tf)`` and one row of
``stats (n, total_len, avgdl)``. Saved postings and terms are sorted by term, so that a look-up of a few terms reads only
the row groups that hold them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tessera.functions.text import Cutter, letters, tokens
from tessera.plans.settings import TokenizerConfig
from tessera.sources.scratch import written


def tokenized(docs: DataFrame, cfg: TokenizerConfig | None = None, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, tokens)."""
    return docs.select(F.col(id_).alias("doc_id"), tokens(F.col(text), cfg).alias("tokens"))


def texts(docs: DataFrame, cfg: TokenizerConfig | None = None, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text) where the task that counts a document's terms can cut its text too, so that no tokens move to it; else as
    ``tokenized``. For ``postings`` and ``analysed``."""
    if (cfg or TokenizerConfig()).mode != "simple":
        return tokenized(docs, cfg, id_, text)
    return docs.select(F.col(id_).alias("doc_id"), F.col(text).alias("text"))


#: Tokens that are counted at once, which bounds a task's memory, and bytes of a text that count as a token; a single document may have more.
SLICE, TOKEN_BYTES = 1 << 21, 4


def postings(tok: DataFrame, positions: bool = False, lengths: bool = False, by: tuple[str, ...] = (), cfg: TokenizerConfig | None = None, repeated: bool | None = None) -> DataFrame:
    """One row for each term of each document; positions count from 0. With ``lengths`` the document's length stands in each row, so
    that scores need no join; ``by`` names further columns of ``tok`` that go with a document. ``cfg`` is for a frame of
    ``texts``; ``repeated`` says whether ids are, where that is known.

    A document's terms are counted in the task that analyses it, so nothing is exchanged; only where ids are repeated, which a look
    at the ids alone shows, are rows of one id brought together."""
    if _repeated(tok, by) if repeated is None else repeated:
        return _grouped(_with_tokens(tok, cfg), positions, lengths, by)
    found = _counted(tok, positions, by, False, cfg)
    return found.select("term", "doc_id", *by, "tf", *["doc_len"] * lengths, *["positions"] * positions)


def analysed(tok: DataFrame, positions: bool = False, by: tuple[str, ...] = (), cfg: TokenizerConfig | None = None, repeated: bool | None = None) -> tuple[DataFrame, DataFrame]:
    """(postings with lengths, lengths) as a table in the shared folder, from one analysis of the texts. A document's length is a
    row without a term."""
    more = ["positions"] * positions
    if _repeated(tok, by) if repeated is None else repeated:
        tok = _with_tokens(tok, cfg)
        return written(_grouped(tok, positions, True, by)), written(tok.select(*by, "doc_id", F.size("tokens").cast("long").alias("doc_len")))
    both = written(_counted(tok, positions, by, True, cfg))
    return both.where("term IS NOT NULL").select("term", "doc_id", *by, "tf", "doc_len", *more), both.where("term IS NULL").select(*by, "doc_id", "doc_len")


def _repeated(tok: DataFrame, by: tuple[str, ...]) -> bool:
    return not tok.groupBy("doc_id", *by).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()


def _with_tokens(tok: DataFrame, cfg: TokenizerConfig | None) -> DataFrame:
    return tok if "tokens" in tok.columns else tok.withColumn("tokens", tokens(F.col("text"), cfg)).drop("text")


def _grouped(tok: DataFrame, positions: bool, lengths: bool, by: tuple[str, ...]) -> DataFrame:
    """Postings where several rows may have one id."""
    more = [F.count(F.lit(1)).alias("tf")]
    if lengths:
        more.append(F.max("doc_len").alias("doc_len"))
    if positions:
        more.append(F.sort_array(F.collect_list("pos")).alias("positions"))
    term = F.posexplode("tokens").alias("pos", "term") if positions else F.explode("tokens").alias("term")
    length = [F.size("tokens").cast("long").alias("doc_len")] if lengths else []
    return tok.select("doc_id", *by, *length, term).groupBy("term", "doc_id", *by).agg(*more)


def _counted(tok: DataFrame, positions: bool, by: tuple[str, ...], documents: bool, cfg: TokenizerConfig | None = None) -> DataFrame:
    """Postings of rows with ids of their own; with ``documents`` a row without a term for each document too. Those of a slice come in the
    order of ``by``, term and document, so that a sort of a task's rows merges few runs, and pages of a table can be skipped."""
    rows, made = _rows(tok, by, cfg)
    fields = [T.StructField("term", T.StringType()), *rows.schema.fields[1:], T.StructField("tf", T.LongType()), T.StructField("doc_len", T.LongType())]
    if positions:
        fields.append(T.StructField("positions", T.ArrayType(T.IntegerType())))
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, size, _, words, kind, row, first, pos in _slices(batches, made, positions):
            cols = [words.take(pa.array(kind)), *(c.take(pa.array(row)) for c in own), pa.array(np.diff(first)), pa.array(size[row])]
            if positions:
                cols.append(pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(pos)))
            yield pa.RecordBatch.from_arrays(cols, names=names)
            if documents:
                none = [pa.nulls(len(size), c.type) for c in cols]
                yield pa.RecordBatch.from_arrays([none[0], *own, none[1 + len(own)], pa.array(size), *none[3 + len(own) :]], names=names)

    return rows.mapInArrow(run, T.StructType(fields))


def _rows(tok: DataFrame, by: tuple[str, ...], cfg: TokenizerConfig | None) -> tuple[DataFrame, tuple | None]:
    """(texts or tokens, ids and ``by``), and of what a task makes a ``Cutter`` for texts."""
    whole = "tokens" not in tok.columns
    return tok.select("text" if whole else "tokens", "doc_id", *by), (cfg or TokenizerConfig(), letters()) if whole else None


def _slices(batches: Iterator[pa.RecordBatch], made: tuple | None, positions: bool = False) -> Iterator[tuple]:
    """Of each slice the ids and ``by``, the documents' lengths and their order, the terms in order, of each posting its term and document, as
    places, where its tokens begin (and the end of all), and the tokens' positions."""
    cut = Cutter(*made) if made else None
    for b in batches:
        off, at = np.append(0, np.cumsum(np.asarray(pc.fill_null((pc.binary_length if cut else pc.list_value_length)(b.column(0)), 0), np.int64))), 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + SLICE * (TOKEN_BYTES if cut else 1), "right")) - 1)
            n = to - at
            code, found, size = (cut or _coded)(b.column(0).slice(at, n))
            own = [b.column(i).slice(at, n) for i in range(1, b.num_columns)]
            by_term, by_row, group = _sorted(found), *_ordered(own)
            words = found.take(pa.array(by_term))
            kinds = max(1, len(words))
            # a row's group, a term's place and a row's place, in one number
            key = ((group * kinds)[np.repeat(np.arange(n), size)] + _places(by_term)[code]) * n + np.repeat(_places(by_row), size)
            pos = None
            if positions:
                order = np.argsort(key, kind="stable")
                key = key[order]
                start = np.cumsum(size) - size
                pos = (order - np.repeat(start, size)[order]).astype(np.int32)
            else:
                key.sort()
            first = np.flatnonzero(np.diff(key, prepend=-1))
            kind, row = np.divmod(key[first], n)
            yield own, size, by_row, words, kind % kinds, by_row[row], np.append(first, len(key)), pos
            at = to


def _coded(tokens: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(the place of each token among the terms, the terms, the number of tokens of each text)."""
    code = tokens.flatten().dictionary_encode()
    return np.asarray(code.indices, np.int64), code.dictionary, np.asarray(pc.fill_null(pc.list_value_length(tokens), 0), np.int64)


def _places(order) -> np.ndarray:
    """The place of each row in an order."""
    place = np.empty(len(order), np.int64)
    place[np.asarray(order, np.int64)] = np.arange(len(order))
    return place


def _sorted(words: pa.Array) -> np.ndarray:
    """The order of strings without nulls by their bytes: by the first eight as a number, and by all only where these are equal."""
    n, words = len(words), words.cast(pa.string())
    off = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    data = words.buffers()[2]
    buf = np.append(np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), np.zeros(8, np.uint8))
    first = np.ndarray(len(buf) - 7, ">u8", buf.data, 0, (1,))[off[:-1]].astype(np.uint64)
    size = np.diff(off)
    first = np.where(size > 0, first & ~np.where(size < 8, np.uint64(2**64 - 1) >> np.minimum(8 * size, 63).astype(np.uint64), np.uint64(0)), np.uint64(0))
    order = np.argsort(first)
    first = first[order]
    same = np.zeros(n + 1, bool)
    same[1:-1] = first[1:] == first[:-1]
    same = np.flatnonzero(same[1:] | same[:-1])
    order[same] = order[same][np.asarray(pc.sort_indices(words.take(pa.array(order[same]))))]
    return order


def _ordered(keys: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows by all but the first key and then by the first, and for each row the place of its group among those of equal
    other keys."""
    t = pa.table({str(i): c for i, c in enumerate(keys)})
    others = [(str(i), "ascending") for i in range(1, len(keys))]
    order = np.asarray(pc.sort_indices(t, [*others, ("0", "ascending")], null_placement="at_start"), np.int64)
    new = np.zeros(len(order), bool)
    for i in range(1, len(keys)):
        code = np.asarray(keys[i].dictionary_encode(null_encoding="encode").indices, np.int64)[order]
        new[1:] |= code[1:] != code[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new)
    return order, group


#: Postings that a task sorts, on average, at most.
SORTED = 1 << 21


def by_range(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """``n`` rows in ranges of the first column, each sorted. Where as many parts of an exchange as are set would be too large to be sorted in
    memory, there are more of them; adaptive execution merges small ones but makes no more."""
    parts = -(-n // SORTED)
    more = (parts,) if parts > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else ()
    return rows.repartitionByRange(*more, order[0]).sortWithinPartitions(*order)


def doc_stats(tok: DataFrame) -> DataFrame:
    return tok.select("doc_id", F.size("tokens").cast("long").alias("doc_len"))


def corpus_stats(stats: DataFrame) -> DataFrame:
    """(n, total_len, avgdl) in one row; avgdl is 0 for an empty corpus."""
    s = stats.agg(F.count("doc_id").alias("n"), F.coalesce(F.sum("doc_len"), F.lit(0)).alias("total_len"))
    return s.withColumn("avgdl", F.when(F.col("n") > 0, F.col("total_len") / F.col("n")).otherwise(F.lit(0.0)))


def terms(post: DataFrame) -> DataFrame:
    """(term, df, total_tf)."""
    return post.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total_tf"))


def partial_stats(stats: DataFrame, segment: Column) -> DataFrame:
    """Statistics of each segment (segment, n, total_len), to be summed by ``merged_stats``."""
    return stats.groupBy(segment.alias("segment")).agg(F.count(F.lit(1)).alias("n"), F.sum("doc_len").alias("total_len"))


def merged_stats(parts: DataFrame) -> DataFrame:
    s = parts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("total_len"), F.lit(0)).alias("total_len"))
    return s.withColumn("avgdl", F.when(F.col("n") > 0, F.col("total_len") / F.col("n")).otherwise(F.lit(0.0)))


def term_id(term: Column) -> Column:
    """A 64-bit hash that stands for a term."""
    return F.xxhash64(term)


def prefix(dictionary: DataFrame, start: str) -> DataFrame:
    """Terms that begin with ``start``, in order; the filter reaches the scan."""
    return dictionary.where(F.col("term").startswith(start)).orderBy("term")


def first_at_or_after(post: DataFrame, term: str, target: int) -> DataFrame:
    """The first posting of the term whose document isn't before ``target``."""
    return post.where((F.col("term") == term) & (F.col("doc_id") >= target)).orderBy("doc_id").limit(1)


def without(df: DataFrame, tombstones: DataFrame | None, id_: str = "doc_id") -> DataFrame:
    """Rows whose document isn't deleted. The join is left to the planner, which knows both sides' sizes."""
    if tombstones is None:
        return df
    return df.join(tombstones.select(F.col("doc_id").alias(id_)).distinct(), id_, "left_anti")


#: Postings of a block, rows of a page of blocks, and postings that are handed on at once.
BLOCK, PAGE, ROWS = 1 << 14, 4, 1 << 17
BLOCKS = "low string, high string, base long, documents binary, dictionary binary, lists binary"


class Blocks:
    """Postings as a table in the shared folder, packed: a row holds up to ``BLOCK`` postings of consecutive terms of a slice. Its
    ``dictionary`` has these terms and how many documents and tokens each has here, its ``lists`` the postings (ids count from ``base``, if there is one), and ``low`` and ``high`` are the first and the last
    term, by which a look-up skips blocks. A slice's first row has the lengths of its ``documents`` too."""

    def __init__(self, tok: DataFrame, cfg: TokenizerConfig | None = None):
        """``tok`` has an id once."""
        rows, made = _rows(tok, (), cfg)
        self.id = rows.schema["doc_id"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = [x.split()[0] for x in BLOCKS.split(", ")]
            for (ids,), size, _, words, kind, row, first, _ in _slices(batches, made):
                tf, base, near, length = _narrow(np.diff(first)), *_near(ids), _narrow(size)
                out = []
                for a in range(0, max(1, len(kind)), BLOCK):
                    k, r, f = kind[a : a + BLOCK], row[a : a + BLOCK], tf[a : a + BLOCK]
                    at = np.flatnonzero(np.diff(k, prepend=-1))
                    t = words.take(pa.array(k[at]))
                    own = near.take(pa.array(r)) if base is None else near[r]
                    sums = np.add.reduceat(f, at, dtype=np.int64) if len(at) else np.zeros(0, np.int64)
                    out.append((*((t[0].as_py(), t[-1].as_py()) if len(t) else (None, None)), base, None if a else _packed(ids, size), _packed(t, _narrow(np.diff(np.append(at, len(k)))), _narrow(sums)), _packed(own, f, length[r])))
                kinds = (pa.string(), pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

        self.rows = written(rows.mapInArrow(run, BLOCKS), **{"parquet.page.row.count.limit": PAGE})

    def _some(self, names: tuple[str, ...] | None) -> DataFrame:
        if names is None:
            return self.rows
        return self.rows.where(reduce(Column.__or__, [(F.col("low") <= t) & (F.col("high") >= t) for t in names], F.lit(False)))

    def postings(self, names: tuple[str, ...] | None = None) -> DataFrame:
        """(term, doc_id, tf, doc_len) of these terms, or of all."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def made(base, dictionary, lists):
                t, n, _ = _unpacked(dictionary).columns
                code, rows = np.repeat(np.arange(len(t)), n), _unpacked(lists)
                if names is not None:
                    at = np.flatnonzero(np.asarray(pc.is_in(t, value_set=pa.array(names, t.type)))[code])
                    code, rows = code[at], rows.take(pa.array(at))
                id_, tf, length = rows.columns
                if base.is_valid:
                    id_ = pa.array(np.asarray(id_, np.int64) + base.as_py()).cast(kind)
                return pa.RecordBatch.from_arrays([t.take(pa.array(code)), id_, tf.cast(pa.int64()), length.cast(pa.int64())], names=["term", "doc_id", "tf", "doc_len"])

            return _joined(made(*x) for b in batches for x in zip(*b.columns, strict=True))

        kind = to_arrow_type(self.id.dataType)
        kinds = T.StructType([T.StructField("term", T.StringType()), self.id, T.StructField("tf", T.LongType()), T.StructField("doc_len", T.LongType())])
        return self._some(names).select("base", "dictionary", "lists").mapInArrow(run, kinds)

    def terms(self, names: tuple[str, ...] | None = None) -> DataFrame:
        """(term, df, total_tf) of these terms, or of all."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def made(dictionary):
                t, *counts = _unpacked(dictionary).columns
                some = pa.RecordBatch.from_arrays([t, *(c.cast(pa.int64()) for c in counts)], names=["term", "df", "total_tf"])
                return some if names is None else some.filter(pc.is_in(t, value_set=pa.array(names, t.type)))

            return _joined(made(x) for b in batches for x in b.column(0))

        return self._some(names).select("dictionary").mapInArrow(run, "term string, df long, total_tf long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("total_tf").alias("total_tf"))

    def lengths(self) -> DataFrame:
        """(doc_id, doc_len)."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return _joined(_unpacked(x).rename_columns(["doc_id", "doc_len"]) for b in batches for x in b.column(0))

        return self.rows.where("documents IS NOT NULL").select("documents").mapInArrow(run, T.StructType([self.id, T.StructField("doc_len", T.LongType())]))


def _narrow(numbers: np.ndarray) -> np.ndarray:
    """Numbers from 0 on in as few bytes as hold them."""
    return numbers.astype(np.min_scalar_type(numbers.max(initial=0)))


def _near(ids: pa.Array) -> tuple[int | None, np.ndarray | pa.Array]:
    """(the least id, how far each is from it) where ids are whole numbers that lie near each other; else (nothing, ids)."""
    if pa.types.is_integer(ids.type) and len(ids) and not ids.null_count:
        x = np.asarray(ids, np.int64)
        if int(x.max()) - int(x.min()) < 1 << 32:
            return int(x.min()), _narrow(x - x.min())
    return None, ids


def _packed(*columns) -> bytes:
    out = pa.BufferOutputStream()
    b = pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], names=[str(i) for i in range(len(columns))])
    with pa.ipc.new_stream(out, b.schema) as w:
        w.write_batch(b)
    return out.getvalue().to_pybytes()


def _unpacked(one: pa.BinaryScalar) -> pa.RecordBatch:
    return pa.ipc.open_stream(one.as_buffer()).read_next_batch()


def _joined(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of about ``ROWS`` rows, of smaller ones."""
    held, n = [], 0
    for b in parts:
        held.append(b)
        n += b.num_rows
        if n >= ROWS:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if n:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


@dataclass
class InvertedIndex:
    """The four tables of one corpus. ``_of`` gives the postings and terms of a few terms where a filter of the tables isn't the way."""

    postings: DataFrame
    doc_stats: DataFrame
    terms: DataFrame
    stats: DataFrame
    _source: tuple[DataFrame, dict] | None = None
    _totals: tuple[int, float] | None = None
    _of: Callable[[tuple[str, ...]], tuple[DataFrame, DataFrame]] | None = None

    def of(self, names: Iterable[str]) -> tuple[DataFrame, DataFrame]:
        """(postings, terms) of a few terms."""
        if self._of:
            return self._of(tuple(names))
        some = F.col("term").isin(*names)
        return self.postings.where(some), self.terms.where(some)

    def totals(self) -> tuple[int, float]:
        """(documents, mean length), looked up once."""
        if self._totals is None:
            s = self.stats.first()
            self._totals = (s.n, s.avgdl)
        return self._totals

    @staticmethod
    def build(docs: DataFrame, cfg: TokenizerConfig | None = None, id_: str = "doc_id", text: str = "text", positions: bool = False) -> InvertedIndex:
        source = texts(docs, cfg, id_, text)
        how = {"positions": positions, "cfg": cfg, "repeated": _repeated(source, ())}
        post, lengths = postings(source, lengths=True, **how), doc_stats(tokenized(docs, cfg, id_, text))
        return InvertedIndex(post, lengths, terms(post), corpus_stats(lengths), (source, how))

    def live(self, tombstones: DataFrame | None) -> InvertedIndex:
        """The index of the documents that aren't deleted, statistics included."""
        if tombstones is None:
            return self
        post, lengths = without(self.postings, tombstones), without(self.doc_stats, tombstones)

        def of(names: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
            some = without(self.of(names)[0], tombstones)
            return some, terms(some)

        return InvertedIndex(post, lengths, terms(post), corpus_stats(lengths), _of=of)

    def with_delta(self, delta: InvertedIndex, touched: DataFrame) -> InvertedIndex:
        """This index with some documents (``touched``: doc_id) replaced by those of a small one that isn't saved yet, or gone."""
        post = without(self.postings, touched).unionByName(delta.postings)
        lengths = without(self.doc_stats, touched).unionByName(delta.doc_stats)

        def of(names: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
            some = without(self.of(names)[0], touched).unionByName(delta.of(names)[0])
            return some, terms(some)

        return InvertedIndex(post, lengths, terms(post), corpus_stats(lengths), _of=of)

    def materialised(self) -> InvertedIndex:
        """Postings and lengths as tables in the shared folder, from one analysis of the texts, so that these aren't analysed again
        for what is derived."""
        post, lengths = analysed(self._source[0], **self._source[1]) if self._source else (written(self.postings), written(self.doc_stats))
        return InvertedIndex(post, lengths, terms(post), corpus_stats(lengths))

    def packed(self) -> InvertedIndex:
        """As ``materialised``, in blocks, where postings are looked up by term: few rows are written, however many postings there are. Repeated ids,
        positions and what isn't made from texts stay rows."""
        if not self._source or self._source[1]["repeated"] or self._source[1]["positions"]:
            return self.materialised()
        b = Blocks(self._source[0], self._source[1]["cfg"])
        lengths = b.lengths()
        return InvertedIndex(b.postings(), lengths, b.terms(), corpus_stats(lengths), _of=lambda names: (b.postings(names), b.terms(names)))

    def save(self, path: str) -> None:
        """Written as they come first: the choice of the ranges looks at the rows once, the exchange once more."""
        now = self.materialised()
        by_range(now.postings, now.postings.count(), "term", "doc_id").write.mode("overwrite").parquet(f"{path}/postings")
        spark = self.postings.sparkSession
        saved = spark.read.parquet(f"{path}/postings")
        terms(saved).repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms")
        now.doc_stats.write.mode("overwrite").parquet(f"{path}/doc_stats")
        corpus_stats(spark.read.parquet(f"{path}/doc_stats")).write.mode("overwrite").parquet(f"{path}/stats")

    @staticmethod
    def load(spark: SparkSession, path: str) -> InvertedIndex:
        return InvertedIndex(*(spark.read.parquet(f"{path}/{t}") for t in ("postings", "doc_stats", "terms", "stats")))
