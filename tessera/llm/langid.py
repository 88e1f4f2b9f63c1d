"""Operator 8: language identification by interpolated Kneser-Ney character language models.

Symbols are lower-case letters; whatever lies between two letters is one blank. For each language 4-grams are counted over
all labelled documents (distinct grams of a batch leave the Python worker with their counts, so little is shuffled), and
lower orders count distinct left neighbours. The models of all languages lie side by side in arrays sorted by 64-bit gram
hash, with the interpolated log probability of every gram seen in any language, so that scoring is one array look-up a
character and goes to shorter grams only where a gram was never seen.

A document gets the language of the lowest cross-entropy a character. It is rejected if that cross-entropy is further above
its language's mean than ``false_reject`` of the labelled documents of that language are, in standard deviations of texts
of its length. Mean, deviation and quantile are those of all labelled documents, each scored by models of the other half of the
texts (halves by a hash of the text, so that copies stay together): no text is measured by a model that has seen it. The
quantile is exact. A fitted model and its limits can be applied to any table.

The models' size is checked before they are sent to the tasks. Beyond ``MAX_GRAMS`` rows (lang, gram) the arrays are parted
by the hash of a gram's inner symbols: whatever a look-up and its shorter grams need lies in one part, and below that in
the bigrams, which every task holds. Tasks build the parts, with discounts counted over all of them, and take one part at a
time for a run of documents, so every gram counts and the scores are those of the models in one piece.

Defined results: texts without a letter, empty and null texts have no language (pred_lang and scores null, accepted false);
labels that are null or empty don't train; without any label nothing is recognised; a language that one half alone has is
calibrated on the texts it was trained on, and one that labels no recognised text accepts nothing; ties go to the first language in
alphabetical order; repeated rows count as often as they occur; columns with the output's names are replaced.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textops import CHUNK_CHARS, U64, Texts, category_table, chunks, hash_table, lower_table, prefix_hash, ragged, slice_hash, written

ORDER = 4
BASE = 2  # length of the grams that every task holds
MAX_GRAMS = 4_000_000
FALSE_REJECT = 0.0005
ADDED = ["pred_lang", "cross_entropy", "margin", "accepted"]
PAD = 1  # stands before a text

_state: dict[str, np.ndarray] = {}


def _symbols() -> np.ndarray:
    if "symbols" not in _state:
        _state["symbols"] = np.where(category_table() == 1, lower_table(), np.uint32(32)).astype(np.uint32)
    return _state["symbols"]


def symbols(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, offsets): each document with ORDER - 1 paddings before it; nothing for those without a letter."""
    s = _symbols()[t.cps]
    blank = s == 32
    drop = np.zeros(len(s), bool)
    drop[1:] = blank[1:] & blank[:-1]
    heads = t.off[:-1][np.diff(t.off) > 0]
    drop[heads] = blank[heads]  # nor at the beginning
    where = np.concatenate(([0], np.cumsum(~drop)))
    s, off = s[~drop], where[t.off]
    tail = off[1:][np.diff(off) > 0] - 1
    tail = tail[s[tail] == 32]
    if len(tail):
        ok = np.ones(len(s), bool)
        ok[tail] = False
        where = np.concatenate(([0], np.cumsum(ok)))
        s, off = s[ok], where[off]
    n = np.diff(off)
    pad = np.where(n > 0, ORDER - 1, 0)
    new = np.concatenate(([0], np.cumsum(n + pad)))
    out = np.full(int(new[-1]), PAD, np.uint32)
    out[ragged(new[:-1] + pad, n)] = s
    return out, new


def ends(off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position of the first symbol of each gram of ORDER symbols, grams of each document)."""
    n = np.maximum(np.diff(off) - ORDER + 1, 0)
    return ragged(off[:-1], n), n


def gram_counts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, fold, gram, n) over all labelled documents."""

    def run(batches):
        for batch in batches:
            code = batch.column(0).dictionary_encode()
            names, of = code.dictionary, 2 * np.asarray(code.indices, np.int64) + np.asarray(batch.column(1), np.int64)
            for a, b, t in chunks(batch.column(2), 1 << 21):
                s, off = symbols(t)
                start, n = ends(off)
                if not len(start):
                    continue
                which = np.repeat(of[a:b], n)
                key = slice_hash(prefix_hash(hash_table()[s]), start, start + ORDER)
                langs, grams, counts = [], [], []
                for k in np.unique(which):
                    at = start[which == k]
                    h = key[which == k]
                    order = np.argsort(h)
                    h = h[order]
                    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
                    at = at[order[first]]
                    raw = s[at[:, None] + np.arange(ORDER)].astype("<u4").tobytes().decode("utf-32-le", "replace")
                    grams += [raw[i : i + ORDER] for i in range(0, len(raw), ORDER)]
                    counts.append(np.diff(np.append(first, len(h))))
                    langs.append(np.full(len(first), k))
                which = np.concatenate(langs)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(which // 2)), pa.array(which % 2), pa.array(grams), pa.array(np.concatenate(counts))], names=["lang", "fold", "gram", "n"])

    source = docs.select(F.col(lang).alias("lang"), _fold(text).alias("fold"), F.col(text).alias("t")).where((F.col("lang") != "") & F.col("t").isNotNull())
    return source.mapInArrow(run, "lang string, fold long, gram string, n long").groupBy("lang", "fold", "gram").agg(F.sum("n").alias("n"))


def _fold(text: str):
    """The half that a text belongs to."""
    return F.pmod(F.xxhash64(text), F.lit(2)).cast("long")


class Sorted:
    """Hashes in sorted order with a directory over their leading bits."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.append(keys, U64(2**64 - 1))
        self.n = len(keys)
        self.shift = U64(64 - max(1, int(np.ceil(np.log2(max(2, len(keys)))))))
        self.first = np.searchsorted(keys, np.arange(1 << int(64 - int(self.shift)), dtype=U64) << self.shift).astype(np.int32)

    def find(self, k: np.ndarray) -> np.ndarray:
        """Positions, -1 where absent."""
        at = self.first[(k >> self.shift).astype(np.int64)]
        got = self.keys[at]
        todo = np.flatnonzero(got < k)
        while len(todo):
            a = at[todo] + 1
            at[todo] = a
            g = self.keys[a]
            got[todo] = g
            todo = todo[g < k[todo]]
        return np.where((got == k) & (at < self.n), at, -1)


def _hash_grams(chars: np.ndarray) -> np.ndarray:
    """The hash that slice_hash gives to each row of code points."""
    from .textops import mix64, powers

    h = np.zeros(len(chars), U64)
    p = powers(chars.shape[1])[0]
    for j in range(chars.shape[1]):
        h += hash_table()[chars[:, j]] * p[j]
    return mix64(h)


def _chars(gram: list[str]) -> np.ndarray:
    """Code points, a row for each gram; all have one length."""
    return np.frombuffer("".join(gram).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(gram), -1).astype(np.int64)


def _discount(n1: np.ndarray, n2: np.ndarray) -> np.ndarray:
    """By language, from the numbers of grams counted once and twice."""
    return np.clip(np.where(n1 + 2 * n2 > 0, n1 / np.maximum(n1 + 2 * n2, 1), 0.5), 0.05, 0.95)


def _sums(logp: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sum by document and language, sum of squares, symbols)."""
    total, squares = np.zeros((len(n), logp.shape[1])), np.zeros((len(n), logp.shape[1]))
    some = np.flatnonzero(n > 0)
    if len(some):
        head = (np.cumsum(n) - n)[some]
        total[some] = np.add.reduceat(logp, head, axis=0, dtype=np.float64)
        squares[some] = np.add.reduceat(logp * logp, head, axis=0, dtype=np.float64)
    return total, squares, n


class Model:
    """Interpolated Kneser-Ney for several languages, from (lang, gram, n) with grams of one length. With ``base``, the model of
    the bigrams, it holds the longer grams only; then ``discounts`` by length are those of all parts."""

    def __init__(self, lang: list[str], gram: list[str], n: np.ndarray, langs: list[str] | None = None, base: Model | None = None, discounts: dict[int, np.ndarray] | None = None):
        self.langs = sorted(set(lang)) if langs is None else langs
        L = len(self.langs)
        where = {x: i for i, x in enumerate(self.langs)}
        of = np.fromiter((where[x] for x in lang), np.int64, len(lang))
        chars = _chars(gram)
        top, least = chars.shape[1], 1 if base is None else BASE + 1
        rows, inv = np.unique(chars, axis=0, return_inverse=True)
        count = np.zeros((len(rows), L))
        np.add.at(count, (inv.ravel(), of), n)
        # level m: grams of m symbols; counts at the top, numbers of distinct left neighbours below
        grams, counts = {top: rows}, {top: count}
        for m in range(top - 1, least - 1, -1):
            up = grams[m + 1]
            r, i = np.unique(up[:, 1:], axis=0, return_inverse=True)
            c = np.zeros((len(r), L))
            np.add.at(c, i.ravel(), (counts[m + 1] > 0).astype(float))
            grams[m], counts[m] = r, c
        vocabulary = len(grams[1]) + 1 if base is None else 0
        self.tables: dict[int, tuple[Sorted, np.ndarray]] = {}
        self.back: dict[int, tuple[Sorted, np.ndarray]] = {}
        lower = np.full((1, L), 1.0 / max(vocabulary, 1))
        prob_of: dict[bytes, int] = {}
        for m in range(least, top + 1):
            g, c = grams[m], counts[m]
            d = _discount((c == 1).sum(0), (c == 2).sum(0)) if discounts is None else discounts[m]
            ctx, i = np.unique(g[:, :-1], axis=0, return_inverse=True) if m > 1 else (np.zeros((1, 0), np.int64), np.zeros(len(g), np.int64))
            i = i.ravel()
            total, kinds = np.zeros((len(ctx), L)), np.zeros((len(ctx), L))
            np.add.at(total, i, c)
            np.add.at(kinds, i, (c > 0).astype(float))
            gamma = np.where(total > 0, d * kinds / np.maximum(total, 1), 1.0)
            if m == 1:
                below = np.repeat(lower, len(g), 0)
            elif m == least:
                index, exact = base.exact
                below = exact[index.find(_hash_grams(g[:, 1:]))]
            else:
                below = lower[np.fromiter((prob_of[x.tobytes()] for x in np.ascontiguousarray(g[:, 1:])), np.int64, len(g))]
            p = np.where(total[i] > 0, np.maximum(c - d, 0) / np.maximum(total[i], 1), 0) + gamma[i] * below
            prob_of = {x.tobytes(): k for k, x in enumerate(np.ascontiguousarray(g))}
            lower = p
            for store, rows_, values in ((self.tables, g, p), (self.back, ctx, gamma)):
                if rows_.shape[1] == 0:
                    self.root = np.log(values[0] / vocabulary).astype(np.float32)  # of a symbol never seen
                    continue
                h = _hash_grams(rows_)
                order = np.argsort(h)
                store[m if store is self.tables else m - 1] = (Sorted(h[order]), np.log(values[order]).astype(np.float32))
                if m == top == BASE and store is self.tables:
                    self.exact = store[m][0], values[order]

    def score(self, s: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sum of log probabilities by document and language, sum of their squares, symbols)."""
        start, n = ends(off)
        return _sums(self.logp(prefix_hash(hash_table()[s]), start, ORDER), n)

    def logp(self, prefix: np.ndarray, start: np.ndarray, m: int) -> np.ndarray:
        """Log probabilities of the last of m symbols after those before it, by language."""
        index, table = self.tables[m]
        at = index.find(slice_hash(prefix, start, start + m))
        out = table[np.maximum(at, 0)]
        miss = np.flatnonzero(at < 0)
        if len(miss):
            out[miss] = self._shorter(prefix, start[miss], m)
        return out

    def _shorter(self, prefix: np.ndarray, start: np.ndarray, m: int) -> np.ndarray:
        """Log probabilities where the gram of m symbols was never seen."""
        if m == 1:
            return np.repeat(self.root[None, :], len(start), 0)
        index, gamma = self.back[m - 1]
        at = index.find(slice_hash(prefix, start, start + m - 1))
        out = np.where((at >= 0)[:, None], gamma[np.maximum(at, 0)], np.float32(0))
        return out + self.logp(prefix, start + 1, m - 1)


class Parted:
    """The same models, the longer grams in ``n`` parts by the hash of their inner symbols; ``parts`` holds a broadcast for each
    part that has a gram."""

    def __init__(self, base: Model, parts: dict, n: int):
        self.base, self.parts, self.n, self.langs = base, parts, n, base.langs

    def part(self, k: int) -> Model:
        shared = self.parts[k]
        part = pickle.loads(shared.value)
        shared.__dict__.pop("_value", None)  # one part at a time stays in memory
        part.tables, part.back = {**self.base.tables, **part.tables}, {**self.base.back, **part.back}
        part.root = self.base.root
        return part

    def score(self, s: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As that of Model."""
        start, n = ends(off)
        prefix = prefix_hash(hash_table()[s])
        logp = np.empty((len(start), len(self.langs)), np.float32)
        of = slice_hash(prefix, start + 1, start + ORDER - 1) % U64(self.n)
        order = np.argsort(of, kind="stable")
        names, first = np.unique(of[order], return_index=True)
        for k, at in zip(names.tolist(), np.split(order, first[1:]) if len(names) else [], strict=True):
            if k in self.parts:
                logp[at] = self.part(k).logp(prefix, start[at], ORDER)
            else:
                logp[at] = self.base.logp(prefix, start[at] + ORDER - BASE, BASE)
        return _sums(logp, n)


def parted(counts: DataFrame, size: int, max_grams: int) -> Parted:
    """The models of ``size`` rows of counts in parts; none of the counts comes to the driver but those of bigrams."""
    spark = counts.sparkSession
    level = {ORDER: counts}
    for m in range(ORDER - 1, BASE - 1, -1):
        level[m] = written(level[m + 1].groupBy("lang", F.substring("gram", 2, m).alias("gram")).agg(F.count(F.lit(1)).alias("n")))
    t = level[BASE].orderBy("lang", "gram").toArrow()
    base = Model(t.column("lang").to_pylist(), t.column("gram").to_pylist(), np.asarray(t.column("n"), float))
    langs, discounts = base.langs, {}
    for m in range(BASE + 1, ORDER + 1):
        got = {r.lang: r for r in level[m].groupBy("lang").agg(F.count_if(F.col("n") == 1).alias("n1"), F.count_if(F.col("n") == 2).alias("n2")).collect()}
        discounts[m] = _discount(np.array([got[x].n1 for x in langs]), np.array([got[x].n2 for x in langs]))
    n = -(-size * max(8, len(langs)) // max(1, max_grams))
    shared = spark.sparkContext.broadcast(base)

    def to(batches):
        for b in batches:
            if b.num_rows:
                of = _hash_grams(_chars(b.column(1).to_pylist())[:, 1 : ORDER - 1]) % U64(n)
                yield pa.RecordBatch.from_arrays([pa.array(of.astype(np.int64)), *b.columns], names=["part", "lang", "gram", "n"])

    def build(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        m = Model(t.column("lang").to_pylist(), t.column("gram").to_pylist(), np.asarray(t.column("n"), float), langs, shared.value, discounts)
        return pa.table({"part": t.column("part").slice(0, 1), "model": pa.array([pickle.dumps(m)], pa.binary())})

    built = written(counts.select("lang", "gram", "n").mapInArrow(to, "part long, lang string, gram string, n long").groupBy("part").applyInArrow(build, "part long, model binary"))
    parts = {r.part: spark.sparkContext.broadcast(bytes(r.model)) for r in built.toLocalIterator()}
    return Parted(base, parts, n)


def _shipped(spark: SparkSession, model: Model | Parted):
    """A function that gives the model in a task."""
    if isinstance(model, Parted):
        base, parts, n = spark.sparkContext.broadcast(model.base), model.parts, model.n
        return lambda: Parted(base.value, parts, n)
    shared = spark.sparkContext.broadcast(model)
    return lambda: shared.value


def train(docs: DataFrame, text: str = "text", lang: str = "lang", max_grams: int = MAX_GRAMS) -> Model | Parted | None:
    """The models of all languages that label a document; None without labels."""
    return model_of(written(gram_counts(docs, text, lang)), max_grams)


def model_of(counts: DataFrame, max_grams: int = MAX_GRAMS) -> Model | Parted | None:
    """The models of (lang, fold, gram, n)."""
    counts = written(counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    size = counts.count()
    if size > max_grams:
        return parted(counts, size, max_grams)
    t = counts.orderBy("lang", "gram").toArrow()
    return Model(t.column("lang").to_pylist(), t.column("gram").to_pylist(), np.asarray(t.column("n"), float)) if t.num_rows else None


def scores(docs: DataFrame, model: Model | Parted, text: str, keep: list[str], label: str | None) -> DataFrame:
    """``keep`` columns with best, ce, margin, n and var (variance of a symbol's log probability)."""
    cols = [*keep, *([label] if label else [])]
    inside = [f"c{i}" for i in range(len(keep))] + (["label"] if label else [])
    spark = docs.sparkSession
    given = _shipped(spark, model)
    # A run of documents long enough to be worth the loading of each part.
    size = max(CHUNK_CHARS, (1 << 24) // len(model.langs)) if isinstance(model, Parted) else None
    kinds = [T.StructField(i, docs.schema[c].dataType) for c, i in zip(cols, inside, strict=True)]
    kinds += [T.StructField("best", T.StringType()), *(T.StructField(c, T.DoubleType()) for c in ("ce", "margin", "var")), T.StructField("n", T.LongType())]

    def run(batches):
        m = given()
        names = pa.array(m.langs)
        for batch in batches:
            for a, b, t in chunks(batch.column(len(inside)), size):
                total, squares, n = m.score(*symbols(t))
                ce = -total / np.maximum(n, 1)[:, None]
                rows = np.arange(len(n))
                best = ce.argmin(1)
                low = ce[rows, best]
                rest = ce.copy()
                rest[rows, best] = np.inf
                margin = rest.min(1) - low if ce.shape[1] > 1 else np.zeros(len(n))
                var = np.maximum(squares[rows, best] / np.maximum(n, 1) - low**2, 0)
                none = n == 0
                three = [pa.array(x, pa.float64(), mask=none) for x in (low, margin, var)]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(a, b - a) for i in range(len(inside))), names.take(pa.array(best, mask=none)), *three, pa.array(n)],
                    names=[*inside, "best", "ce", "margin", "var", "n"],
                )

    source = docs.select(*(F.col(f"`{c}`").alias(i) for c, i in zip(cols, inside, strict=True)), F.col(text).alias("t"))
    return written(source.mapInArrow(run, T.StructType(kinds)))


@dataclass
class Fitted:
    """Models, and by language (lang, mean, within, between, limit) what is accepted."""

    model: Model | Parted
    limits: list[tuple]


_LIMITS = "lang string, mean double, within double, between double, `limit` double"


def _z():
    """How far above its language's mean a text lies: a text of n symbols has the variance between + within / n around it."""
    return (F.col("ce") - F.col("mean")) / F.sqrt(F.col("between") + F.col("within") / F.col("n"))


def limits_of(own: DataFrame, false_reject: float) -> DataFrame:
    """Limits by language from the scores of texts whose language was recognised. Of the values around the quantile, which an
    approximate one brackets, the one of the exact rank is taken."""
    fit = own.groupBy("best").agg(F.avg("ce").alias("mean"), F.var_pop("ce").alias("v"), F.avg("var").alias("within"), F.avg(1 / F.col("n")).alias("inv"))
    fit = written(fit.select("best", "mean", "within", F.greatest(F.col("v") - F.col("within") * F.col("inv"), F.lit(1e-6)).alias("between")))
    z = written(own.join(F.broadcast(fit), "best").select("best", _z().alias("z")))  # a row a language
    q, near = 1 - false_reject, 1e-4
    around = F.percentile_approx("z", F.array(F.lit(max(0.0, q - near)), F.lit(min(1.0, q + near))), 100_000)
    a = z.groupBy("best").agg(F.count(F.lit(1)).alias("rows"), around.alias("b"))
    j = z.join(F.broadcast(a), "best")
    below = j.groupBy("best").agg(F.count_if(F.col("z") < F.col("b")[0]).alias("below"))
    inside = j.where(F.col("z").between(F.col("b")[0], F.col("b")[1])).withColumn("k", F.row_number().over(Window.partitionBy("best").orderBy("z")))
    rank = F.greatest(F.lit(1), F.ceil(F.col("rows") * F.lit(q)))
    limit = inside.join(below, "best").where(F.col("below") + F.col("k") == rank).select("best", F.col("z").alias("limit"))
    return fit.join(limit, "best").select(F.col("best").alias("lang"), "mean", "within", "between", "limit")


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", false_reject: float = FALSE_REJECT, max_grams: int = MAX_GRAMS) -> Fitted | None:
    """Models and limits of a labelled table; None without labels."""
    counts = written(gram_counts(docs, text, lang))
    model = model_of(counts, max_grams)
    if model is None:
        return None
    labelled = docs.select(F.col(text).alias("t"), F.col(lang).alias("lang"), _fold(text).alias("fold")).where((F.col("lang") != "") & F.col("t").isNotNull())
    right = (F.col("label") == F.col("best")) & (F.col("n") > 0)
    found: list[tuple] = []
    halves = [model_of(counts.where(F.col("fold") == i), max_grams) for i in (0, 1)]
    if None not in halves:
        apart = [scores(labelled.where(F.col("fold") == i), halves[1 - i], "t", [], "lang") for i in (0, 1)]
        found = [tuple(r) for r in limits_of(apart[0].unionByName(apart[1]).where(right), false_reject).collect()]  # a row a language
    if rest := sorted(set(model.langs) - {r[0] for r in found}):
        seen = scores(labelled.where(F.col("lang").isin(rest)), model, "t", [], "lang")
        found += [tuple(r) for r in limits_of(seen.where(right), false_reject).collect()]
    return Fitted(model, found)


def apply(docs: DataFrame, fitted: Fitted, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all by default) with pred_lang, cross_entropy (nats a symbol), margin to the next language, and accepted."""
    names = [c for c in (docs.columns if keep is None else keep) if c not in ADDED]
    s = scores(docs, fitted.model, text, names, None)
    limit = F.broadcast(docs.sparkSession.createDataFrame(fitted.limits, _LIMITS))
    j = s.join(limit, F.col("best") == F.col("lang"), "left")
    ok = F.coalesce(_z() <= F.col("limit"), F.lit(False))
    return j.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)), F.col("best").alias("pred_lang"), F.col("ce").alias("cross_entropy"), "margin", ok.alias("accepted"))


def identify(docs: DataFrame, text: str = "text", lang: str = "lang", keep: list[str] | None = None, false_reject: float = FALSE_REJECT, max_grams: int = MAX_GRAMS) -> DataFrame:
    """``apply`` of what is fitted to the labels of the same table."""
    fitted = fit(docs, text, lang, false_reject, max_grams)
    if fitted is None:
        names = [c for c in (docs.columns if keep is None else keep) if c not in ADDED]
        nothing = [F.lit(None).cast("string"), F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(False)]
        return docs.select(*names, *(x.alias(c) for x, c in zip(nothing, ADDED, strict=True)))
    return apply(docs, fitted, text, keep)


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents by models of their lang column."""
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text"), keep=["doc_id", "lang"])


QUERIES = {"op8_langid": op8_langid}
ORACLES: dict[str, str] = {}
