"""Operator 4: quality classifier by ordinal cumulative-link regression on graded ratings.

One weight vector over hashed text features is shared by all grades; ordered thresholds cut its score, so that
P(grade > k) = sigmoid(score - threshold_k). Expected grade and tail probabilities come from the same model.

The grades of the labels table: 0 for low quality, 1 for good but toxic text, 2 for good text. Features: presence of
lower-case words and of their beginnings of four to six letters (scaled by how differently good and bad documents have them), shares of word shapes and of words that repeat the one before.

The model is fitted on at most ``max_train`` labelled rows, chosen by a hash of their id (a classifier may be fitted on a
bounded sample; raise the bound for more). All tasks turn those rows' texts into chunks of about ``CHUNK_DOCS`` sparse rows, written
once; the optimiser, one task, holds these chunks alone (6 bytes a cell, some 120 MB for 20,000 documents) and takes one at a time
at every step. Every slot that a chunk holds has a weight. The model (4 MB, by the number of hash slots) is sent to all tasks.
Scoring is a single pass without a shuffle over all documents, whole texts.

Defined results: a null text, or one without any word, has null scores and keep = false; without any labelled row scores
are null and every text that has a word is kept; an id with several labels has the lowest quality and the highest toxic of
them; labels without a quality don't count; of rows that share an id the text of the least hash trains. Repeated rows get the same scores; columns whose names clash with the output's
are replaced.
"""

from __future__ import annotations

import pickle
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textops import U64, Texts, category_table, chunks, lower_hash_table, lower_table, mix64, prefix_hash, runs, slice_hash, words, written

GRADES = 3
LEX_BITS, STYLE_BITS = 20, 13
BEGINNINGS = (4, 5, 6)
SLOTS = (1 << LEX_BITS) + (1 << STYLE_BITS)
#: Shares of shapes lie between 0 and 1; this brings their weights to the size of those of words.
STYLE_SCALE = 20.0
#: Of the squared weights.
PENALTY = 3.0
#: The least probability of the highest grade that keeps a document.
SELECT = 0.8
MAX_TRAIN = 20_000
#: Documents of one chunk of the sample, about; ids and grades that may be sent to all tasks (16 bytes each).
CHUNK_DOCS, MAX_BROADCAST = 512, 1 << 20
#: Documents that have a feature whatever their grade, besides those counted.
PRIOR = 8.0
#: L-BFGS ends after so many steps, or where a step gains less, as a share of the loss.
STEPS, GAIN = 100, 3e-4
SCORES = ["expected_grade", "p_ge_1", "p_ge_2", "keep"]

_state: dict[str, np.ndarray] = {}


def _shape_table() -> np.ndarray:
    """Lower-case letter, upper-case letter and digit are one symbol each; any other character stands for itself."""
    if "shape" not in _state:
        kind, low = category_table(), lower_table()
        code = np.arange(len(kind), dtype=np.uint32)
        symbol = np.where(kind == 1, np.where(low != code, np.uint32(65), np.uint32(97)), np.where(kind == 2, np.uint32(48), code))
        _state["shape"] = mix64(symbol.astype(U64) + U64(77)) | U64(1)
        _state["space"] = kind == 3
    return _state["shape"]


def features(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, slot) of words and beginnings, (document, slot) of shapes, and the number of space-parted words by document.
    Style slot 0 is a word that repeats the one before, slot 1 a repeated word that has four letters at least."""
    shape = _shape_table()
    h, start, end, at = words(t)
    doc = np.repeat(np.arange(len(t)), np.diff(at))
    prefix = prefix_hash(lower_hash_table()[t.cps])
    begins = [mix64(slice_hash(prefix, start, np.minimum(start + k, end)) ^ U64(0x5555 + k)) for k in BEGINNINGS]
    slots = (np.concatenate((h, *begins)) >> U64(64 - LEX_BITS)).astype(np.int64)
    lex_doc = np.tile(doc, 1 + len(begins))
    s, e = runs(~_state["space"][t.cps], t.off)
    tok_at = np.searchsorted(s, t.off)
    tok_doc = np.repeat(np.arange(len(t)), np.diff(tok_at))
    v = shape[t.cps]
    new = np.ones(len(v), bool)
    new[1:] = v[1:] != v[:-1]
    new[s] = True
    where = np.concatenate(([0], np.cumsum(new)))
    sh = slice_hash(prefix_hash(v[new]), where[s], where[e])
    style = (sh >> U64(64 - STYLE_BITS)).astype(np.int64)
    style = np.maximum(style, 2)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    long_ = again & (end - start >= 4)
    style_doc = np.concatenate((tok_doc, doc[again], doc[long_]))
    style = np.concatenate((style, np.zeros(int(again.sum()), np.int64), np.ones(int(long_.sum()), np.int64)))
    return lex_doc, slots, style_doc, style, np.diff(tok_at)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def likelihood(f: np.ndarray, y: np.ndarray, th: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Negative log likelihood of grades y at scores f, with its gradients by score and by threshold."""
    cut = np.concatenate(([-np.inf], th, [np.inf]))
    hi, lo = _sigmoid(cut[y + 1] - f), _sigmoid(cut[y] - f)  # P(grade <= y), P(grade < y)
    prob = np.maximum(hi - lo, 1e-12)
    dhi, dlo = hi * (1 - hi) / prob, lo * (1 - lo) / prob
    gth = np.array([dlo[y == k + 1].sum() - dhi[y == k].sum() for k in range(len(th))])
    return -np.log(prob).sum(), dhi - dlo, gth


class Ordinal:
    """Cumulative logit with L2 on the weights, fitted by L-BFGS; the sums over the data come from a function."""

    slight, kept = 1e-3, 6

    def __init__(self, grades: int = GRADES, l2: float = 1.0, steps: int | None = None):
        self.grades, self.l2, self.steps = grades, l2, steps or STEPS

    def thresholds(self, p: np.ndarray) -> np.ndarray:
        return p[0] + np.concatenate(([0.0], np.cumsum(np.exp(p[1:]))))

    def loss(self, z: np.ndarray, n_cols: int, data) -> tuple[float, np.ndarray]:
        """Penalised loss with its gradient; ``data`` gives (value, gradient by weight, gradient by threshold) at (weights,
        thresholds). A slight penalty on the thresholds keeps them finite where a grade doesn't occur."""
        w, p = z[:n_cols], z[n_cols:]
        value, gw, gth = data(w, self.thresholds(p))
        gp = self.slight * p
        gp[0] += gth.sum()
        for k in range(1, self.grades - 1):
            gp[k] += gth[k:].sum() * np.exp(p[k])
        return value + 0.5 * self.l2 * (w @ w) + 0.5 * self.slight * (p @ p), np.concatenate((gw + self.l2 * w, gp))

    def fit(self, n_cols: int, data) -> tuple[np.ndarray, np.ndarray]:
        """(weights, thresholds)."""
        z = np.zeros(n_cols + self.grades - 1)
        z[n_cols] = -4.0
        value, g = self.loss(z, n_cols, data)
        hist: list[tuple[np.ndarray, np.ndarray, float]] = []
        for _ in range(self.steps):
            q, alphas = g.copy(), []
            for s, d, r in reversed(hist):
                a = r * (s @ q)
                alphas.append(a)
                q -= a * d
            q *= float(hist[-1][0] @ hist[-1][1]) / float(hist[-1][1] @ hist[-1][1]) if hist else 1 / max(1.0, np.abs(g).max())
            for (s, d, r), a in zip(hist, reversed(alphas), strict=True):
                q += s * (a - r * (d @ q))
            slope, t = -(g @ q), 1.0
            if slope >= 0:
                hist.clear()
                q, slope = g / max(1.0, np.abs(g).max()), -(g @ g) / max(1.0, np.abs(g).max())
            while True:
                new, gn = self.loss(z - t * q, n_cols, data)
                if new <= value + 1e-4 * t * slope or t < 1e-8:
                    break
                t *= 0.5
            s, d = -t * q, gn - g
            z, g, gain, value = z + s, gn, value - new, new
            if s @ d > 1e-10:
                hist = [*hist[-self.kept + 1 :], (s.astype(np.float32), d.astype(np.float32), 1 / (s @ d))]
            del s, d, q, gn
            if gain < GAIN * max(1.0, abs(value)):
                break
        return z[:n_cols], self.thresholds(z[n_cols:])


class Chunk(NamedTuple):
    """Sparse rows of a run of documents: the cells of row i are at[i] .. at[i + 1], cell j is in column slots[col[j]]."""

    slots: np.ndarray
    at: np.ndarray
    col: np.ndarray
    val: np.ndarray
    y: np.ndarray

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.y), dtype=np.int32), np.diff(self.at))

    def counts(self) -> np.ndarray:
        """Documents of each grade (rows) that have each slot."""
        row = self.rows()
        return np.stack([np.bincount(self.col[(self.y == k)[row]], minlength=len(self.slots)) for k in range(GRADES)]).astype(np.int32)

    def gradient(self, u: np.ndarray, th: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """(value, gradient by slot, gradient by threshold) at the weights u of the slots."""
        n = np.diff(self.at)
        some, f = n > 0, np.zeros(len(self.y))
        if some.any():
            f[some] = np.add.reduceat(u[self.col] * self.val, self.at[:-1][some])
        value, df, gth = likelihood(f, self.y, th)
        return value, np.bincount(self.col, np.repeat(df, n) * self.val, minlength=len(self.slots)), gth


def chunk_of(texts, grades: np.ndarray) -> Chunk:
    """Presence of lexical slots, scaled shares of style slots."""
    keys, vals, base = [], [], 0
    for _, _, t in chunks(texts):
        ld, ls, sd, ss, n = features(t)
        key = np.unique((ld + base) * SLOTS + ls)
        sk, sc = np.unique((sd + base) * SLOTS + (1 << LEX_BITS) + ss, return_counts=True)
        key, val = np.concatenate((key, sk)), np.concatenate((np.ones(len(key)), STYLE_SCALE * sc / np.maximum(n, 1)[sk // SLOTS - base]))
        order = np.argsort(key)
        keys.append(key[order])
        vals.append(val[order].astype(np.float16))
        base += len(t)
    key = np.concatenate(keys) if keys else np.empty(0, np.int64)
    slots, col = np.unique(key % SLOTS, return_inverse=True)
    at = np.searchsorted(key, np.arange(base + 1) * SLOTS).astype(np.int32)
    return Chunk(slots.astype(np.int32), at, col.astype(np.int32), np.concatenate(vals) if vals else np.empty(0, np.float16), grades)


def log_ratios(df: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For each column, how differently it occurs below and above a grade: from the largest absolute log ratio over the grades, after
    ``PRIOR`` documents that have it in both. Scaled by it, the penalty leaves telling words their weight and holds down the many
    that tell nothing, or occur too seldom to tell."""
    out = np.zeros(df.shape[1])
    for k in range(GRADES - 1):
        low, high = docs[: k + 1].sum(), docs[k + 1 :].sum()
        if low and high:
            a, b = PRIOR * low / (low + high), PRIOR * high / (low + high)
            out = np.maximum(out, np.abs(np.log((df[: k + 1].sum(0) + a) / (low + a) * (high + b) / (df[k + 1 :].sum(0) + b))))
    return np.maximum(0.1, 0.3 * out**3)


def trained(parts: list[Chunk], l2: float = PENALTY) -> dict:
    """The model of chunks: a weight for every slot, and the thresholds."""
    seen = np.unique(np.concatenate([c.slots for c in parts]))
    at = [np.searchsorted(seen, c.slots) for c in parts]
    df, docs = np.zeros((GRADES, len(seen)), np.int64), np.zeros(GRADES, np.int64)
    for i, c in zip(at, parts, strict=True):
        df[:, i] += c.counts()
        docs += np.bincount(c.y, minlength=GRADES)
    lex = int(np.searchsorted(seen, 1 << LEX_BITS))
    scale = np.ones(len(seen))
    scale[:lex] = log_ratios(df[:, :lex], docs)
    del df

    def data(w: np.ndarray, th: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        u, total, g, gth = scale * w, 0.0, np.zeros(len(seen)), np.zeros(GRADES - 1)
        for i, c in zip(at, parts, strict=True):
            value, gc, gt = c.gradient(u[i], th)
            total += value
            g[i] += gc
            gth += gt
        return total, g * scale, gth

    w, th = Ordinal(l2=l2).fit(len(seen), data)
    u = np.zeros(SLOTS, np.float32)
    u[seen] = scale * w
    return {"u": u, "th": th}


def train_arrays(texts, grades: np.ndarray, l2: float = PENALTY) -> dict:
    """The model of these texts and grades in one piece."""
    return trained([chunk_of(texts, np.asarray(grades, np.int64))], l2)


class Scorer:
    def __init__(self, model: dict):
        self.u, self.th = model["u"], model["th"]

    def tails(self, t: Texts) -> tuple[np.ndarray, np.ndarray]:
        """P(grade > k) for each document and k, and whether it has a word."""
        ld, ls, sd, ss, n = features(t)
        docs = len(t)
        key = np.sort(ld << LEX_BITS | ls)
        key = key[np.concatenate(([True], key[1:] != key[:-1]))] if len(key) else key
        f = np.bincount(key >> LEX_BITS, self.u[key & ((1 << LEX_BITS) - 1)], minlength=docs) if len(key) else np.zeros(docs)
        f = f + STYLE_SCALE * np.bincount(sd, self.u[(1 << LEX_BITS) + ss], minlength=docs) / np.maximum(n, 1)
        has = np.zeros(docs, bool)
        has[ld] = True
        return _sigmoid(f[:, None] - self.th[None, :]), has


def graded(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) from quality and toxic."""
    q = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    q = q.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("x"))
    return q.select("doc_id", F.when(F.col("q") <= 0, 0).when(F.col("x") >= 1, 1).otherwise(2).alias("grade"))


def fit(docs: DataFrame, ratings: DataFrame, text: str = "text", max_train: int = MAX_TRAIN, l2: float = PENALTY) -> dict | None:
    """The model of the rows of ``docs`` that have a grade; None where there is none."""
    if max_train > MAX_BROADCAST:
        raise ValueError(f"max_train is {max_train}; the ids and grades of at most {MAX_BROADCAST} rows are sent to all tasks")
    spark = docs.sparkSession
    rows = ratings.select(F.col("doc_id").alias("id"), F.col("grade").cast("int").alias("y")).orderBy(F.xxhash64("id"), "id").limit(max_train)
    sample = docs.select(F.col("doc_id").alias("id"), F.col(text).alias("t")).where(F.col("t").isNotNull()).join(F.broadcast(rows), "id")
    sample = sample.groupBy("id").agg(F.first("y").alias("y"), F.min(F.struct(F.xxhash64("t").alias("h"), "t")).alias("s"))
    parts = max(1, -(-rows.count() // CHUNK_DOCS))
    sample = sample.select("id", "y", F.col("s.t").alias("t"), F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(parts)).cast("int").alias("chunk"))

    def cells(batches):
        got = [b for b in batches if b.num_rows]
        if got:
            t = pa.Table.from_batches(got).sort_by([("chunk", "ascending"), ("id", "ascending")])
            got.clear()
            c = chunk_of(t.column("t"), np.asarray(t.column("y"), np.int64))
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (t.column("chunk")[0].as_py(), *(a.tobytes() for a in c))], names=["chunk", *Chunk._fields])

    kinds = ("chunk long, slots binary, at binary, col binary, val binary, y binary", (np.int32, np.int32, np.int32, np.float16, np.int64))
    data = written(sample.repartitionById(parts, F.col("chunk")).mapInArrow(cells, kinds[0]), spark)

    def train(batches):
        found = []
        for b in batches:
            for i in range(b.num_rows):  # views of the batches, not copies
                found.append((b.column(0)[i].as_py(), Chunk(*(np.frombuffer(b.column(j)[i].as_buffer(), kind) for j, kind in enumerate(kinds[1], 1)))))
        found = [c for _, c in sorted(found, key=lambda x: x[0]) if len(c.slots)]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(trained(found, l2))], pa.binary())], names=["model"])

    model = data.coalesce(1).mapInArrow(train, "model binary").collect()
    return pickle.loads(model[0].model) if model else None


def score(docs: DataFrame, model: dict | None, text: str = "text", keep: list[str] | None = None, threshold: float = SELECT) -> DataFrame:
    """``keep`` columns (all by default) with expected_grade, p_ge_1, p_ge_2 and keep = p_ge_2 >= threshold."""
    names = [c for c in (docs.columns if keep is None else keep) if c not in SCORES]
    inside = [f"c{i}" for i in range(len(names))]
    source = docs.select(*(F.col(f"`{c}`").alias(i) for c, i in zip(names, inside, strict=True)), F.col(text).alias("t"))
    shared = None if model is None else docs.sparkSession.sparkContext.broadcast(model)
    kinds = [T.StructField(i, docs.schema[c].dataType) for c, i in zip(names, inside, strict=True)]
    kinds += [T.StructField(c, T.DoubleType()) for c in SCORES[:3]] + [T.StructField("keep", T.BooleanType())]

    def run(batches):
        scorer = Scorer(shared.value) if shared is not None else None
        for batch in batches:
            column = batch.column(len(inside))
            for a, b, t in chunks(column):
                if scorer:
                    tail, has = scorer.tails(t)
                    none = pa.array(~has)
                    three = [pa.array(x, pa.float64(), mask=np.asarray(none)) for x in (tail.sum(1), tail[:, 0], tail[:, 1])]
                    good = pa.array(has & (tail[:, 1] >= threshold))
                else:
                    at = words(t)[3]
                    three = [pa.nulls(b - a, pa.float64())] * 3
                    good = pa.array(np.diff(at) > 0)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(len(inside))), *three, good], names=[*inside, *SCORES])

    return source.mapInArrow(run, T.StructType(kinds)).toDF(*names, *SCORES)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by the model of the labels table."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score(docs, fit(docs, graded(labels)), keep=["doc_id"])


QUERIES = {"op4_quality": op4_quality}
ORACLES: dict[str, str] = {}
