"""Operator 1: mixing sources to target weights by pivotal dependent rounding.

Every document gets the expected number of copies that brings its source to its share of the output. The whole part is
certain; the fractional parts are rounded in dependence on each other: within a source documents are paired, mass moves at
random from one to the other until one of the two is integral, and the one that isn't goes on to the next round. A move
keeps the pair's size-weighted sum and both expectations, so a source's output is its target to within one document.
Documents are paired within hash buckets first (all pairs of a round at once); the one residual that each bucket leaves per
source goes up a reduction tree whose nodes join ``FAN_IN`` buckets. The random numbers are hashes of the documents' keys:
the result depends on data and seed alone, neither on partitions nor on tasks that run again.

Only (id, source, size) rows move for the plan; the texts move once, when copies are made.

Defined results: the unit is (doc_id, source): repeated rows of one unit get the same number of copies and count with their
common size; a null id or source is a unit or source like any other; empty and null texts have size 1 (size is the number
of characters and one); a source without a target gets no copy; targets of sources that have no documents are left out, so
that the others share the whole; an empty table gives an empty plan; ids are integers of any width, other types are an error.
Other columns keep their names and values in ``mixed``, which adds none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textops import U64, long_id, mix64, written

#: Units of one bucket, about; what one task pairs in memory at a time.
BUCKET_ROWS = 1 << 17
FAN_IN = 64


def pivot(group: np.ndarray, p: np.ndarray, w: np.ndarray, h: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Rounds of pairing within equal ``group`` (rows sorted by it): (p, rows that are still fractional, one a group)."""
    p = p.astype(float).copy()
    eps = 1e-9
    p[p < eps], p[p > 1 - eps] = 0.0, 1.0
    live = np.flatnonzero((p > 0) & (p < 1))
    turn = 0
    while len(live):
        g = group[live]
        new = np.ones(len(g), bool)
        new[1:] = g[1:] != g[:-1]
        start = np.flatnonzero(new)
        rank = np.arange(len(g)) - np.repeat(start, np.diff(np.append(start, len(g))))
        a = np.flatnonzero(rank % 2 == 0)
        a = a[(a + 1 < len(g))]
        a = a[g[a + 1] == g[a]]
        if not len(a):
            break
        i, j = live[a], live[a + 1]
        up = np.minimum((1 - p[i]) * w[i], p[j] * w[j])
        down = np.minimum(p[i] * w[i], (1 - p[j]) * w[j])
        u = (mix64(h[i] * U64(0x9E3779B97F4A7C15) ^ h[j] ^ U64(seed + 1000003 * turn)) >> U64(11)).astype(float) / (1 << 53)
        go = np.where(u * (up + down) < down, up, -down)
        p[i] += go / w[i]
        p[j] -= go / w[j]
        for k in (i, j):
            x = p[k]
            x[x < eps], x[x > 1 - eps] = 0.0, 1.0
            p[k] = x
        live = live[(p[live] > 0) & (p[live] < 1)]
        turn += 1
    return p, live


def _level(seed: int):
    def run(t: pa.Table) -> pa.Table:
        code = t.column("source").combine_chunks().dictionary_encode(null_encoding="encode")
        names = code.dictionary.to_pylist()
        by_name = sorted(range(len(names)), key=lambda i: (names[i] is None, names[i] or ""))
        rank = np.empty(len(names), np.int64)
        rank[by_name] = np.arange(len(names))
        g = rank[np.asarray(code.indices, np.int64)]
        h = np.asarray(t.column("h"), np.int64).view(U64)
        order = np.lexsort((np.asarray(t.column("doc_id").fill_null(0), np.int64), h, g))
        t = t.take(pa.array(order))
        p, live = pivot(g[order], np.asarray(t.column("p"), float), np.asarray(t.column("size"), float), h[order], seed)
        open_ = np.zeros(len(p), bool)
        open_[live] = True
        return t.set_column(t.schema.get_field_index("p"), "p", pa.array(p)).append_column("open", pa.array(open_))

    return run


_ROW = "bucket long, doc_id long, source string, size long, rows long, expected double, h long, p double"


def plan(docs: DataFrame, targets: DataFrame | None = None, alpha: float = 0.5, budget: float | None = None, text: str = "text", seed: int = 1) -> DataFrame:
    """(doc_id, source, size, expected, copies) for every unit of ``docs``.

    targets: (source, weight); without it the weights are the sources' sizes to the power ``alpha``. budget: the size of the
    output, by default that of the input."""
    size = F.coalesce(F.length(f"`{text}`"), F.lit(0)).cast("long") + 1
    units = docs.select(long_id(docs).alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"))
    units = written(units.groupBy("doc_id", "source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows")))
    mass = units.groupBy("source").agg(F.sum("size").alias("mass"))
    if targets is None:
        mass = mass.withColumn("weight", F.pow("mass", F.lit(float(alpha))))
    else:
        t = targets.groupBy(F.col("source").cast("string").alias("__s")).agg(F.sum("weight").cast("double").alias("weight"))
        mass = mass.join(t, F.col("source").eqNullSafe(F.col("__s")), "left").select("source", "mass", F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)).alias("weight"))
    mass = written(mass)
    total = mass.agg(F.sum("weight"), F.sum("mass")).first()
    n = units.count()
    if not n or not total[0]:
        return units.select("doc_id", "source", "size", F.lit(0.0).alias("expected"), F.lit(0).cast("long").alias("copies"))
    rate = mass.select(F.col("source").alias("__s"), (F.col("weight") * F.lit(float(total[1] if budget is None else budget)) / F.lit(float(total[0])) / F.col("mass")).alias("expected"))
    buckets = -(-n // BUCKET_ROWS)
    h = F.xxhash64(F.lit(seed), "doc_id", "source")
    rows = units.join(rate, F.col("source").eqNullSafe(F.col("__s"))).select(
        F.pmod(h, F.lit(buckets)).alias("bucket"), "doc_id", "source", "size", "rows", "expected", h.alias("h"), (F.col("expected") - F.floor("expected")).alias("p")
    )
    settled = []
    while True:
        done = written(rows.groupBy("bucket").applyInArrow(_level(seed), _ROW + ", open boolean"))
        settled.append(done.where("not open"))
        rows = done.where("open").select(F.floor(F.col("bucket") / FAN_IN).alias("bucket"), *[c.split()[0] for c in _ROW.split(", ")[1:]])
        if buckets == 1:
            break
        buckets = -(-buckets // FAN_IN)
    # the root's residual of each source is rounded by itself
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed + 1), "h"), 11) / F.lit(float(1 << 53))
    settled.append(rows.withColumn("p", F.when(u < F.col("p"), 1.0).otherwise(0.0)).withColumn("open", F.lit(False)))
    out = settled[0]
    for x in settled[1:]:
        out = out.unionByName(x)
    return out.select("doc_id", "source", "size", "expected", (F.floor("expected") + F.round("p").cast("long")).alias("copies"))


def mixed(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """The rows of ``docs``, each as often as the plan says. A row travels as one, whatever its columns are called."""
    d = decided.where("copies > 0").select(F.col("doc_id").alias("of"), F.col("source").alias("its"), F.col("copies").cast("int").alias("copies"))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    t = docs.select(row, long_id(docs).alias("id"), F.col("source").cast("string").alias("src"))
    j = t.join(d.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("of")) & F.col("src").eqNullSafe(F.col("its")))
    return j.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*(F.col("row")[c].alias(c) for c in docs.columns))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, as often as the plan says, for sources weighted by the root of their size, at the size of the input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mixed(docs, plan(docs))


QUERIES = {"op1_mixing": op1_mixing}
ORACLES: dict[str, str] = {}
