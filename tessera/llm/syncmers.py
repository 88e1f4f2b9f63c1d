"""Operator 6: document fingerprints by closed syncmers.

A k-mer of characters is an anchor if its least inner s-mer (by hash) lies at its beginning or its end. That depends on
the k-mer alone, so the same passage has the same anchors wherever it stands; any K + K - S - 1 characters in common hold
an anchor in common at the same offset. Letters are lower-cased and all white space is a blank, one character for one, so
positions are those of the text.

One pass of ``mapInArrow`` without a shuffle; s-mer hashes are differences of prefix sums, window minima come by doubling.

Defined results: a null text gives null anchors; an empty one gives none; a text shorter than K has one anchor at 0, the
whole text; equal s-mers count as least wherever they lie, so each k-mer of a repetitive text may be an anchor; repeated
rows give repeated results, empty tables empty ones; columns with the output's names are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textops import Texts, category_table, chunks, lists, lower_hash_table, prefix_hash, slice_hash

K, S = 32, 16
ADDED = ["positions", "anchors"]

_state: dict[str, np.ndarray] = {}


def _symbols() -> np.ndarray:
    if "symbols" not in _state:
        t = lower_hash_table().copy()
        t[category_table() == 3] = t[32]
        _state["symbols"] = t
    return _state["symbols"]


def window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minima of all windows of w values."""
    have, out = 1, x
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def anchors(t: Texts, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions within their documents, hashes, offsets of the documents)."""
    size = np.diff(t.off)
    prefix = prefix_hash(_symbols()[t.cps])
    n = len(t.cps)
    at = np.empty(0, np.int64)
    if n >= k:
        start = np.arange(n - s + 1)
        h = slice_hash(prefix, start, start + s)
        low = window_min(h, k - s + 1)
        good = (low == h[: len(low)]) | (low == h[k - s :][: len(low)])
        inner = t.off[1:-1]
        cross = np.zeros(n + 1, np.int32)  # starts whose k-mer would run past their document's end
        ends = inner[inner > 0]
        np.add.at(cross, np.maximum(ends - k + 1, 0), 1)
        np.add.at(cross, ends, -1)
        at = np.flatnonzero(good & (np.cumsum(cross)[: len(low)] == 0))
    short = np.flatnonzero((size > 0) & (size < k))
    begin = np.concatenate((at, t.off[short]))
    end = np.concatenate((at + k, t.off[short] + size[short]))
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], end[order]
    off = np.searchsorted(begin, t.off)
    return (begin - np.repeat(t.off[:-1], np.diff(off))).astype(np.int32), slice_hash(prefix, begin, end).view(np.int64), off


def fingerprint(docs: DataFrame, text: str = "text", keep: list[str] | None = None, k: int = K, s: int = S) -> DataFrame:
    """``keep`` columns (all but the text by default) with positions and anchors, two arrays of one length."""
    if not 0 < s < k:
        raise ValueError("s must lie between 0 and k")
    names = [c for c in (keep if keep is not None else [c for c in docs.columns if c != text]) if c not in ADDED]
    inside = [f"c{i}" for i in range(len(names))]
    kinds = [T.StructField(i, docs.schema[c].dataType) for c, i in zip(names, inside, strict=True)]
    kinds += [T.StructField("positions", T.ArrayType(T.IntegerType())), T.StructField("anchors", T.ArrayType(T.LongType()))]

    def run(batches):
        for batch in batches:
            column = batch.column(len(inside))
            valid = np.asarray(pc.is_valid(column))
            for a, b, t in chunks(column):
                at, h, off = anchors(t, k, s)
                if valid[a:b].all():
                    two = [lists(at, off, pa.int32()), lists(h, off, pa.int64())]
                else:
                    of, mask = pa.array(off.astype(np.int32)), pa.array(~valid[a:b])
                    two = [pa.ListArray.from_arrays(of, pa.array(x), mask=mask) for x in (at, h)]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(len(inside))), *two], names=[*inside, *ADDED])

    source = docs.select(*(F.col(f"`{c}`").alias(i) for c, i in zip(names, inside, strict=True)), F.col(text).alias("t"))
    return source.mapInArrow(run, T.StructType(kinds)).toDF(*names, *ADDED)


def shared(left: DataFrame, right: DataFrame, k: int = K) -> DataFrame:
    """(id_a, id_b, shift, n, from_a, to_a): runs of anchors that two tables of fingerprints share at one distance; the ids
    are the tables' doc_id columns, to_a is the end of the last anchor. ``right`` is a stated set of passages, such as a benchmark:
    a passage that all of ``left`` has is found in each of its rows, once."""

    def flat(df: DataFrame, tag: str) -> DataFrame:
        z = df.select(F.col("doc_id").alias(f"id_{tag}"), F.explode(F.arrays_zip("positions", "anchors")).alias("z"))
        return z.select(f"id_{tag}", F.col("z.positions").alias(f"p_{tag}"), F.col("z.anchors").alias("anchor"))

    j = flat(left, "a").join(flat(right, "b"), "anchor").withColumn("shift", F.col("p_b") - F.col("p_a"))
    return j.groupBy("id_a", "id_b", "shift").agg(F.countDistinct("p_a").alias("n"), F.min("p_a").alias("from_a"), (F.max("p_a") + k).alias("to_a"))


def op6_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents."""
    return fingerprint(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


QUERIES = {"op6_syncmers": op6_syncmers}
ORACLES: dict[str, str] = {}
