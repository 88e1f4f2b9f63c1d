"""Operator 3: reversible, incremental line dedup.

State is a folder with two tables: ``references``, one row for each occurrence of a line (an exact reference-count table:
a line's count is its number of rows), and ``filters``, a cuckoo filter for each shard of the line hashes. An insertion
probes the filters first; only lines that they may hold are looked up in the exact table. A deletion takes the documents'
references away and removes from the filters the lines whose count falls to zero, so that a line whose owner goes is kept
again in the next document that has it.

A line is the text between newlines without blanks at its edges; it is known by 128 bits of hash. Blank lines are left
alone. The first occurrence in the order (insertion, document id with null last, text, line number) stays, all others go,
within one document too. The result doesn't depend on partitions.

Lines move as hashes (40 bytes each). Occurrences of one line are aggregated before they move, so that a shard's task meets a
line once however often it occurs; texts move once, to meet the numbers of their dropped lines, by a hash join without a sort.

Defined results: a null text stays null, with 0 lines; a text all of whose lines go becomes empty; repeated rows (same id
and text) are one document, so they keep or lose lines alike; rows of one id with other texts are told apart by the text;
empty tables give empty results; ids are integers of any width, other types are an error; other columns stay as they
are, whatever their names, but n_lines and n_dropped of the input are replaced.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources import generations

from .textops import U64, long_id, mix64, own_folder, written

#: Line occurrences of one shard, about: what a task holds in memory (40 bytes each).
SHARD_LINES = 1 << 19
SLOTS = 4


class Cuckoo:
    """Segments of buckets with four 16-bit fingerprints; a further segment is added when one is full. 0 is free."""

    def __init__(self, segments: list[np.ndarray] | None = None):
        self.segments = segments or []

    @staticmethod
    def load(data: bytes) -> Cuckoo:
        head, _, rest = data.partition(b"\n")
        at, out = 0, []
        for n in json.loads(head):
            out.append(np.frombuffer(rest, np.uint16, n * SLOTS, at).reshape(n, SLOTS).copy())
            at += n * SLOTS * 2
        return Cuckoo(out)

    def dump(self) -> bytes:
        return json.dumps([len(s) for s in self.segments]).encode() + b"\n" + b"".join(s.tobytes() for s in self.segments)

    @staticmethod
    def _where(k1: np.ndarray, k2: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        fp = (k2 >> U64(48)).astype(np.uint16)
        fp[fp == 0] = 1
        return fp, (mix64(k1) & U64(n - 1)).astype(np.int64)

    @staticmethod
    def _other(at: np.ndarray, fp: np.ndarray, n: int) -> np.ndarray:
        return at ^ (mix64(fp.astype(U64)) & U64(n - 1)).astype(np.int64)

    def holds(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        out = np.zeros(len(k1), bool)
        for s in self.segments:
            fp, a = self._where(k1, k2, len(s))
            out |= (s[a] == fp[:, None]).any(1) | (s[self._other(a, fp, len(s))] == fp[:, None]).any(1)
        return out

    def add(self, k1: np.ndarray, k2: np.ndarray) -> None:
        """Distinct keys; what the last segment can't take goes into a new one."""
        todo = np.arange(len(k1))
        if self.segments and len(todo):
            todo = todo[self._fill(self.segments[-1], k1[todo], k2[todo])]
        while len(todo):
            size = 1 << max(4, int(np.ceil(np.log2(len(todo) / (SLOTS * 0.8) + 1))))
            self.segments.append(np.zeros((size, SLOTS), np.uint16))
            todo = todo[self._fill(self.segments[-1], k1[todo], k2[todo])]

    def _fill(self, s: np.ndarray, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        """Places keys as long as the segment is under 90 % full; returns the positions of those that stay out."""
        n = len(s)
        room = int(0.9 * n * SLOTS) - int((s != 0).sum())
        fp, at = self._where(k1, k2, n)
        out = np.arange(max(0, room), len(fp))
        todo = np.arange(min(len(fp), max(0, room)))
        for turn in range(400):
            if not len(todo):
                break
            a = at[todo]
            if turn == 0:  # first the bucket of the two that has room
                b = self._other(a, fp[todo], n)
                a = np.where((s[a] == 0).any(1), a, b)
                at[todo] = a
            first = np.zeros(len(todo), bool)
            first[np.unique(a, return_index=True)[1]] = True
            mine, b = todo[first], a[first]
            free = s[b] == 0
            slot = np.where(free.any(1), free.argmax(1), (turn + mine) % SLOTS)
            old = s[b, slot]
            s[b, slot] = fp[mine]
            fp[mine] = old
            moved = old != 0
            at[mine[moved]] = self._other(b[moved], old[moved], n)
            todo = np.concatenate((todo[~first], mine[moved]))
        if len(todo):
            self.segments[len(self.segments) - 1 : len(self.segments) - 1] = self._overflow(s, fp[todo], at[todo])
        return out

    def _overflow(self, s: np.ndarray, fp: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
        """Fingerprints that found no place, in segments of as many buckets, so that their two places stay the same."""
        out = []
        while len(fp):
            over, left = np.zeros_like(s), []
            for i, (f, a) in enumerate(zip(fp, at.tolist(), strict=True)):
                other = int(self._other(np.array([a]), np.array([f]), len(s))[0])
                place = next((x for x in (a, other) if (over[x] == 0).any()), None)
                if place is None:
                    left.append(i)
                else:
                    over[place, (over[place] == 0).argmax()] = f
            out.append(over)
            fp, at = fp[left], at[left]
        return out

    def remove(self, k1: np.ndarray, k2: np.ndarray) -> None:
        """Takes one fingerprint away for each key; the keys must have been added. A bucket gives one at a turn."""
        todo = np.arange(len(k1))
        for s in self.segments:
            if not len(todo):
                break
            fp, a = self._where(k1[todo], k2[todo], len(s))
            done = np.zeros(len(todo), bool)
            for bucket in (a, self._other(a, fp, len(s))):
                left = np.flatnonzero(~done)
                while len(left):
                    same = s[bucket[left]] == fp[left][:, None]
                    has = same.any(1)
                    left, slot = left[has], same[has].argmax(1)
                    first = np.zeros(len(left), bool)
                    first[np.unique(bucket[left], return_index=True)[1]] = True
                    s[bucket[left[first]], slot[first]] = 0
                    done[left[first]] = True
                    left = left[~first]
            todo = todo[~done]


def _u64(column) -> np.ndarray:
    return np.asarray(column, np.int64).view(U64)


def occurrences(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, version, pos, k1, k2) of every line that isn't blank; version tells texts of one id apart."""
    line = F.btrim(F.col("line"), F.lit(" \t\r"))
    d = docs.select(long_id(docs).alias("doc_id"), F.xxhash64(f"`{text}`").alias("version"), F.posexplode(F.split(F.col(f"`{text}`"), "\n", -1)).alias("pos", "line"))
    return d.where(F.length(line) > 0).select("doc_id", "version", "pos", F.xxhash64(line).alias("k1"), F.xxhash64(F.lit(7), line).alias("k2")).dropDuplicates(["doc_id", "version", "pos"])


_REFERENCE = "doc_id long, version long, pos int, k1 long, k2 long, generation long"


def _first() -> Column:
    """The earliest of the occurrences that are aggregated."""
    return F.min(F.struct(F.col("generation"), F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("version"), F.col("pos")))


def _later(lines: DataFrame, firsts: DataFrame) -> DataFrame:
    """(doc_id, version, pos) of the occurrences that aren't their line's first; of lines whose first is null, all."""
    f = firsts.select("k1", "k2", F.col("first.doc_id").alias("d"), F.col("first.version").alias("v"), F.col("first.pos").alias("p"), F.col("first.generation").alias("g"))
    j = lines.join(f, ["k1", "k2"])
    own = (F.col("generation") == F.col("g")) & F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("version") == F.col("v")) & (F.col("pos") == F.col("p"))
    return j.where(~F.coalesce(own, F.lit(False))).select("doc_id", "version", "pos")


_OUT = "shard long, k1 long, k2 long, filter binary"


def _insert_shard(keys: pa.Table, state: pa.Table) -> pa.Table:
    """Keys of one shard that are known already, and the shard's filter with the others."""
    cuckoo, known, shard = Cuckoo(), set(), None
    for table in (keys, state):
        if table.num_rows:
            shard = table.column("shard")[0].as_py()
    for blob in state.column("filter").to_pylist():
        if blob is not None:
            cuckoo = Cuckoo.load(blob)
    k1, k2 = _u64(keys.column("k1")), _u64(keys.column("k2"))
    old = state.filter(state.column("k1").is_valid())
    known = set(zip(_u64(old.column("k1")).tolist(), _u64(old.column("k2")).tolist(), strict=True))
    taken = np.fromiter((x in known for x in zip(k1.tolist(), k2.tolist(), strict=True)), bool, len(k1)) if known else np.zeros(len(k1), bool)
    cuckoo.add(k1[~taken], k2[~taken])
    n = int(taken.sum())
    return pa.table(
        {
            "shard": pa.array(np.full(n + 1, shard, np.int64)),
            "k1": pa.concat_arrays([pa.array(k1[taken].view(np.int64)), pa.nulls(1, pa.int64())]),
            "k2": pa.concat_arrays([pa.array(k2[taken].view(np.int64)), pa.nulls(1, pa.int64())]),
            "filter": pa.concat_arrays([pa.nulls(n, pa.binary()), pa.array([cuckoo.dump()], pa.binary())]),
        }
    )


def _probe_shard(lines: pa.Table, state: pa.Table) -> pa.Table:
    """Keys of one shard that its filter may hold."""
    k1, k2 = _u64(lines.column("k1")), _u64(lines.column("k2"))
    hit = np.zeros(len(k1), bool)
    if state.num_rows and len(k1):
        hit = Cuckoo.load(state.column("filter")[0].as_py()).holds(k1, k2)
    return lines.select(["shard", "k1", "k2"]).filter(pa.array(hit))


def _remove_shard(keys: pa.Table, state: pa.Table) -> pa.Table:
    if not state.num_rows:
        return pa.table({"shard": pa.array([], pa.int64()), "filter": pa.array([], pa.binary())})
    cuckoo = Cuckoo.load(state.column("filter")[0].as_py())
    cuckoo.remove(_u64(keys.column("k1")), _u64(keys.column("k2")))
    return pa.table({"shard": pa.array([state.column("shard")[0].as_py()], pa.int64()), "filter": pa.array([cuckoo.dump()], pa.binary())})


_MANIFEST = "kind string, name string, path string, number long"
_STATE = "shard long, filter binary, k1 long, k2 long"


class LineIndex:
    """The lines of all documents inserted so far, in a folder that all executors share; any session that opens the folder goes on
    with what the last one left. The manifest, of which the highest whole generation counts, names the tables: a job that fails
    leaves the state as it was. A batch that has a name is inserted once; to insert it again gives the same result.

    Shards are doubled, and their filters made anew from the references, as the lines grow."""

    def __init__(self, spark: SparkSession, path: str | None = None, shard_lines: int = SHARD_LINES):
        self.spark, self.shard_lines = spark, shard_lines
        self.path = path or f"{own_folder(spark)}/lines-{uuid.uuid4().hex}"
        self.generation, self.shards, self.lines = 0, 0, 0
        self._references: list[str] = []
        self._filters: str | None = None
        self._batches: dict[str, str] = {}
        for r in generations.current(spark, f"{self.path}/manifest", _MANIFEST).collect():
            if r.kind == "references":
                self._references.append(r.path)
            elif r.kind == "filters":
                self._filters = r.path
            elif r.kind == "batch":
                self._batches[r.name] = r.path
            else:
                setattr(self, r.kind, r.number)

    def _table(self, df: DataFrame, name: str) -> str:
        at = f"{self.path}/{name}-{self.generation}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(at)
        return at

    def _commit(self, references: list[str], filters: str | None, batches: dict[str, str], lines: int) -> None:
        rows = [("references", "", p, 0) for p in references] + [("batch", b, p, 0) for b, p in batches.items()]
        rows += [("filters", "", filters, 0)] * bool(filters) + [(k, "", "", n) for k, n in (("generation", self.generation + 1), ("shards", self.shards), ("lines", lines))]
        generations.replace(self.spark.createDataFrame(rows, _MANIFEST).coalesce(1), f"{self.path}/manifest")
        self._references, self._filters, self._batches, self.lines = references, filters, batches, lines
        self.generation += 1

    @property
    def references(self) -> DataFrame:
        """(doc_id, version, pos, k1, k2, generation) of every live occurrence."""
        if not self._references:
            return self.spark.createDataFrame([], _REFERENCE)
        return self.spark.read.schema(_REFERENCE).parquet(*self._references)

    @property
    def filters(self) -> DataFrame:
        """(shard, filter)."""
        if self._filters is None:
            return self.spark.createDataFrame([], "shard long, filter binary")
        return self.spark.read.schema("shard long, filter binary").parquet(self._filters).where("filter IS NOT NULL")

    def _grown(self, lines: int) -> DataFrame:
        """The filters, for as many shards as so many lines take: a power of two."""
        wanted = 1 << max(0, int(np.ceil(np.log2(max(1, lines / self.shard_lines)))))
        if wanted <= self.shards:
            return self.filters
        self.shards = wanted
        if not self._references:
            return self.filters
        keys = self.references.select(self._shard(), "k1", "k2").distinct()
        empty = self.spark.createDataFrame([], _STATE)
        return written(keys.groupBy("shard").cogroup(empty.groupBy("shard")).applyInArrow(_insert_shard, _OUT).select("shard", "filter"), self.spark)

    def _shard(self) -> Column:
        return F.pmod("k1", F.lit(self.shards)).cast("long").alias("shard")

    def insert(self, docs: DataFrame, text: str = "text", batch: str | None = None) -> DataFrame:
        """Adds documents; returns their rows with the text that is left, n_lines and n_dropped."""
        return apply_drops(docs, self.drops(docs, text, batch), text)

    def drops(self, docs: DataFrame, text: str = "text", batch: str | None = None) -> DataFrame:
        """Adds documents; returns (doc_id, version, pos) of the lines that go."""
        gone = "doc_id long, version long, pos int"
        if batch is not None and batch in self._batches:
            return self.spark.read.schema(gone).parquet(self._batches[batch])
        at = self._table(occurrences(docs, text).withColumn("generation", F.lit(self.generation).cast("long")), "references")
        lines = self.spark.read.schema(_REFERENCE).parquet(at)
        total, shards = self.lines + lines.count(), self.shards
        try:
            filters = self._grown(total)
            # Occurrences of a line are aggregated before they move; what meets the filters is one row a line.
            keys = written(lines.groupBy("k1", "k2").agg(_first().alias("first"), F.count(F.lit(1)).alias("n")).withColumn("shard", self._shard()), self.spark)
            here = keys.select("shard", "k1", "k2")
            state = filters.select("shard", "filter", F.lit(None).cast("long").alias("k1"), F.lit(None).cast("long").alias("k2"))
            if self._references:
                maybe = here.groupBy("shard").cogroup(filters.groupBy("shard")).applyInArrow(_probe_shard, "shard long, k1 long, k2 long")
                known = maybe.join(self.references.select("k1", "k2"), ["k1", "k2"], "left_semi")
                state = state.unionByName(known.select("shard", F.lit(None).cast("binary").alias("filter"), "k1", "k2"))
            out = self._table(here.groupBy("shard").cogroup(state.groupBy("shard")).applyInArrow(_insert_shard, _OUT), "filters")
            taken = self.spark.read.schema(_OUT).parquet(out).where("filter IS NULL").select("k1", "k2", F.lit(True).alias("taken"))
            some = keys.join(taken, ["k1", "k2"], "left").where("taken OR n > 1").select("k1", "k2", F.when(F.col("taken").isNull(), F.col("first")).alias("first"))
            drops = self._table(_later(lines, some), "drops")
            self._commit([*self._references, at], out, self._batches | ({batch: drops} if batch is not None else {}), total)
        except BaseException:
            self.shards = shards
            raise
        return self.spark.read.schema(gone).parquet(drops)

    def delete(self, ids: DataFrame) -> None:
        """Takes the documents of the column doc_id out of the index; unknown ids change nothing."""
        if not self._references:
            return
        gone = ids.select(long_id(ids).alias("doc_id")).distinct()
        at = self._table(self.references.join(gone, "doc_id", "left_anti").select("doc_id", "version", "pos", "k1", "k2", "generation"), "references")
        left = self.spark.read.schema(_REFERENCE).parquet(at)
        keys = self.references.join(gone, "doc_id", "left_semi").select("k1", "k2").distinct().join(left.select("k1", "k2"), ["k1", "k2"], "left_anti")
        keys = keys.select(self._shard(), "k1", "k2")
        filters = self._table(keys.groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInArrow(_remove_shard, "shard long, filter binary"), "filters")
        self._commit([at], filters, self._batches, left.count())

    def counts(self) -> DataFrame:
        """(k1, k2, n): how often each live line occurs."""
        return self.references.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"))

    def current_drops(self) -> DataFrame:
        """(doc_id, version, pos) of all live lines that aren't the first of their kind, after insertions and deletions."""
        lines = self.references
        return _later(lines, lines.groupBy("k1", "k2").agg(_first().alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"))

    def clean(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """Live documents as the index now has them."""
        return apply_drops(docs, self.current_drops(), text)


def apply_drops(docs: DataFrame, drops: DataFrame, text: str = "text") -> DataFrame:
    """Documents without the dropped lines. Texts travel as their lines, so that the lines that stay are gathered by number:
    the time is linear in a document's lines. The other columns travel as one, whatever their names."""
    d = drops.groupBy(F.col("doc_id").alias("of"), F.col("version").alias("its")).agg(F.collect_list("pos").alias("gone"))
    rest = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    lines = F.split(F.col(f"`{text}`"), "\n", -1).alias("lines")
    row = F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in rest if c != text)).alias("row")
    t = docs.select(row, long_id(docs).alias("id"), F.xxhash64(f"`{text}`").alias("version"), lines)
    j = t.join(d.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("of")) & (F.col("version") == F.col("its")), "left")
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    left = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.transform(kept, lambda i: F.get("lines", i)))
    own = F.array_join(left, "\n")
    n_lines = F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines")).cast("long")
    n_dropped = F.coalesce(F.size("gone"), F.lit(0)).cast("long")
    return j.select(*(own.alias(c) if c == text else F.col("row")[c].alias(c) for c in rest), n_lines.alias("n_lines"), n_dropped.alias("n_dropped"))


def linededup_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English documents inserted, then all others, then the toxic ones deleted: what the index leaves of those that live."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    gone = spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic = 1").select("doc_id")
    first = F.coalesce(F.col("lang") == "en", F.lit(False))
    index = LineIndex(spark)
    index.drops(docs.where(first), batch="english")
    index.drops(docs.where(~first), batch="others")
    index.delete(gone)
    return index.clean(docs.join(gone, "doc_id", "left_anti").select("doc_id", "text"))


def op3_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents inserted into an empty index: doc_id, the text that is left, lines and dropped lines."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return LineIndex(spark).insert(docs)


QUERIES = {"op3_linededup": op3_linededup, "linededup_history": linededup_history}
ORACLES = {
    "op3_linededup": r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents WHERE text IS NOT NULL
), k AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS key FROM l
), r AS (
  SELECT *, CASE WHEN key = '' THEN 1 ELSE row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS LAST, pos) END AS rn FROM k
)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE rn = 1), '') AS text,
       count(*) AS n_lines, count(*) FILTER (WHERE rn > 1) AS n_dropped
FROM r GROUP BY doc_id
UNION ALL SELECT doc_id, NULL, 0, 0 FROM documents WHERE text IS NULL
""",
    "linededup_history": r"""
WITH d AS (SELECT doc_id, text, CASE WHEN lang = 'en' THEN 0 ELSE 1 END AS batch FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)
), l AS (
  SELECT doc_id, batch, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d WHERE text IS NOT NULL
), k AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS key FROM l
), r AS (
  SELECT *, CASE WHEN key = '' THEN 1 ELSE row_number() OVER (PARTITION BY key ORDER BY batch, doc_id NULLS LAST, pos) END AS rn FROM k
)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE rn = 1), '') AS text,
       count(*) AS n_lines, count(*) FILTER (WHERE rn > 1) AS n_dropped
FROM r GROUP BY doc_id
UNION ALL SELECT doc_id, NULL, 0, 0 FROM d WHERE text IS NULL
""",
}
