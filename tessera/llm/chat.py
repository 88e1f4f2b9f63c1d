"""Operator 10: chat formatting by a finite-state machine over roles and a declarative template.

A template names for each role the text before and after its turns, whether the turn's text and its end carry loss, which
role may follow which state, and in which states a conversation may end. The machine runs over a conversation's turns as a
fold inside the JVM (``aggregate``); one shuffle brings a conversation's turns together.

A conversation is valid if no turn has a fault and an accepting state is reached; open turns behind the last accepting state
(a question without an answer) are left out and counted as trimmed. The first fault, wherever it stands, makes it invalid.

Defined results, in the order in which faults are looked for at each turn: "turn without number", "repeated turn" (the number of the
turn before, with another role or text: rows that are wholly equal count once), "unknown role" (a null one too), "role
out of order", "turn without text" (null; an empty text is a turn without a text segment); then "unfinished" where no
accepting state is reached, at the last turn. Turn numbers may have gaps and begin anywhere. Rows without a conversation id
belong to one conversation without id, with the fault "conversation without id". An empty table gives no rows; other columns
aren't looked at. Very long texts and conversations are kept whole.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Role:
    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """follows: state -> roles that may come next; a role's name is the state after its turn, "start" the first."""

    roles: dict[str, Role]
    follows: dict[str, tuple[str, ...]]
    accepts: tuple[str, ...]
    begin: str = ""
    extra: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        for state, nexts in self.follows.items():
            for r in (state, *nexts):
                if r != "start" and r not in self.roles:
                    raise ValueError(f"the template has no role {r!r}")
        for r in self.accepts:
            if r not in self.roles:
                raise ValueError(f"the template has no role {r!r}")


DEFAULT = Template(
    roles={
        "system": Role("<|system|>\n", "<|end|>\n"),
        "user": Role("<|user|>\n", "<|end|>\n"),
        "assistant": Role("<|assistant|>\n", "<|end|>\n", loss=True),
    },
    follows={"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)},
    accepts=("assistant",),
    begin="<|begin|>",
)


def _map(d: dict[str, Column]) -> Column:
    return F.create_map(*(x for k, v in d.items() for x in (F.lit(k), v)))


def _pieces(t: Column, template: Template) -> Column:
    """The segments of one turn: before, text, after."""
    before = F.try_element_at(_map({k: F.lit(r.before) for k, r in template.roles.items()}), t["role"])
    after = F.try_element_at(_map({k: F.lit(r.after) for k, r in template.roles.items()}), t["role"])
    loss = F.try_element_at(_map({k: F.lit(r.loss) for k, r in template.roles.items()}), t["role"])

    def one(text: Column, flag: Column) -> Column:
        return F.struct(text.alias("text"), flag.alias("loss"))

    return F.array(one(before, F.lit(False)), one(t["text"], loss), one(after, loss))


def formatted(turns: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """(conv_id, valid, error, error_turn, turns, trimmed, segments): one row a conversation; segments is an array of
    (text, loss), empty where it isn't valid."""
    # Rows without an id, however many, are counted and not gathered.
    t = turns.where("conv_id IS NOT NULL").select("conv_id", F.struct(F.col("turn").cast("long").alias("turn"), F.col("role"), F.col("text")).alias("t"))
    # nulls sort first, so a missing number is met before anything else
    t = t.groupBy("conv_id").agg(F.array_sort(F.collect_set("t"), _compare).alias("ts"))
    allowed = F.array(*(F.lit(f"{s}>{r}") for s, rs in template.follows.items() for r in rs))
    roles = F.array(*(F.lit(r) for r in template.roles))
    accepts = F.array(*(F.lit(r) for r in template.accepts))
    none = F.lit(None)

    def step(acc: Column, x: Column) -> Column:
        fault = (
            F.when(x["turn"].isNull(), "turn without number")
            .when(F.coalesce(acc["turn"] == x["turn"], F.lit(False)), "repeated turn")
            .when(x["role"].isNull() | ~F.array_contains(roles, F.coalesce(x["role"], F.lit(""))), "unknown role")
            .when(~F.array_contains(allowed, F.concat(acc["state"], F.lit(">"), F.coalesce(x["role"], F.lit("")))), "role out of order")
            .when(x["text"].isNull(), "turn without text")
        )
        stop = acc["error"].isNotNull()
        here = acc["n"] + 1
        good = fault.isNull() & ~stop
        return F.struct(
            F.when(good, x["role"]).otherwise(acc["state"]).alias("state"),
            F.when(stop, acc["error"]).otherwise(fault).alias("error"),
            F.when(stop, acc["turn"]).otherwise(x["turn"]).alias("turn"),
            here.alias("n"),
            F.when(good & F.array_contains(accepts, F.coalesce(x["role"], F.lit(""))), here).otherwise(acc["last"]).alias("last"),
        )

    start = F.struct(F.lit("start").alias("state"), none.cast("string").alias("error"), none.cast("long").alias("turn"), F.lit(0).alias("n"), F.lit(0).alias("last"))
    t = t.withColumn("a", F.aggregate("ts", start, step))
    error = F.when(F.col("a.error").isNotNull(), F.col("a.error")).when(F.col("a.last") == 0, "unfinished")
    t = t.withColumn("error", error)
    valid = F.col("error").isNull()
    used = F.slice("ts", F.lit(1), F.greatest(F.col("a.last"), F.lit(0)))
    body = F.flatten(F.transform(used, lambda x: _pieces(x, template)))
    whole = F.concat(F.array(F.struct(F.lit(template.begin).alias("text"), F.lit(False).alias("loss"))), body)
    kept = F.filter(whole, lambda s: F.length(s["text"]) > 0)
    out = t.select(
        "conv_id",
        valid.alias("valid"),
        "error",
        F.when(~valid, F.col("a.turn")).alias("error_turn"),
        F.size("ts").cast("long").alias("turns"),
        F.when(valid, F.size("ts") - F.col("a.last")).cast("long").alias("trimmed"),
        F.when(valid, kept).otherwise(F.slice(kept, 1, 0)).alias("segments"),
    )
    lost = turns.where("conv_id IS NULL").select("turn", "role", "text").distinct().agg(F.count(F.lit(1)).alias("turns")).where("turns > 0")
    null = {f.name: F.lit(None).cast(f.dataType) for f in out.schema}
    null |= {"valid": F.lit(False), "error": F.lit("conversation without id"), "turns": F.col("turns"), "segments": F.array().cast(out.schema["segments"].dataType)}
    return out.unionByName(lost.select(*(null[c].alias(c) for c in out.columns)))


def _compare(x: Column, y: Column) -> Column:
    """Turn, then role, then text; nulls first."""

    def by(c: str) -> Column:
        a, b = x[c], y[c]
        return F.when(a.isNull() & b.isNull(), 0).when(a.isNull(), -1).when(b.isNull(), 1).when(a < b, -1).when(a > b, 1).otherwise(0)

    return F.when(by("turn") != 0, by("turn")).when(by("role") != 0, by("role")).otherwise(by("text"))


def segments(turns: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """The same with one row a segment, numbered from 0; a conversation that isn't valid has one row without a segment."""
    f = formatted(turns, template).select("conv_id", "valid", "error", "error_turn", "turns", "trimmed", F.posexplode_outer("segments").alias("segment", "s"))
    return f.select("conv_id", "valid", "error", "error_turn", "turns", "trimmed", F.col("segment").cast("long").alias("segment"), F.col("s.text").alias("text"), F.col("s.loss").alias("loss"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of all conversations by the default template."""
    return segments(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES = {"op10_chat": op10_chat}
ORACLES = {
    "op10_chat": r"""
WITH d AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations
), o AS (
  SELECT *, row_number() OVER w AS rn, lag(turn) OVER w AS pt, coalesce(lag(role) OVER w, 'start') AS state
  FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)
), f AS (
  SELECT *, CASE WHEN turn IS NULL THEN 'turn without number' WHEN turn = pt THEN 'repeated turn'
    WHEN role IS NULL OR role NOT IN ('system', 'user', 'assistant') THEN 'unknown role'
    WHEN state || '>' || role NOT IN ('start>system', 'start>user', 'system>user', 'user>assistant', 'assistant>user') THEN 'role out of order'
    WHEN text IS NULL THEN 'turn without text' END AS fault
  FROM o
), c AS (
  SELECT conv_id, count(*) AS turns, coalesce(max(CASE WHEN role = 'assistant' THEN rn END), 0) AS last,
         min_by(fault, rn) FILTER (WHERE fault IS NOT NULL) AS fault, min_by(turn, rn) FILTER (WHERE fault IS NOT NULL) AS fault_turn, max(turn) AS last_turn
  FROM f GROUP BY conv_id
), e AS (
  SELECT *, CASE WHEN conv_id IS NULL THEN 'conversation without id' WHEN fault IS NOT NULL THEN fault WHEN last = 0 THEN 'unfinished' END AS error FROM c
), p AS (
  SELECT conv_id, 0 AS rn, 0 AS k, '<|begin|>' AS text, false AS loss FROM e WHERE error IS NULL
  UNION ALL SELECT f.conv_id, f.rn, x.k,
    CASE x.k WHEN 0 THEN '<|' || f.role || '|>' || chr(10) WHEN 1 THEN f.text ELSE '<|end|>' || chr(10) END, x.k > 0 AND f.role = 'assistant'
  FROM f JOIN e ON f.conv_id = e.conv_id AND e.error IS NULL AND f.rn <= e.last, (VALUES (0), (1), (2)) AS x(k)
), s AS (SELECT conv_id, text, loss, row_number() OVER (PARTITION BY conv_id ORDER BY rn, k) - 1 AS segment FROM p WHERE text <> '')
SELECT e.conv_id, e.error IS NULL AS valid, e.error,
       CASE WHEN e.error IS NOT NULL AND e.conv_id IS NOT NULL THEN CASE WHEN e.fault IS NOT NULL THEN e.fault_turn ELSE e.last_turn END END AS error_turn,
       e.turns, CASE WHEN e.error IS NULL THEN e.turns - e.last END AS trimmed, s.segment, s.text, s.loss
FROM e LEFT JOIN s ON s.conv_id = e.conv_id
"""
}
