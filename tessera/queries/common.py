"""What the registered queries share: tables, and pieces of SQL."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession

DIM = 64
QUERY_TEXT = "the of and that"
TERMS = ("the", "of", "and", "that")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@cache
def query_vector(dim: int = DIM) -> tuple[float, ...]:
    """A fixed query: small multiples of 1/8, which any arithmetic holds exactly."""
    return tuple(((i * 7) % 9 - 4) / 8 for i in range(dim))


def sql_vector(dim: int = DIM) -> str:
    return "[" + ", ".join(f"{x}::DOUBLE" for x in query_vector(dim)) + "]"


Q = sql_vector()
TOK = r"""tok AS (
  SELECT doc_id, list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}]+'), lambda x: lower(x)), lambda t: strlen(t) BETWEEN 2 AND 50) AS tokens FROM documents
)"""
POST = f"""{TOK}, post AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(tokens) AS term FROM tok) GROUP BY ALL
), len AS (SELECT doc_id, len(tokens) AS doc_len FROM tok
), st AS (SELECT count(*) AS n, avg(doc_len) AS avgdl FROM len
), df AS (SELECT term, count(*) AS df FROM post GROUP BY term)"""
VEC = "v AS (SELECT vec_id AS doc_id, embedding::DOUBLE[] AS v, label FROM embeddings WHERE len(embedding) = 64)"


def bm25_sql(delta: str = "1.0") -> str:
    return f"ln((n - df + 0.5) / (df + 0.5) + 1) * (tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * doc_len / avgdl)) + {delta}::DOUBLE)"


COS = f"CASE WHEN list_dot_product(v, v) = 0 THEN 0 ELSE least(1.0, greatest(0.0, list_dot_product(v, {Q}) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product({Q}, {Q}))))) END"
EUC = f"1 / (1 + list_distance(v, {Q}))"
DOT = f"list_dot_product(v, {Q})"
SIM = {"cosine": COS, "euclidean": EUC, "dot": DOT}


def topk(inner: str, k: int, ties: str = "ASC", by: str = "score DESC") -> str:
    return f"SELECT * FROM ({inner}) ORDER BY {by}, doc_id {ties} LIMIT {k}"
