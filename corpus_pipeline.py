"""From raw documents to token ids in five stages; each is written as Parquet and read again as the next one's input."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, jaccard, linededup, mixing, quality, textops


def _aside(docs: DataFrame, names: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """The documents with their own columns of these names renamed, and how to name them back."""
    taken = {c: f"__own_{c}" for c in docs.columns if c in names}
    return docs.withColumnsRenamed(taken), {v: k for k, v in taken.items()}


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier of the labels table keeps; low quality, toxic and empty ones go, null texts among them.
    Repeated rows go or stay together; without labels, or in an empty table, every text that has a word stays."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(docs, quality.graded(labels))
    rows, back = _aside(docs, quality.SCORES)
    return quality.score(rows, model).where("keep").drop(*quality.SCORES).withColumnsRenamed(back).select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand earlier in the corpus; those of which nothing is left go. Null texts and texts that
    lose no line stay as they are; repeated rows lose the same lines; equal lines stay with the least id."""
    added = ["n_lines", "n_dropped"]
    rows, back = _aside(docs, added)
    out = linededup.LineIndex(spark).insert(rows)
    out = out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long"))
    out = out.where((F.col("n_dropped") == 0) | (F.length(F.btrim("text", F.lit(" \t\r\n"))) > 0))
    return out.drop(*added).withColumnsRenamed(back).select(docs.columns)


def _one_row_each(docs: DataFrame) -> DataFrame:
    """One row for each id: of rows that share one, that of the least hash. Rows without an id stay. Only the rows of repeated
    ids are aggregated, before they move."""
    again = textops.written(docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if again.isEmpty():
        return docs
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    one = docs.join(again, "doc_id", "left_semi").select("doc_id", row.alias("row"), F.xxhash64(row).alias("h")).groupBy("doc_id").agg(F.min_by("row", "h").alias("row"))
    return docs.join(again, "doc_id", "left_anti").select(docs.columns).unionByName(one.select("row.*"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the least id. Repeated rows, and rows that share an id, are one
    document and leave one row. Rows without an id, and texts without a word, have no copies and stay; an empty table stays
    empty."""
    gone = jaccard.groups(docs).where("doc_id <> first").select("doc_id")
    return _one_row_each(docs.join(gone.hint("shuffle_hash"), "doc_id", "left_anti").select(docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's weight, the root of its size, asks for; the size of the whole stays. A null source is a
    source, null and empty texts have size 1, and rows of one id and source are copied alike."""
    return mixing.mixed(docs, mixing.plan(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and byte offsets in place of texts, for every row; null for a null text, none for an empty one."""
    return bpe.encode(docs)


STAGES = [
    ("quality classifier", quality_filter),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE", encode),
]

#: The classifier, the random rounding and BPE have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = f"{textops.own_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{at}/{i}")
        docs = spark.read.schema(out.schema).parquet(f"{at}/{i}")
        if i:
            textops.delete(spark, f"{at}/{i - 1}")  # the next stage has all that is needed of it
    return docs
