"""Cleaning pipeline over ``documents``: each stage reads what the one before it kept."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.llm.common import body, store, table
from siftwork.llm.decontamination import decontaminate
from siftwork.llm.line_dedup import line_dedup
from siftwork.llm.mixing import mix_sources
from siftwork.llm.near_dedup import near_duplicate_rows
from siftwork.llm.quality import fit_rules, labelled_rows, score_quality

ORACLE_SQL = None  # the classifier has no SQL form; the stages are tested against brute force


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble accepts."""
    model = fit_rules(labelled_rows(docs, table(spark, sf_dir, "labels")))
    return score_quality(docs, model).where("predicted = 1").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that an earlier document holds; a document that lost all its lines goes."""
    out = line_dedup(docs).where((F.col("n_dropped") == 0) | (F.trim("kept_text") != ""))
    text = F.when(F.col("n_dropped") > 0, F.col("kept_text")).otherwise(F.col("text"))
    out = out.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of near duplicates (0.8 of five-word shingles)."""
    gone = near_duplicate_rows(docs, percent=80).where("NOT kept").select(F.col("doc_id").alias("_d"), F.col("t").alias("_t")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.xxhash64(body()) == F.col("_t"))
    return docs.join(gone, same, "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document."""
    return mix_sources(docs).where("taken > 0").select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [
    ("quality", quality),
    ("line_dedup", lines),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = store(docs, name)
    return docs
