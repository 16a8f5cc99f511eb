"""Feature tables, signature stores, score tables and keyed stores on parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.operators.common import assert_covers, assert_unique

EXTERNAL_SCORES = ("ifd", "s2l")


def write_features(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def read_features(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    d = spark.read.parquet(path)
    return d.select("sample_id", *columns) if columns else d


def features_for(features: DataFrame, candidates: DataFrame) -> DataFrame:
    """Features of the candidate ids; a candidate without features is an error."""
    assert_covers(features, candidates)
    return candidates.select("sample_id").join(features, "sample_id")


def write_signatures(df: DataFrame, path: str) -> None:
    """One folder per site, so that reading some sites reads only their files."""
    df.write.mode("overwrite").partitionBy("layer", "module").parquet(path)


def read_signatures(spark: SparkSession, path: str, sites: list[tuple[int, str]] | None = None) -> DataFrame:
    d = spark.read.parquet(path)
    if sites is None:
        return d
    if not sites:
        return d.where(F.lit(False))
    keep = F.lit(False)
    for layer, module in sites:
        keep = keep | ((F.col("layer") == layer) & (F.col("module") == module))
    return d.where(keep)


def join_external_scores(pool: DataFrame, scores: DataFrame) -> DataFrame:
    """Attach validated score columns: an id column, no repeated ids, every pool id covered."""
    if "sample_id" not in scores.columns:
        raise ValueError("a score table needs a sample_id column")
    present = [c for c in EXTERNAL_SCORES if c in scores.columns]
    assert_unique(scores)
    assert_covers(scores, pool)
    return pool.join(scores.select("sample_id", *present), "sample_id")


def read_external_scores(spark: SparkSession, path: str, pool: DataFrame) -> DataFrame:
    return join_external_scores(pool, spark.read.parquet(path))


def write_labels(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("peft_id", "task_id").parquet(path)


def write_selection(df: DataFrame, path: str, keys=("peft_id", "task_id")) -> None:
    """Selection with score, cluster and rank kept, one folder per (config, task)."""
    df.write.mode("overwrite").partitionBy(*keys).parquet(path)


def only_new(keyed: DataFrame, stored: DataFrame, key: str = "cache_key") -> DataFrame:
    """Rows whose key is not stored yet: the part a resumed job has to compute."""
    return keyed.join(stored.select(key), key, "left_anti")


def write_report(df: DataFrame, path: str) -> None:
    """CSV of an aggregated report (a few rows, hence one file)."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
