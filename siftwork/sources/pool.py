"""Pools and sketches as JSON lines and JSON documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.functions.ids import sample_id
from siftwork.operators.common import assert_not_empty, assert_unique


def parse_pool(
    lines: DataFrame, instr_key: str = "instruction", resp_key: str = "response", source_key: str = "source"
) -> DataFrame:
    """Parse JSON lines (column ``value``); blank lines go, bad ones keep their text in ``bad_line``."""
    schema = f"`{instr_key}` string, `{resp_key}` string, `{source_key}` string, language string, _bad string"
    d = lines.where(F.trim("value") != "")
    d = d.withColumn("j", F.from_json("value", schema, {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"}))
    i, r = F.col("j")[instr_key], F.col("j")[resp_key]
    bad = F.col("j").isNull() | F.col("j._bad").isNotNull() | i.isNull() | r.isNull()
    keep = [c for c in lines.columns if c != "value"]
    return d.select(
        *keep,
        i.alias("instruction"),
        r.alias("response"),
        F.col("j")[source_key].alias("source"),
        F.col("j.language").alias("language"),
        F.when(bad, F.col("value")).alias("bad_line"),
    )


def good_rows(parsed: DataFrame) -> DataFrame:
    d = parsed.where(F.col("bad_line").isNull()).drop("bad_line")
    return d.withColumn("sample_id", sample_id())


def quarantine(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("bad_line").isNotNull())


def read_pool(spark: SparkSession, path: str, *, strict: bool = True, unique: bool = True, **keys) -> DataFrame:
    """A JSONL pool. Strict: a bad row is an error naming file and text; else bad rows are left out."""
    lines = spark.read.text(path).withColumn("file", F.col("_metadata.file_name"))
    parsed = parse_pool(lines, **keys)
    if strict:
        first = quarantine(parsed).select("file", "bad_line").head()
        if first is not None:
            raise ValueError(f"{first['file']}: not a pool row: {first['bad_line'][:200]}")
    d = assert_not_empty(good_rows(parsed).drop("file"))
    return assert_unique(d) if unique else d.dropDuplicates(["sample_id"])


def pool_lines(pool: DataFrame) -> DataFrame:
    cols = [c for c in ("sample_id", "instruction", "response", "source", "language", "meta") if c in pool.columns]
    return pool.select(F.to_json(F.struct(*cols)).alias("value"))


def write_pool(pool: DataFrame, path: str) -> None:
    pool_lines(pool).write.mode("overwrite").text(path)


def take(pool: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows by id in request order. ``ids`` is (position, sample_id); unknown ids have found = false."""
    return ids.join(pool.withColumn("found", F.lit(True)), "sample_id", "left").withColumn(
        "found", F.coalesce("found", F.lit(False))
    )


def sketch_document(members: DataFrame, task_id: str, seed: int = 0) -> DataFrame:
    """One JSON document of a sketch. A sketch has a few dozen rows by definition."""
    row = F.struct("sample_id", "instruction", "response", "source", "language")
    doc = members.agg(F.sort_array(F.collect_list(row)).alias("samples"))
    return doc.select(
        F.to_json(F.struct(F.lit(task_id).alias("task_id"), F.lit(seed).alias("sketch_seed"), "samples")).alias("value")
    )


SKETCH_SCHEMA = (
    "task_id string, sketch_seed int, samples array<struct<sample_id:string,instruction:string,"
    "response:string,source:string,language:string>>"
)


def parse_sketches(documents: DataFrame) -> DataFrame:
    """One row per sketch member."""
    d = documents.select(F.from_json("value", SKETCH_SCHEMA).alias("d"))
    return d.select("d.task_id", "d.sketch_seed", F.explode("d.samples").alias("s")).select("task_id", "sketch_seed", "s.*")


def read_sketches(spark: SparkSession, path: str) -> DataFrame:
    return parse_sketches(spark.read.text(path, wholetext=True))
