"""Inputs of the operators, derived from the supplied tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from siftwork.functions import vectors as V
from siftwork.operators.sampling import sketch_members
from siftwork.session import cut_lineage


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    d = spark.read.parquet(f"{sf}/{name}.parquet")
    return spread(d) if name == "documents" else d


def spread(df: DataFrame) -> DataFrame:
    """Spread the rows when there are fewer files than cores.

    Text work is heavy per row, and a single file with a single row group is one
    task. A table of many files is left as it is: no shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def dealt(df: DataFrame) -> DataFrame:
    """Rows dealt evenly to all cores, before work that is heavy per row: a narrow table is one file or one coalesced partition."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def first_line(text: Column) -> Column:
    return F.substring_index(text, "\n", 1)


def after_first_line(text: Column) -> Column:
    at = F.instr(text, "\n")
    return F.when(at > 0, text.substr(at + 1, F.length(text))).otherwise(F.lit(""))


def pool_text(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select(
        F.col("doc_id").alias("sample_id"),
        first_line(F.col("text")).alias("instruction"),
        after_first_line(F.col("text")).alias("response"),
        "source",
        F.col("lang").alias("language"),
    )


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return e.select(
        F.col("vec_id").alias("sample_id"),
        F.col("embedding").cast("array<double>").alias("joint"),
        F.col("label").alias("cluster_id"),
    )


def pool(spark: SparkSession, sf: str) -> DataFrame:
    return pool_text(spark, sf).join(vectors(spark, sf), "sample_id")


def pool_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Pool rows without their text: only ids are read from the documents."""
    ids = table(spark, sf, "documents").select(F.col("doc_id").alias("sample_id"))
    return ids.join(vectors(spark, sf), "sample_id")


def truth(spark: SparkSession, sf: str) -> DataFrame:
    lab = table(spark, sf, "labels")
    return lab.select(
        F.col("doc_id").alias("sample_id"),
        (F.col("quality") - 0.5 * F.col("toxic")).cast("double").alias("u_hi"),
    )


def sketch_source(spark: SparkSession, sf: str, quality: int = 1) -> DataFrame:
    good = table(spark, sf, "labels").where(F.col("quality") == quality).select(F.col("doc_id").alias("sample_id"))
    return pool(spark, sf).join(good, "sample_id", "left_semi")


def sketch(spark: SparkSession, sf: str, n: int = 32, seed: int = 0, quality: int = 1) -> DataFrame:
    # at most n rows, used several times by every query that has a task: stored once
    return cut_lineage(sketch_members(sketch_source(spark, sf, quality), n=n, seed=seed))


def deltas(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.groupBy(
        F.col("l_partkey").alias("sample_id"),
        F.col("l_returnflag").alias("peft_id"),
        F.col("l_linestatus").alias("task_id"),
        (F.col("l_suppkey") % 2).cast("bigint").alias("anchor_idx"),
        F.when(F.col("l_linenumber") % 2 == 1, 1).otherwise(4).cast("bigint").alias("horizon"),
    ).agg(
        # whole cents keep the mean exact, so ties are ties on every engine
        (F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")) / (F.count(F.lit(1)) * 100.0)).alias("delta_raw")
    )


def budget_of() -> Column:
    return F.when(F.col("user_id") % 3 == 0, 0.05).when(F.col("user_id") % 3 == 1, 0.10).otherwise(0.30)


def events(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))


def results(spark: SparkSession, sf: str) -> DataFrame:
    """Result log: one row per event; a failed cell has a NaN metric."""
    e = events(spark, sf)
    failed = (F.col("event_type") == "error") & (F.col("value") < 1)
    return e.select(
        F.col("event_id").alias("run_no"),
        F.col("event_type").alias("method"),
        (F.col("user_id") % 5).alias("config"),
        (F.col("k") % 4).alias("task"),
        (F.col("event_id") % 3).alias("seed"),
        budget_of().cast("double").alias("budget"),
        F.when(failed, F.lit(float("nan"))).otherwise(F.col("value")).alias("metric"),
    )


def cost_events(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(
        F.col("event_id").alias("run_no"),
        F.col("event_type").alias("stage"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("value").alias("wall_time_sec"),
        F.lit(8).alias("gpu_count"),
        F.col("user_id").alias("run_id"),
    )


N_SITES = 24


def site_table() -> list[tuple[int, int, str]]:
    """(site number, layer, module) in registry order."""
    modules = ("attn_out", "mlp_out", "block_residual")
    return [(4 * i + 3, m) for i in range(8) for m in modules]


def signatures(spark: SparkSession, sf: str) -> DataFrame:
    """Per-site unit vectors: 24 sites share all 64 embedding dimensions, three each for the first 16, then two."""
    v = pool_vectors(spark, sf)
    sites = F.array(
        *[
            F.struct(
                F.lit(j).alias("site"),
                F.lit(layer).alias("layer"),
                F.lit(module).alias("module"),
                V.unit(F.slice("joint", 3 * j + 1 - max(0, j - 16), 3 if j < 16 else 2)).alias("g"),
            )
            for j, (layer, module) in enumerate(site_table())
        ]
    )
    return v.select("sample_id", F.explode(sites).alias("s")).select("sample_id", "s.*")


def scale_rows(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem as a scored, clustered pool; repeated lines get a copy number."""
    li = table(spark, sf, "lineitem")
    line = F.md5(
        F.concat_ws(
            "|",
            "l_orderkey",
            "l_partkey",
            "l_suppkey",
            "l_linenumber",
            F.round(F.col("l_extendedprice") * 100).cast("bigint"),
        )
    )
    w = W.partitionBy("line").orderBy("l_shipdate", "l_quantity", "l_discount", "l_tax")
    rows = (
        li.withColumn("line", line)
        .withColumn("copy", F.row_number().over(w))
        .select(
            F.concat_ws("-", "line", "copy").alias("sample_id"),
            F.col("l_suppkey").alias("cluster_id"),
            F.col("l_extendedprice").alias("q"),
        )
    )
    return cut_lineage(rows)  # the pool with its ids, stored like any scored pool
