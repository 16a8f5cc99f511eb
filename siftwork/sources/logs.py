"""Append-only cost and result logs, and nested overlap documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

COST_SCHEMA = (
    "stage string, wall_time_sec double, gpu_hours double, peak_mem_mb double, disk_written_mb double, "
    "n_samples bigint, peft_id string, task_id string, ts timestamp, extra map<string,string>"
)
RESULT_SCHEMA = (
    "experiment string, method string, peft string, task string, budget double, seed int, model string, "
    "metric_name string, metric double, eval_loss double, spearman double, kendall_tau double, ndcg_at_k double, "
    "topk_hit_rate double, pairwise_acc double, select_gpu_h double, target_train_gpu_h double, "
    "offline_gpu_h double, extra map<string,string>"
)
EXTRA_KEYS = ("axis", "sub", "src_peft", "tgt_peft", "level", "d2", "mode", "is_ood", "n_selected")


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All rows of a log; blank lines are skipped, and a missing log is empty."""
    if not _exists(spark, path):
        return spark.createDataFrame([], T.StructType.fromDDL(schema))
    return spark.read.schema(schema).json(path)


def parse_results(lines: DataFrame) -> DataFrame:
    """Result rows from JSON text; NaN metrics become NULL."""
    d = lines.where(F.trim("value") != "").select(F.from_json("value", RESULT_SCHEMA).alias("r")).select("r.*")
    return nan_to_null(d)


def nan_to_null(df: DataFrame) -> DataFrame:
    out = df
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out = out.withColumn(f.name, F.when(~F.isnan(f.name), F.col(f.name)))
    return out


def with_extra_columns(results: DataFrame, keys=EXTRA_KEYS) -> DataFrame:
    """Common keys of ``extra`` as columns; absent keys are NULL."""
    return results.select("*", *[F.try_element_at("extra", F.lit(k)).alias(k) for k in keys])


def overlap_rows(documents: DataFrame) -> DataFrame:
    """(method, left, right, jaccard) from {"overlap": {method: {config: {config: value}}}}."""
    schema = "overlap map<string,map<string,map<string,double>>>"
    d = documents.select(F.from_json("value", schema)["overlap"].alias("o"))
    a = d.select(F.explode("o").alias("method", "m"))
    b = a.select("method", F.explode("m").alias("left", "r"))
    return b.select("method", "left", F.explode("r").alias("right", "jaccard"))
