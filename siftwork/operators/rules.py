"""Data-quality rules: each returns the rows that break it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

UNIT_RANGE = ("ndcg_at_k", "topk_hit_rate", "pairwise_acc")
SIGNED_RANGE = ("spearman", "kendall_tau")


def numeric_ranges(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, column, value, rule) for values that are missing, not finite, or out of range."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])
    d = df.select(key, F.explode(pairs).alias("p")).select(key, "p.*")
    v, c = F.col("value"), F.col("column")
    infinite = v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    rule = (
        F.when(infinite, "finite")
        .when(c.endswith("_gpu_h") & (v < 0), "non-negative")
        .when(c.isin(*UNIT_RANGE) & ~v.between(0, 1), "in [0, 1]")
        .when(c.isin(*SIGNED_RANGE) & ~v.between(-1, 1), "in [-1, 1]")
    )
    return d.withColumn("rule", rule).where(F.col("rule").isNotNull())


def wrong_counts(df: DataFrame, pool_size, budget: str = "budget", count: str = "n_selected") -> DataFrame:
    size = pool_size if not isinstance(pool_size, int) else F.lit(pool_size)
    expected = F.bround(F.col(budget) * size).cast("bigint")
    return df.withColumn("expected", expected).where(~F.col(count).eqNullSafe(F.col("expected")))


def generated_rows(df: DataFrame, mark: str = "provenance") -> DataFrame:
    """Measured rows that carry a generated-provenance mark."""
    return df.where(F.coalesce(F.try_element_at("extra", F.lit(mark)), F.lit("")) != "")


def costlier_main(curve: DataFrame, main: str, influence: list[str]) -> DataFrame:
    """Counts >= 2 at which the main method is not cheaper than an influence method."""
    own = F.max(F.when(F.col("method") == main, F.col("total_h"))).over(W.partitionBy("t"))  # one row per method
    d = curve.withColumn("main_h", own)
    return d.where(F.col("method").isin(*influence) & (F.col("t") >= 2) & (F.col("main_h") >= F.col("total_h")))


def bad_overlap(rows: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """Diagonal not 1, or a cell without an equal mirror."""
    diag = rows.where((F.col("left") == F.col("right")) & (F.abs(F.col("jaccard") - 1) > tolerance))
    mirror = rows.select("method", F.col("left").alias("right"), F.col("right").alias("left"), F.col("jaccard").alias("_m"))
    asym = rows.join(mirror, ["method", "left", "right"], "left").where(
        F.col("_m").isNull() | (F.abs(F.col("jaccard") - F.col("_m")) > tolerance)
    )
    return (
        diag.select("method", "left", "right", F.lit("diagonal").alias("rule"))
        .unionByName(asym.select("method", "left", "right", F.lit("symmetric").alias("rule")))
    )


def diagonal_mismatch(matched: DataFrame, diagonal: DataFrame, keys: list[str], tolerance: float = 1e-12) -> DataFrame:
    """Keys whose matched mean has no equal diagonal mean."""
    a = matched.groupBy(*keys).agg(F.avg("metric").alias("matched"))
    b = diagonal.groupBy(*keys).agg(F.avg("metric").alias("diagonal"))
    return a.join(b, keys, "left").where(F.col("diagonal").isNull() | (F.abs(F.col("matched") - F.col("diagonal")) > tolerance))


def off_diagonal_above(matrix: DataFrame, by: list[str], value: str = "mean", tolerance: float = 1e-9) -> DataFrame:
    """Sources that beat the target's own selection; a target without a diagonal is reported too."""
    diag = F.max(F.when(F.col("src") == F.col("tgt"), F.col(value))).over(W.partitionBy(*by, "tgt"))  # one row per source
    d = matrix.withColumn("diagonal", diag)
    return d.where(F.col("diagonal").isNull() | ((F.col("src") != F.col("tgt")) & (F.col(value) > F.col("diagonal") + tolerance)))


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one copy that the other lacks, duplicates counted."""
    cols = a.columns
    left = a.exceptAll(b.select(*cols)).withColumn("only_in", F.lit("left"))
    return left.unionByName(b.select(*cols).exceptAll(a).withColumn("only_in", F.lit("right")))


def bad_lines(lines: DataFrame, schema: str) -> DataFrame:
    """JSON lines that do not parse (blank ones are fine)."""
    full = f"{schema}, _bad string"
    d = lines.where(F.trim("value") != "")
    j = F.from_json("value", full, {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"})
    return d.withColumn("_j", j).where(F.col("_j._bad").isNotNull() | F.col("_j").isNull()).drop("_j")
