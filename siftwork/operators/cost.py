"""GPU hours, cost curves, break-even points and the quality-cost frontier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

OFFLINE_STAGES = ("feat", "lo", "hi", "scorer_train")


def gpu_hours(wall: str = "wall_time_sec", gpus: str = "gpu_count") -> Column:
    return F.col(wall) * F.greatest(F.lit(1), F.col(gpus)) / 3600.0


def totals(events: DataFrame, offline=OFFLINE_STAGES) -> DataFrame:
    """All hours, and the hours of the offline stages."""
    return events.agg(
        F.sum("gpu_hours").alias("total_h"),
        F.coalesce(F.sum(F.when(F.col("stage").isin(*offline), F.col("gpu_hours"))), F.lit(0.0)).alias("offline_h"),
    )


def by_stage(events: DataFrame, key: str, stages: list[str]) -> DataFrame:
    return events.groupBy(key).pivot("stage", stages).agg(F.sum("gpu_hours"))


def break_even(offline: Column, apply: Column, specific: Column) -> Column:
    """Configurations after which the offline part pays; infinity when nothing is saved."""
    saved = specific - apply
    return F.when(saved <= 1e-9, F.lit(float("inf"))).otherwise(offline / saved)


def method_costs(results: DataFrame) -> DataFrame:
    """Mean apply hours and mean metric per method."""
    return results.groupBy("method").agg(F.avg("apply_h").alias("apply_h"), F.avg("metric").alias("perf"))


def total_cost(main: str, influence: list[str], offline: float, recompute: float, t: Column) -> Column:
    a = F.col("apply_h")
    return (
        F.when(F.col("method") == main, offline + t * a)
        .when(F.col("method").isin(*influence), t * (recompute + a))
        .otherwise(t * a)
    )


def cost_curve(costs: DataFrame, main: str, influence: list[str], offline: float, recompute: float, counts: list[int]) -> DataFrame:
    d = costs.withColumn("t", F.explode(F.array(*[F.lit(c) for c in counts])))
    return d.withColumn("total_h", total_cost(main, influence, offline, recompute, F.col("t")))


def break_even_table(costs: DataFrame, main: str, influence: list[str], offline: float, recompute: float) -> DataFrame:
    own = F.max(F.when(F.col("method") == main, F.col("apply_h"))).over(W.partitionBy(F.lit(0)))  # one row per method
    specific = F.when(F.col("method").isin(*influence), recompute + F.col("apply_h")).otherwise(F.col("apply_h"))
    d = costs.withColumn("_own", own).withColumn("break_even", break_even(F.lit(offline), F.col("_own"), specific))
    return d.where(F.col("method") != main).drop("_own")


def frontier(points: DataFrame, cost: str = "total_h", perf: str = "perf") -> DataFrame:
    """Mark methods that no cheaper or equally cheap method beats."""
    w = W.partitionBy(F.lit(0)).orderBy(cost, F.desc(perf)).rowsBetween(W.unboundedPreceding, -1)
    best = F.max(perf).over(w)
    return points.withColumn("on_frontier", best.isNull() | (F.col(perf) > best))


def headline(costs: DataFrame, main: str, influence: list[str], reference: str, offline: float, recompute: float, n_configs: int) -> DataFrame:
    """Fixed, marginal and total cost for n configurations, and the quality gap to a reference."""
    ref = F.max(F.when(F.col("method") == reference, F.col("perf"))).over(W.partitionBy(F.lit(0)))
    fixed = F.when(F.col("method") == main, F.lit(offline)).otherwise(0.0)
    marginal = F.col("apply_h") + F.when(F.col("method").isin(*influence), F.lit(recompute)).otherwise(0.0)
    d = costs.withColumn("fixed_h", fixed).withColumn("marginal_h", marginal)
    return d.withColumn("total_h", F.col("fixed_h") + n_configs * F.col("marginal_h")).withColumn("gap", F.col("perf") - ref)
