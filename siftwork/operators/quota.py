"""Cluster values, budget allocation and per-cluster picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from siftwork.functions.ranks import ranked
from siftwork.session import cut_lineage


def penalised(df: DataFrame, penalty: float = 0.2, mu: str = "mu", sigma: str = "sigma") -> DataFrame:
    """q = mu - penalty * sigma."""
    return df.withColumn("q", F.col(mu) - F.lit(float(penalty)) * F.col(sigma))


def rank_in_clusters(df: DataFrame, keys: list[str] | None = None, **kw) -> DataFrame:
    """Rank by falling q within (keys, cluster), with the cluster size; exact for hot clusters too."""
    return ranked(
        df, [*(keys or []), "cluster_id"], ["-q", "sample_id"], name="rank_in_cluster", size_name="size", **kw
    )


def cluster_values(ranks: DataFrame, keys: list[str] | None = None, top_share: float = 0.10) -> DataFrame:
    """Size and value of each cluster: the mean q of its top ceil(share * size) rows, at least one."""
    top = F.col("rank_in_cluster") <= F.greatest(F.lit(1), F.ceil(F.col("size") * F.lit(top_share)))
    return ranks.groupBy(*(keys or []), "cluster_id").agg(
        F.max("size").alias("size"), F.avg(F.when(top, F.col("q"))).alias("value")
    )


def allocate(
    clusters: DataFrame,
    keys: list[str] | None = None,
    *,
    alpha: float | str = 0.6,
    min_cluster: int | Column = 0,
    leftover: str = "greedy",
) -> DataFrame:
    """Budget per cluster from (keys.., cluster_id, size, value, budget).

    Greedy redistribution and trimming are written as running sums, so every
    allocation of a sweep runs in the same windows. Frames hold clusters, not rows.
    ``leftover='proportional'`` shares the rest by largest remainder instead.
    """
    part = W.partitionBy(*(keys or [F.lit(0)]))

    def before(x: Column, *order: Column) -> Column:
        run = part.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
        return F.coalesce(F.sum(x).over(run), F.lit(0))

    c = F.col
    a = c(alpha) if isinstance(alpha, str) else F.lit(float(alpha))
    floor_size = min_cluster if isinstance(min_cluster, Column) else F.lit(int(min_cluster))
    d = clusters.withColumn("_v", c("value") - F.least(F.min("value").over(part), F.lit(0.0)))
    flat = (F.max("_v").over(part) <= 1e-12) | (a == 0)
    d = d.withColumn(
        "_w",
        F.when(flat, F.lit(1.0)).otherwise(F.pow(F.greatest(c("_v"), F.lit(0.0)), a))
        * F.pow(c("size").cast("double"), 1 - a),
    )
    up = (c("_w"), c("cluster_id"))
    down = (c("_w").desc(), c("cluster_id"))
    d = d.withColumn("_f0", F.least(floor_size, c("size")).cast("bigint"))
    over = F.greatest(F.sum("_f0").over(part) - c("budget"), F.lit(0))
    d = d.withColumn("_f", c("_f0") - F.least(c("_f0"), F.greatest(F.lit(0), over - before(c("_f0"), *up))))
    rest = F.greatest(c("budget") - F.sum("_f").over(part), F.lit(0))
    share = rest * c("_w") / F.greatest(F.sum("_w").over(part), F.lit(1e-12))
    if leftover == "proportional":
        d = d.withColumn("_share", share)
        d = d.withColumn("_b0", F.least(c("_f") + F.floor("_share"), c("size")).cast("bigint"))
        d = d.withColumn("_rem", c("budget") - F.sum("_b0").over(part))
        frac = F.col("_share") - F.floor("_share")
        by_remainder = (frac.desc(), c("_w").desc(), c("cluster_id"))
        d = d.withColumn("_one", F.least(c("size") - c("_b0"), F.lit(1)).cast("bigint"))
        d = d.withColumn(
            "_b1", c("_b0") + F.least(c("_one"), F.greatest(F.lit(0), c("_rem") - before(c("_one"), *by_remainder)))
        )
        # clusters that are full pass what is left on by weight
        d = d.withColumn("_rem1", c("budget") - F.sum("_b1").over(part)).withColumn("_slack", c("size") - c("_b1"))
        b = c("_b1") + F.least(c("_slack"), F.greatest(F.lit(0), c("_rem1") - before(c("_slack"), *down)))
    else:
        d = d.withColumn("_b0", F.least(c("_f") + F.bround(share), c("size")).cast("bigint"))
        d = d.withColumn("_rem", c("budget") - F.sum("_b0").over(part))
        d = d.withColumn("_slack", c("size") - c("_b0")).withColumn("_cut", c("_b0") - c("_f"))
        more = F.least(c("_slack"), F.greatest(F.lit(0), c("_rem") - before(c("_slack"), *down)))
        less = F.least(c("_cut"), F.greatest(F.lit(0), -c("_rem") - before(c("_cut"), *up)))
        b = F.when(c("_rem") > 0, c("_b0") + more).when(c("_rem") < 0, c("_b0") - less).otherwise(c("_b0"))
    return d.withColumn("b", b.cast("bigint")).select(*clusters.columns, "b")


def select_by_quota(
    scored: DataFrame,
    budget,
    keys: list[str] | None = None,
    *,
    alpha: float | str = 0.6,
    min_cluster: int = 0,
    top_share: float = 0.10,
) -> DataFrame:
    """Whole selector: values, budgets, and the top b rows of each cluster.

    ``scored`` has (keys.., sample_id, cluster_id, q). ``budget`` is a number, a
    scalar column, or the name of a column that is constant per key.
    """
    keys = keys or []
    # narrow rows, read for the values and again for the picks: ranked once
    ranks = cut_lineage(rank_in_clusters(scored, keys))
    values = cluster_values(ranks, keys, top_share)
    if isinstance(alpha, str) and alpha not in keys:
        raise ValueError(f"{alpha} must be one of the keys")
    if not isinstance(budget, str):
        col = budget if isinstance(budget, Column) else F.lit(int(budget))
        values = values.withColumn("budget", col.cast("bigint"))
    b = allocate(values, keys, alpha=alpha, min_cluster=min_cluster).select(*keys, "cluster_id", "b")
    return ranks.join(b, [*keys, "cluster_id"]).where(F.col("rank_in_cluster") <= F.col("b"))
