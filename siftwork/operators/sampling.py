"""Seeded samplers, strata, sketches, and the three label-acquisition phases.

All randomness is an md5 order over ``seed:id``, so a result does not depend on
partitioning and can be repeated on any cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from siftwork.functions.ids import order_key
from siftwork.functions.ranks import ranked, top_k
from siftwork.session import cut_lineage


def uniform_sample(df: DataFrame, k, seed: int = 0, id_col: str = "sample_id") -> DataFrame:
    """k rows without replacement."""
    keyed = df.withColumn("_h", order_key(seed, id_col))
    return top_k(keyed, ["_h", id_col], k, name="draw").drop("_h")


def balanced_sample(
    df: DataFrame, k, seed: int = 0, group: str = "cluster_id", id_col: str = "sample_id", fill: bool = False
) -> DataFrame:
    """max(1, k // groups) rows of every group, cut to k in group order.

    May return fewer than k rows, as the rule says; ``fill`` tops up round-robin.
    """
    keyed = df.withColumn("_h", order_key(seed, id_col))
    groups = df.select(group).distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
    k_col = k if isinstance(k, Column) else F.lit(int(k))
    keyed = keyed.withColumn("_k", k_col.cast("bigint"))
    keyed = keyed.withColumn("_per", F.greatest(F.lit(1), F.floor(F.col("_k") / groups)).cast("bigint"))
    if fill:
        within = ranked(keyed, [group], ["_h", id_col], name="draw")
        out = ranked(cut_lineage(within), [], ["draw", group, id_col], upto="_k", name="position")
    else:
        within = ranked(keyed, [group], ["_h", id_col], upto="_per", name="draw")
        out = ranked(cut_lineage(within), [], [group, "draw", id_col], upto="_k", name="position")
    return out.drop("_h", "_k", "_per")


def length_strata(df: DataFrame, n: int, id_col: str = "sample_id", text: str = "response") -> DataFrame:
    """Narrow (id, stratum) frame: thirds of response length, or one stratum below 3n rows."""
    narrow = df.select(id_col, F.length(text).alias("_len"))
    pos = ranked(narrow, [], ["_len", id_col], name="_pos", size_name="_n")
    third = (
        F.when(F.col("_n") < 3 * n, 0)
        .when(F.col("_pos") <= F.floor(F.col("_n") / 3), 0)
        .when(F.col("_pos") <= F.floor(2 * F.col("_n") / 3), 1)
        .otherwise(2)
    )
    return pos.select(id_col, third.alias("stratum"), "_n")


def sketch_members(df: DataFrame, n: int = 32, seed: int = 0, id_col: str = "sample_id") -> DataFrame:
    """A sketch of n rows: n//3 per length third, the leftover to the first thirds.

    Only (id, length) is shuffled; the rows themselves join the n picked ids.
    """
    s = length_strata(df, n, id_col).withColumn("_h", order_key(seed, id_col))
    per, left = n // 3, n % 3
    quota = F.when(F.col("_n") < 3 * n, n).when(F.col("stratum") < left, per + 1).otherwise(per)
    pick = F.row_number().over(W.partitionBy("stratum").orderBy("_h", id_col))
    # the constant bound lets every task keep only n rows per stratum before the shuffle
    picked = s.withColumn("pick", pick).where(F.col("pick") <= n).where(F.col("pick") <= quota)
    ids = picked.select(id_col, "stratum", "pick")
    return df.join(F.broadcast(ids), id_col)


def sketch_replicates(df: DataFrame, seeds: list[int], sizes: list[int], id_col: str = "sample_id") -> DataFrame:
    """Members of every (seed, size) sketch, in one job; size 0 gives no rows."""
    narrow = df.select(id_col, F.length("response").alias("_len"))
    pos = ranked(narrow, [], ["_len", id_col], name="_pos", size_name="_total")
    grid = F.array(*[F.struct(F.lit(s).alias("seed"), F.lit(m).alias("size")) for s in seeds for m in sizes])
    g = pos.select("*", F.explode(grid).alias("g")).select(id_col, "_pos", "_total", "g.*")
    stratum = (
        F.when(F.col("_total") < 3 * F.col("size"), 0)
        .when(F.col("_pos") <= F.floor(F.col("_total") / 3), 0)
        .when(F.col("_pos") <= F.floor(2 * F.col("_total") / 3), 1)
        .otherwise(2)
    )
    g = g.withColumn("stratum", stratum).withColumn("_h", F.md5(F.concat_ws(":", "seed", id_col)))
    pick = F.row_number().over(W.partitionBy("seed", "size", "stratum").orderBy("_h", id_col))
    third = F.floor(F.col("size") / 3)
    quota = F.when(F.col("_total") < 3 * F.col("size"), F.col("size")).otherwise(
        third + F.when(F.col("stratum") < F.col("size") % 3, 1).otherwise(0)
    )
    picked = g.withColumn("pick", pick).where(F.col("pick") <= max(sizes)).where(F.col("pick") <= quota)
    return picked.select("seed", "size", "stratum", id_col)


def capacity_bucket(rank, bottleneck, prefix_len) -> Column:
    """xs / s / m / l by the first non-zero size, 8 when there is none."""
    size = F.coalesce(*[F.nullif(F.col(c), F.lit(0)) for c in (rank, bottleneck, prefix_len)], F.lit(8))
    return F.when(size < 8, "xs").when(size < 16, "s").when(size < 32, "m").otherwise("l")


def coverage_triples(
    pool: DataFrame,
    configs: DataFrame,
    tasks: list[str],
    budget: int,
    seed: int = 0,
    strata: list[str] | None = None,
) -> DataFrame:
    """Phase 1: shuffled round-robin over (pool strata, family, capacity, task), up to ``budget``.

    The product samples x configs x tasks is never built. Stratum sizes give the
    round-robin depth D by which the budget is met; at most D triples of a stratum
    can be taken, and they come from at most D samples of the pool stratum.
    """
    strata = strata or ["cluster_id"]
    kinds = configs.select(
        "config", "family", capacity_bucket("rank", "bottleneck", "prefix_len").alias("capacity")
    )
    kind_sizes = kinds.groupBy("family", "capacity").agg(
        F.count(F.lit(1)).alias("n_configs"), F.collect_list("config").alias("configs")
    )
    task_array = F.array(*[F.lit(t) for t in tasks])
    cells = pool.groupBy(*strata).agg(F.count(F.lit(1)).alias("n_samples"))
    # registry-sized side: one row per (family, capacity)
    cell_strata = cells.join(F.broadcast(kind_sizes)).withColumn("task", F.explode(task_array))
    size = F.col("n_samples") * F.col("n_configs")
    n_strata = cell_strata.agg(F.count(F.lit(1)).alias("n")).scalar()
    # depth: smallest D with sum(min(D, size)) >= budget, from the sorted sizes
    sizes = cell_strata.groupBy(size.alias("s")).agg(F.count(F.lit(1)).alias("c"))
    w = W.partitionBy(F.lit(0)).orderBy("s")
    run = sizes.select(
        "s",
        F.coalesce(F.sum(F.col("s") * F.col("c")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("low"),
        F.coalesce(F.sum("c").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("below"),
    ).withColumn("left", n_strata - F.col("below"))
    fits = F.col("low") + F.col("left") * F.col("s") >= budget
    depth_at = F.ceil((F.lit(budget) - F.col("low")) / F.col("left"))
    depth = run.agg(
        F.coalesce(F.min(F.when(fits, F.struct("s", depth_at.alias("d"))))["d"], F.max("s")).cast("bigint").alias("d")
    ).scalar()
    shuffled = pool.select(*strata, "sample_id", order_key(seed, "sample_id").alias("_h"))
    kept = ranked(shuffled.withColumn("_d", depth), strata, ["_h", "sample_id"], upto="_d", name="_rs")
    triples = (
        cut_lineage(kept).join(F.broadcast(kind_sizes))
        .withColumn("task", F.explode(task_array))
        .withColumn("config", F.explode("configs"))
        .withColumn("_ht", order_key(seed, "_rs", "config", "task"))
    )
    cell = [*strata, "family", "capacity", "task"]
    # within a stratum: sample by sample, the configurations of a sample in shuffled order
    inner = ranked(triples, cell, ["_rs", "_ht"], upto="_d", name="round")
    inner = cut_lineage(inner).withColumn("_hs", order_key(seed, *cell))
    out = top_k(inner, ["round", "_hs", "sample_id", "config"], budget, name="position")
    return out.select(*strata, "family", "capacity", "task", "config", "sample_id", "round", "position")


def uncertainty_triples(
    candidates: DataFrame, queried: DataFrame, budget, gamma: float = 0.5, keys=("sample_id", "peft_id", "task_id")
) -> DataFrame:
    """Phase 2: top triples by sigma * (1 + gamma * max(u_lo, 0)), queried ones left out."""
    open_ = candidates.join(queried.select(*keys), list(keys), "left_anti")
    s = open_.withColumn("score", F.col("sigma") * (1 + gamma * F.greatest(F.col("u_lo"), F.lit(0.0))))
    return top_k(s, ["-score", *keys], budget, name="position")


def boundary_triples(
    candidates: DataFrame, budget, scorer_rank="scorer_rank", true_rank="true_rank", keys=("sample_id", "peft_id", "task_id")
) -> DataFrame:
    """Phase 3: top triples by |rank gap| / max(1, true rank)."""
    gap = F.abs(F.col(scorer_rank) - F.col(true_rank)) / F.greatest(F.lit(1.0), F.col(true_rank))
    return top_k(candidates.withColumn("score", gap), ["-score", *keys], budget, name="position")


def rank_pairs(
    labels: DataFrame, value: str, by: list[str], pairs_per_bucket: int, seed: int = 0, id_col: str = "sample_id"
) -> DataFrame:
    """Up to ``pairs_per_bucket`` random label pairs per bucket.

    Rows are shuffled by md5 within their bucket and neighbours (1,2), (3,4), ... are
    paired; only the first 2k rows of a bucket can be in a pair, a constant bound.
    """
    keyed = labels.where(F.col(value).isNotNull()).withColumn("_h", order_key(seed, *by, id_col))
    rn = F.row_number().over(W.partitionBy(*by).orderBy("_h", id_col))
    first = keyed.withColumn("_rn", rn).where(F.col("_rn") <= 2 * pairs_per_bucket)
    slot = first.withColumn("pair_no", F.floor((F.col("_rn") + 1) / 2).cast("bigint"))
    odd = F.col("_rn") % 2 == 1
    return (
        slot.groupBy(*by, "pair_no")
        .agg(
            F.max(F.when(odd, F.col(id_col))).alias("left_id"),
            F.max(F.when(odd, F.col(value))).alias("left_u"),
            F.max(F.when(~odd, F.col(id_col))).alias("right_id"),
            F.max(F.when(~odd, F.col(value))).alias("right_u"),
        )
        .where(F.col("right_id").isNotNull())
    )
