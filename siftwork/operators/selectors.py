"""Selection strategies: dense scores, top-k, round-robin and quota selection."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.functions import vectors as V
from siftwork.functions.ranks import ranked, top_k
from siftwork.operators.common import attach
from siftwork.operators.quota import select_by_quota
from siftwork.operators.sampling import balanced_sample, uniform_sample
from siftwork.session import cut_lineage


def top_by(df: DataFrame, score: str, k) -> DataFrame:
    """Top k by falling score, ties by id."""
    return top_k(df, [f"-{score}", "sample_id"], k, name="rank")


def cosine_scores(pool: DataFrame, query: DataFrame, vec: str = "joint") -> DataFrame:
    """Raw cosine to the sketch mean; ``query`` is one row (q)."""
    return attach(pool, query.select("q")).withColumn("score", V.cosine(vec, "q")).drop("q")


def standardized_cosine_scores(pool: DataFrame, query: DataFrame, vec: str = "joint", stats: DataFrame | None = None):
    """Cosine after standardising pool and query with the pool's mean and population deviation."""
    stats = stats if stats is not None else V.vector_stats(pool, vec)
    d = attach(attach(pool, stats.select("mean", "sd")), query.select("q"))
    z = V.standardize(vec, "mean", "sd")
    q = V.standardize("q", "mean", "sd")
    return d.withColumn("_z", z).withColumn("_zq", q).withColumn("score", V.cosine("_z", "_zq")).drop(
        "_z", "_zq", "mean", "sd", "q"
    )


def centroid_distances(pool: DataFrame, vec: str = "joint", cluster: str = "cluster_id") -> DataFrame:
    """Euclidean distance to the mean of the own cluster."""
    centres = V.vector_mean(pool, vec, [cluster], "centre")
    return pool.join(centres, cluster).withColumn("distance", V.norm(V.subtract(vec, "centre"))).drop("centre")


def round_robin(df: DataFrame, group: str, order: list, k) -> DataFrame:
    """First of every group, then the second of every group, ... until k rows."""
    within = ranked(df, [group], order, name="round")
    return top_k(cut_lineage(within), ["round", group, order[-1]], k, name="rank")


# ---------------------------------------------------------------- strategies
# each takes (inputs, k, seed); inputs is a dict of frames and columns


def _pool(inputs) -> DataFrame:
    return inputs["pool"]


def _by_column(column: str) -> Callable:
    def run(inputs, k, seed=0):
        pool = _pool(inputs)
        if column not in pool.columns:
            raise ValueError(f"this strategy needs a {column!r} column")
        return top_by(pool.withColumn("score", F.col(column)), "score", k)

    return run


STRATEGIES: dict[str, Callable] = {
    "random": lambda i, k, seed=0: uniform_sample(_pool(i), k, seed),
    "balanced_random": lambda i, k, seed=0: balanced_sample(_pool(i), k, seed),
    "length": _by_column("len_resp"),
    "loss": _by_column("loss_mean"),
    "perplexity": _by_column("ppl"),
    "ifd": _by_column("ifd"),
    "s2l": _by_column("s2l"),
    "rds_plus": lambda i, k, seed=0: top_by(standardized_cosine_scores(_pool(i), i["query"]), "score", k),
    "embedding_nn": lambda i, k, seed=0: top_by(cosine_scores(_pool(i), i["query"]), "score", k),
    "diversity": lambda i, k, seed=0: round_robin(
        centroid_distances(_pool(i)), "cluster_id", ["distance", "sample_id"], k
    ),
    "grad_sim": lambda i, k, seed=0: top_by(i["site_mean"].withColumnRenamed("u", "score"), "score", k),
    "less": lambda i, k, seed=0: ranked(
        i["utilities"].withColumn("score", F.col("u_lo")).withColumn("_k", F.lit(k).cast("bigint")),
        ["config"],
        ["-score", "sample_id"],
        upto="_k",
        name="rank",
    ).drop("_k"),
    "lo_proxy_quota": lambda i, k, seed=0: select_by_quota(
        i["utilities"].withColumn("q", F.col("u_lo")).join(_pool(i).select("sample_id", "cluster_id"), "sample_id"),
        k,
        ["config"],
    ),
}


def select(name: str, inputs: dict, k, seed: int = 0) -> DataFrame:
    """Run a strategy by name."""
    if name not in STRATEGIES:
        raise KeyError(f"unknown strategy {name!r}; known: {sorted(STRATEGIES)}")
    return STRATEGIES[name](inputs, k, seed)


UNSCORED = ("random", "balanced_random", "diversity")  # no dense score


def dense_scores(scored: dict[str, DataFrame]) -> DataFrame:
    """One long table (method, config, sample_id, score) of every dense score; NULL config = any."""
    out = None
    for method, df in scored.items():
        config = F.col("config") if "config" in df.columns else F.lit(None).cast("string")
        part = df.select(
            F.lit(method).alias("method"), config.alias("config"), "sample_id", F.col("score").cast("double")
        )
        out = part if out is None else out.unionByName(part)
    return out
