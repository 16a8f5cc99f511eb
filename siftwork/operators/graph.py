"""Connected components of a link table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.session import cut_lineage


def _state(links: DataFrame) -> tuple:
    """Rows and an order-free checksum: equal states are equal tables."""
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).head())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of every vertex that has a link; the component is named by its smallest id.

    Links (a, b) may repeat, point either way, and be loops (a vertex with a loop only is its own component).
    A large star ties each vertex's greater neighbours to the least vertex around it, a small star the smaller ones;
    both keep the components, and in O(log n) rounds each component is one star around its least vertex. Minima are
    combined before they are shuffled and joined back link by link, so no task gathers a neighbourhood; the links of
    a vertex with very many of them are split by adaptive execution.
    """
    loops = links.where(F.col(a) == F.col(b)).select(F.col(a).alias("u"), F.col(b).alias("v"))
    edges = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    edges = cut_lineage(edges.distinct())
    before = _state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut_lineage(large.distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut_lineage(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        after = _state(edges)
        if after == before:
            break
        before = after
    centres = edges.select(F.col("v").alias("u"), "v").unionByName(loops)
    named = edges.unionByName(centres).groupBy("u").agg(F.min("v").alias("v"))
    return named.select(F.col("u").alias("id"), F.col("v").alias("component"))
