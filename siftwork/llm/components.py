"""Connected components: union-find inside parts of the edges, star contractions between them."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.llm.common import store


LOCAL_EDGES = 1_000_000  # edges (16 MB) that one task contracts by itself


def _contracted(edges: DataFrame, parts: int) -> DataFrame:
    """Each part of the edges as (u, v) ties of its nodes to the smallest node they reach inside it, by union-find."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        root: dict[int, int] = {}

        def find(x: int) -> int:
            top = x
            while root[top] != top:
                top = root[top]
            while root[x] != top:
                root[x], x = top, root[x]
            return top

        for b in batches:
            for u, v in zip(b.column("u").to_pylist(), b.column("v").to_pylist()):
                x, y = find(root.setdefault(u, u)), find(root.setdefault(v, v))
                if x != y:
                    root[max(x, y)] = min(x, y)
        ties = [(x, find(x)) for x in root if find(x) != x]
        for at in range(0, len(ties), 100_000):
            u, v = zip(*ties[at : at + 100_000])
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    spread = edges.coalesce(1) if parts == 1 else edges.repartition(parts, "u")
    return spread.mapInArrow(run, "u bigint, v bigint")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b), root the smallest node of its component, itself included.

    Edges are cut into parts of about LOCAL_EDGES; union-find ties the nodes of a part to one another. What several
    parts know is contracted by star rounds: each ties larger neighbours to the smallest one (large star), then
    smaller ones (small star), until the edges no longer change. Loops and repeated edges are ignored; no edges give
    no rows.
    """
    e = store(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "edges")
    parts = -(-e.count() // LOCAL_EDGES) or 1
    e = store(_contracted(e, parts), "edges")
    before = None
    while parts > 1:
        n, total = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (n, total) == before or not n:
            break
        before = (n, total)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(store(low, "lowest"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = store(tied.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
