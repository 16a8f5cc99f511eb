"""Nearest rows of test vectors: blocks of items meet blocks of the pool, the best of each cell leave it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

POOL_VALUES = 1 << 22  # vector values of a pool block: 32 MB
ITEM_VALUES = 1 << 20  # vector values of an item block: 8 MB
CHUNK = 2048  # pool rows multiplied at once
CELL = ["key", "part", "sub"]


def _unit(m: np.ndarray) -> np.ndarray:
    return m / (np.sqrt((m * m).sum(axis=1, keepdims=True)) + 1e-8)


def _matrix(table) -> np.ndarray:
    v = table.column("vec").combine_chunks()
    return _unit(np.asarray(v.flatten()).reshape(len(v), -1))


def cells(pool: DataFrame, items: DataFrame, vec: str, item_col: str, run, schema: str) -> DataFrame:
    """``run`` over every block of items of a ``key`` together with every block of the key's pool rows.

    Blocks follow the counted rows and the width, so no task holds more than two bounded blocks, however many rows
    share a key. A pool row is copied once for every block of items, an item once for every block of the pool.
    """
    rows = pool.groupBy("key").agg(F.sum(F.size(vec)).alias("_n")).join(items.groupBy("key").agg(F.sum(F.size(vec)).alias("_m")), "key")
    blocks = [F.greatest(F.lit(1), F.ceil(F.col(c) / size)).cast("int").alias(name) for c, size, name in (("_n", POOL_VALUES, "_parts"), ("_m", ITEM_VALUES, "_subs"))]
    grid = rows.select("key", *blocks)
    left = pool.join(grid, "key").select(
        "key",
        F.pmod(F.xxhash64("sample_id"), "_parts").cast("int").alias("part"),
        F.explode(F.sequence(F.lit(0), F.col("_subs") - 1)).alias("sub"),
        "sample_id",
        F.col(vec).cast("array<double>").alias("vec"),
    )
    right = items.join(grid, "key").select(
        F.col("key").alias("key"),
        F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("part"),
        F.pmod(F.xxhash64(item_col), "_subs").cast("int").alias("sub"),
        F.col(item_col).alias("item"),
        F.col(vec).cast("array<double>").alias("vec"),
    )
    return left.groupBy(*CELL).cogroup(right.groupBy(*CELL)).applyInArrow(run, schema)


def _best(k: int):
    """The k nearest pool rows of each item of a cell; equal cosines go to the smaller id."""

    def run(pool, items):
        import pyarrow as pa

        empty = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        item, sample, cosine = empty
        if pool.num_rows and items.num_rows:
            q, ids = _matrix(items), np.asarray(items.column("item"))
            for at in range(0, pool.num_rows, CHUNK):
                part = pool.slice(at, CHUNK)
                sid = np.asarray(part.column("sample_id"))
                sims = np.round(_matrix(part) @ q.T, 9)
                least = np.partition(sims, len(sid) - k, axis=0)[len(sid) - k] if len(sid) > k else np.full(len(ids), -np.inf)
                row, col = np.nonzero(sims >= least)
                item, sample, cosine = np.append(item, col), np.append(sample, sid[row]), np.append(cosine, sims[row, col])
                # the running k best of each item
                order = np.lexsort((sample, -cosine, item))
                head = np.searchsorted(item[order], np.arange(len(ids)))
                order = order[np.arange(len(order)) - head[item[order]] < k]
                item, sample, cosine = item[order], sample[order], cosine[order]
            item = ids[item]
        return pa.table({"item": pa.array(item, pa.int64()), "sample_id": pa.array(sample, pa.int64()), "cosine": pa.array(cosine, pa.float64())})

    return run


def _reaching(threshold: float):
    """Pool rows of a cell whose best cosine to an item of the cell reaches the threshold."""

    def run(pool, items):
        import pyarrow as pa

        ids, best = [np.empty(0, np.int64)], [np.empty(0)]
        if pool.num_rows and items.num_rows:
            q = _matrix(items)
            for at in range(0, pool.num_rows, CHUNK):
                part = pool.slice(at, CHUNK)
                top = np.round((_matrix(part) @ q.T).max(axis=1), 9)
                ids.append(np.asarray(part.column("sample_id"))[top >= threshold])
                best.append(top[top >= threshold])
        return pa.table({"sample_id": pa.array(np.concatenate(ids), pa.int64()), "cosine": pa.array(np.concatenate(best), pa.float64())})

    return run


def _ranked(found: DataFrame, k: int, item_col: str) -> DataFrame:
    rn = F.row_number().over(W.partitionBy(item_col).orderBy(F.desc("cosine"), "sample_id"))
    return found.withColumnRenamed("item", item_col).withColumn("rank", rn).where(F.col("rank") <= k)


def nearest_rows(pool: DataFrame, items: DataFrame, k: int = 20, vec: str = "joint", item_col: str = "item_id") -> DataFrame:
    """(item_id, sample_id, cosine, rank) of the k nearest pool rows of each item, exactly.

    Both sides are distributed: items are dealt to blocks, every block meets every block of the pool, and a cell
    passes on the k best of each of its items. The pool is read once for its size and once for its vectors.
    """
    one = F.lit(0).alias("key")
    found = cells(pool.select(one, "sample_id", vec), items.select(one, item_col, vec), vec, item_col, _best(k), "item bigint, sample_id bigint, cosine double")
    return _ranked(found, k, item_col)


def rows_near_items(pool: DataFrame, items: DataFrame, threshold: float, vec: str = "joint", item_col: str = "item_id") -> DataFrame:
    """Pool ids whose best cosine to any item reaches the threshold; one row per pool row at most."""
    one = F.lit(0).alias("key")
    found = cells(pool.select(one, "sample_id", vec), items.select(one, item_col, vec), vec, item_col, _reaching(threshold), "sample_id bigint, cosine double")
    return found.groupBy("sample_id").agg(F.max("cosine").alias("cosine"))


# ------------------------------------------------------------------ by hyperplanes


def _planes(width: int, tables: int, bits: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((tables, width, bits))


def _buckets(planes: np.ndarray, probes: int):
    """Bucket numbers of each vector: its own in every table, then those across the planes it lies closest to."""
    tables, _, bits = planes.shape
    weight = np.int64(1) << np.arange(bits, dtype=np.int64)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            if not b.num_rows:
                continue
            x = np.asarray(b.column("vec").flatten()).reshape(b.num_rows, -1)
            out = []
            for t in range(tables):
                side = x @ planes[t]
                own = (side > 0) @ weight
                near = np.argsort(np.abs(side), axis=1, kind="stable")[:, : probes - 1]
                found = np.concatenate((own[:, None], own[:, None] ^ weight[near]), axis=1) if probes > 1 else own[:, None]
                out.append(found + (np.int64(t) << bits))
            keys = np.concatenate(out, axis=1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, keys.shape[1]), pa.int32()), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("vec"), lists], names=["id", "vec", "keys"])

    return run


def probable_rows(
    pool: DataFrame,
    items: DataFrame,
    k: int = 20,
    vec: str = "joint",
    item_col: str = "item_id",
    tables: int = 12,
    bits: int = 8,
    probes: int = 5,
    seed: int = 0,
) -> DataFrame:
    """(item_id, sample_id, cosine, rank) of about the k nearest pool rows: only rows in a bucket the item probes are compared.

    Each of ``tables`` sets of random hyperplanes deals the pool to 2^bits buckets; an item looks into its own bucket
    and into ``probes - 1`` across the nearest planes. Cosines are exact; what is missed is whole rows. For a pool too
    large to meet every item; ``nearest_rows`` is exact. A bucket with very many rows is several blocks.
    """
    width = pool.agg(F.max(F.size(vec))).head()[0] or 1
    planes = _planes(width, tables, bits, seed)

    def keyed(d: DataFrame, id_col: str, n: int) -> DataFrame:
        d = d.select(F.col(id_col).alias("id"), F.col(vec).cast("array<double>").alias("vec"))
        d = d.mapInArrow(_buckets(planes, n), "id bigint, vec array<double>, keys array<bigint>")
        return d.select(F.explode("keys").alias("key"), F.col("id").alias(id_col), F.col("vec").alias(vec))

    schema = "item bigint, sample_id bigint, cosine double"
    found = cells(keyed(pool, "sample_id", 1), keyed(items, item_col, probes), vec, item_col, _best(k), schema)
    return _ranked(found.distinct(), k, item_col)
