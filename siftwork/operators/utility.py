"""Site-weighted utilities, projections, rank-normalised labels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwork.functions import vectors as V
from siftwork.functions.ranks import value_ranks


def task_signatures(signatures: DataFrame, members: DataFrame, keys=("site",)) -> DataFrame:
    """Per site: mean signature of the sketch members, L2-normalised."""
    few = signatures.join(F.broadcast(members.select("sample_id")), "sample_id", "left_semi")
    return V.vector_mean(few, "g", list(keys), "m").select(*keys, V.unit("m").alias("t"))


def site_similarities(signatures: DataFrame, task: DataFrame, n_sites: int = 24) -> DataFrame:
    """One row per sample with the similarity at every site as an array.

    ``task`` has one row per site, so its broadcast is bounded by the site grid.
    The cosine work is done once, however many configurations follow.
    """
    d = signatures.join(F.broadcast(task), "site").select("sample_id", "site", V.dot("g", "t").alias("s"))
    cells = [F.coalesce(F.max(F.when(F.col("site") == j, F.col("s"))), F.lit(0.0)) for j in range(n_sites)]
    return d.groupBy("sample_id").agg(F.array(*cells).alias("sims"))


def utilities(sims: DataFrame, weights: DataFrame) -> DataFrame:
    """u_lo for every (sample, config): dot of the similarities with the site weights.

    ``weights`` (config, site_alpha) is registry-sized and is exploded next to each
    sample: no shuffle after the similarities.
    """
    table = weights.agg(F.collect_list(F.struct("config", "site_alpha")).alias("w"))
    from siftwork.operators.common import attach

    d = attach(sims, table).select("sample_id", "sims", F.explode("w").alias("w"))
    return d.select("sample_id", F.col("w.config").alias("config"), V.dot("sims", F.col("w.site_alpha")).alias("u_lo"))


def utilities_by_site(signatures: DataFrame, task: DataFrame, weights: DataFrame) -> DataFrame:
    """The same from long tables, reading only the sites some configuration weighs.

    ``weights`` is (config, site, alpha); rows with alpha = 0 never join.
    """
    active = weights.where("alpha > 0")
    d = signatures.join(F.broadcast(task), "site").select("sample_id", "site", V.dot("g", "t").alias("s"))
    per = d.join(F.broadcast(active), "site")
    return per.groupBy("sample_id", "config").agg(F.sum(F.col("alpha") * F.col("s")).alias("u_lo"))


def mean_similarity(sims: DataFrame) -> DataFrame:
    """Configuration-free utility: the mean over sites."""
    return sims.select("sample_id", (V.total("sims") / F.size("sims")).alias("u"))


# ----------------------------------------------------------------- projection


def projection_rows(spark, sites: list[int], d_proj: int, d_model: int, seed: int = 0) -> DataFrame:
    """Gaussian projection as (site, rows): entries from md5, so any engine can rebuild them."""
    ids = spark.createDataFrame([(s,) for s in sites], "site int")

    def entry(site, i, j):
        key = F.md5(F.concat_ws(":", F.lit(str(seed)), site, i, j))
        u = [F.conv(F.substring(key, at, 8), 16, 10).cast("double") / 4294967296.0 for at in (1, 9)]
        gauss = F.sqrt(-2.0 * F.log(u[0] + 1e-12)) * F.cos(2.0 * np.pi * u[1])
        return gauss / F.sqrt(F.lit(float(d_proj)))

    rows = F.transform(
        F.sequence(F.lit(0), F.lit(d_proj - 1)),
        lambda i: F.transform(F.sequence(F.lit(0), F.lit(d_model - 1)), lambda j: entry(F.col("site"), i, j)),
    )
    return ids.select("site", rows.alias("phi"))


def project(vectors: DataFrame, phi: DataFrame, vec: str = "v") -> DataFrame:
    """Project with a given table (site, phi) and L2-normalise (floor 1e-8): one matrix product per site and Arrow batch.

    The table is bounded by the site grid. A vector that is NULL, has NULLs or another width gives NULLs; rows of other
    sites have no row.
    """
    tables = {r["site"]: np.array(r["phi"], np.float64) for r in phi.select("site", "phi").collect()}

    def run(batches) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        for b in batches:
            column = b.column(vec)
            length = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
            holed = np.zeros(b.num_rows, bool)
            holed[pc.list_parent_indices(column).to_numpy(zero_copy_only=False)[pc.list_flatten(column).is_null().to_numpy(zero_copy_only=False)]] = True
            for s, m in tables.items():
                at = np.flatnonzero(pc.fill_null(pc.equal(b.column("site"), s), False).to_numpy(zero_copy_only=False))
                if not len(at):
                    continue
                good = (length[at] == m.shape[1]) & ~holed[at]
                x = pc.list_flatten(column.take(pa.array(at[good]))).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, m.shape[1])
                g = np.zeros((len(at), len(m)))
                y = x @ m.T
                g[good] = y / np.maximum(np.sqrt((y * y).sum(axis=1, keepdims=True)), 1e-8)
                values = pa.array(g.ravel(), mask=np.repeat(~good, len(m)))
                made = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * len(m), pa.int32()), values)
                part = b.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*part.columns, made], names=[*part.schema.names, "g"])

    schema = T.StructType([*vectors.schema.fields, T.StructField("g", T.ArrayType(T.DoubleType()))])
    return vectors.mapInArrow(run, schema)


def project_wide(vectors: DataFrame, d_proj: int = 256, seed: int = 0, vec: str = "v", id_type: str = "bigint") -> DataFrame:
    """Wide form: one matrix product per site and Arrow batch.

    The matrix of a site comes from a fixed seed inside the task, so nothing large
    is broadcast and every executor agrees.
    """
    cache: dict = {}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for site, part in pdf.groupby("site", sort=False):
                x = np.stack(part[vec].to_numpy()).astype(np.float64)
                key = (int(site), x.shape[1])
                if key not in cache:
                    rng = np.random.default_rng([seed, int(site)])
                    cache[key] = rng.standard_normal((d_proj, x.shape[1])) / np.sqrt(d_proj)
                g = x @ cache[key].T
                g /= np.maximum(np.sqrt((g * g).sum(axis=1, keepdims=True)), 1e-8)
                yield pd.DataFrame({"sample_id": part["sample_id"], "site": part["site"], "g": list(g)})

    return vectors.select("sample_id", "site", vec).mapInPandas(run, f"sample_id {id_type}, site int, g array<double>")


# --------------------------------------------------------------------- labels

BUCKET = ["peft_id", "task_id", "anchor_idx", "horizon"]


def rank_normalised(df: DataFrame, value: str = "delta_raw", by: list[str] | None = None, name: str = "delta_norm") -> DataFrame:
    """(average rank - 1) / max(size - 1, 1) within each bucket.

    Ties collapse first and long buckets are cut into slices, so a bucket with a
    third of all rows is ranked by many tasks.
    """
    by = by or BUCKET
    r = value_ranks(df, by, value)
    norm = (F.col("below") + (F.col("ties") - 1) / 2.0) / F.greatest(F.col("group_size") - 1, F.lit(1))
    return df.join(r.select(*by, value, norm.alias(name)), [*by, value])


def aggregate_labels(normed: DataFrame, weights: dict[int, float] | None = None) -> DataFrame:
    """u_hi: anchors averaged per horizon, horizons weighted; sigma: mean per-horizon deviation."""
    weights = weights or {1: 0.4, 4: 0.6}
    keys = ["sample_id", "peft_id", "task_id"]
    per = normed.groupBy(*keys, "horizon").agg(
        F.avg("delta_norm").alias("m"),
        F.stddev_samp("delta_norm").alias("s"),
        F.sum("delta_raw").alias("raw"),
        F.count(F.lit(1)).alias("n"),
    )
    w = F.lit(0.0)
    for h, x in weights.items():
        w = F.when(F.col("horizon") == h, F.lit(float(x))).otherwise(w)
    return per.groupBy(*keys).agg(
        F.sum(w * F.col("m")).alias("u_hi"),
        F.coalesce(F.avg("s"), F.lit(0.0)).alias("sigma_est"),
        (F.sum("raw") / F.sum("n")).alias("delta_raw"),
    ).withColumn("horizon", F.lit(max(weights))).withColumn("anchor_idx", F.lit(-1))
