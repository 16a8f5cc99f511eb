"""Clustering of row vectors: Spark ML fit, and assignment to given centres."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.operators.neighbours import CHUNK, cells

TASK_VALUES = 1 << 20  # 8 MB of centres go to every task; larger tables meet the rows in blocks


def n_clusters(n_rows: int, k: int | None = None) -> int:
    """k = max(50, floor(sqrt(N))) unless given, never above N."""
    return min(n_rows, k or max(50, math.isqrt(n_rows)))


def fit(df: DataFrame, vec: str = "joint", k: int | None = None, seed: int = 0, max_iter: int = 20) -> KMeansModel:
    """Fit on all rows; each pass is linear in them and distributed."""
    centres = n_clusters(df.count(), k)
    d = df.select("sample_id", array_to_vector(F.col(vec).cast("array<double>")).alias("features"))
    return KMeans(k=centres, seed=seed, initMode="k-means||", maxIter=max_iter).fit(d.select("features"))


def transform(model: KMeansModel, df: DataFrame, vec: str = "joint") -> DataFrame:
    d = df.withColumn("features", array_to_vector(F.col(vec).cast("array<double>")))
    return model.transform(d).withColumnRenamed("prediction", "cluster_id").drop("features")


def cluster(df: DataFrame, vec: str = "joint", **kw) -> DataFrame:
    """Rows with ``cluster_id``; an empty pool stays empty."""
    if df.isEmpty():
        return df.withColumn("cluster_id", F.lit(None).cast("int"))
    return transform(fit(df, vec, **kw), df, vec)


def centres(spark, model: KMeansModel) -> DataFrame:
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    return spark.createDataFrame(rows, "cluster_id int, centre array<double>")


def assign(df: DataFrame, centre_table: DataFrame, vec: str = "joint", id_type: str = "bigint") -> DataFrame:
    """(sample_id, cluster_id, distance): the nearest given centre per row; ties to the smallest id.

    A centre table of at most TASK_VALUES values travels to the rows. A larger one is dealt to blocks that meet
    blocks of rows; each cell passes on a row's nearest centre, and the least (distance, id) of all cells counts.
    """
    size = centre_table.agg(F.sum(F.size("centre")).alias("n")).head()["n"] or 0
    if size > TASK_VALUES:
        return _assign_by_blocks(df, centre_table, vec, id_type)
    rows = centre_table.orderBy("cluster_id").collect()
    ids = np.array([r["cluster_id"] for r in rows], dtype=np.int32)
    c = np.array([r["centre"] for r in rows], dtype=np.float64)
    c2 = (c * c).sum(axis=1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack(pdf[vec].to_numpy()).astype(np.float64)
            d2 = np.round(np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ c.T + c2, 0), 9)
            best = d2.argmin(axis=1)
            yield pd.DataFrame({"sample_id": pdf["sample_id"], "cluster_id": ids[best], "distance": np.sqrt(d2[np.arange(len(best)), best])})

    return df.select("sample_id", vec).mapInPandas(run, f"sample_id {id_type}, cluster_id int, distance double")


def _matrix(table) -> np.ndarray:
    v = table.column("vec").combine_chunks()
    return np.asarray(v.flatten()).reshape(len(v), -1)


def _nearest(rows, centres):
    """The nearest centre of a cell for each of its rows, in squared distance."""
    import pyarrow as pa

    ids, least, sample = np.empty(0, np.int32), np.empty(0), rows.column("sample_id").combine_chunks()
    if rows.num_rows and centres.num_rows:
        order = np.argsort(np.asarray(centres.column("item")), kind="stable")
        c = _matrix(centres)[order]
        c2, name = (c * c).sum(axis=1), np.asarray(centres.column("item"))[order]
        for at in range(0, rows.num_rows, CHUNK):
            x = _matrix(rows.slice(at, CHUNK))
            d2 = np.round(np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ c.T + c2, 0), 9)
            best = d2.argmin(axis=1)
            ids, least = np.append(ids, name[best]), np.append(least, d2[np.arange(len(x)), best])
    else:
        sample = sample.slice(0, 0)
    return pa.table({"sample_id": sample, "cluster_id": pa.array(ids, pa.int32()), "d2": pa.array(least, pa.float64())})


def _assign_by_blocks(df: DataFrame, centre_table: DataFrame, vec: str, id_type: str) -> DataFrame:
    one = F.lit(0).alias("key")
    items = centre_table.select(one, F.col("cluster_id").cast("int").alias("cluster_id"), F.col("centre").alias(vec))
    found = cells(df.select(one, "sample_id", vec), items, vec, "cluster_id", _nearest, f"sample_id {id_type}, cluster_id int, d2 double")
    best = found.groupBy("sample_id").agg(F.min(F.struct("d2", "cluster_id")).alias("b"))
    return best.select("sample_id", "b.cluster_id", F.sqrt("b.d2").alias("distance"))
