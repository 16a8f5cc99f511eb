"""Out-of-distribution statistics over row or configuration vectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.functions.ranks import quantiles
from siftwork.session import cut_lineage

MAX_DIM = 4096


@dataclass
class OODStats:
    mean: np.ndarray
    whitening: np.ndarray
    threshold: float


def covariance_rows(df: DataFrame, mean: np.ndarray, vec: str) -> DataFrame:
    """(i, row): centred sums of products. Each task adds up its own d x d block; rows of the
    matrix are then summed by different tasks."""
    d = len(mean)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc = np.zeros((d, d))
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf[vec].to_numpy()).astype(np.float64) - mean
                acc += x.T @ x
        yield pd.DataFrame({"i": np.arange(d), "row": list(acc)})

    parts = df.select(vec).mapInPandas(partial, "i int, row array<double>")
    s = parts.groupBy("i").agg(Summarizer.sum(array_to_vector("row")).alias("_s"))
    return s.select("i", vector_to_array("_s").alias("row"))


def mean_and_covariance(df: DataFrame, vec: str) -> tuple[np.ndarray, np.ndarray]:
    """Mean and sample covariance; only the d and d x d results reach the driver."""
    m = df.agg(Summarizer.mean(array_to_vector(F.col(vec).cast("array<double>"))).alias("m"), F.count(F.lit(1)).alias("n")).head()
    mean = m["m"].toArray()
    if len(mean) > MAX_DIM:
        raise ValueError(f"more than {MAX_DIM} dimensions")
    rows = covariance_rows(df, mean, vec).orderBy("i").collect()
    return mean, np.array([r["row"] for r in rows]) / max(m["n"] - 1, 1)


def whitening(cov: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """The inverse of the Cholesky factor of ``cov + ridge * I``, solved column by column against the triangle."""
    factor = np.linalg.cholesky(cov + np.eye(len(cov)) * ridge)
    out = np.zeros_like(factor)
    for i in range(len(factor)):
        out[i] = (np.eye(len(factor))[i] - factor[i, :i] @ out[:i]) / factor[i, i]
    return out


def distances(df: DataFrame, mean: np.ndarray, whiten: np.ndarray, vec: str, id_col: str = "sample_id") -> DataFrame:
    """Squared Mahalanobis distance per row: the squared length of the whitened difference to the mean."""
    id_type = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf[vec].to_numpy()).astype(np.float64) - mean
                yield pd.DataFrame({id_col: pdf[id_col], "d2": ((x @ whiten.T) ** 2).sum(axis=1)})

    return df.select(id_col, vec).mapInPandas(run, f"{id_col} {id_type}, d2 double")


def threshold(d2: DataFrame, quantile: float = 0.95) -> DataFrame:
    return quantiles(cut_lineage(d2), [], "d2", threshold=quantile)


def fit(df: DataFrame, vec: str, quantile: float = 0.95, ridge: float = 1e-3, id_col: str = "sample_id") -> OODStats:
    mean, cov = mean_and_covariance(df, vec)
    whiten = whitening(cov, ridge)
    t = threshold(distances(df, mean, whiten, vec, id_col), quantile).head()["threshold"]
    return OODStats(mean, whiten, float(t))


def flag(df: DataFrame, stats: OODStats, vec: str, id_col: str = "sample_id") -> DataFrame:
    """(id, d2, is_ood); strictly above the threshold."""
    d = distances(df, stats.mean, stats.whitening, vec, id_col)
    return d.withColumn("is_ood", F.col("d2") > F.lit(stats.threshold))
