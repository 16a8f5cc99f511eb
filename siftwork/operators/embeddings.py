"""Text vectors and one-hot channels with Spark ML."""

from __future__ import annotations

from pyspark.ml.feature import IDF, HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.functions import text as TX
from siftwork.operators.common import attach

MAX_CATEGORIES = 10_000


def hashed_tfidf(df: DataFrame, text: str, dim: int = 512, out: str = "embedding") -> DataFrame:
    """L2-normalised hashed TF-IDF as ``array<double>``."""
    d = df.withColumn("_w", TX.words(text))
    tf = HashingTF(inputCol="_w", outputCol="_tf", numFeatures=dim).transform(d)
    idf = IDF(inputCol="_tf", outputCol="_idf").fit(tf).transform(tf)
    unit = Normalizer(inputCol="_idf", outputCol="_u").transform(idf)
    return unit.withColumn(out, vector_to_array("_u")).drop("_w", "_tf", "_idf", "_u", text)


def one_hot(df: DataFrame, col: str) -> DataFrame:
    """One-hot array over the sorted distinct values; more than MAX_CATEGORIES is an error."""
    values = df.select(col).where(F.col(col).isNotNull()).distinct()
    n = values.limit(MAX_CATEGORIES + 1).count()
    if n > MAX_CATEGORIES:
        raise ValueError(f"{col} has more than {MAX_CATEGORIES} values; one-hot would not stay small")
    table = values.agg(F.sort_array(F.collect_list(col)).alias("_values"))
    d = attach(df, table)
    return d.withColumn(
        f"{col}_onehot", F.transform("_values", lambda v: F.when(v == F.col(col), 1.0).otherwise(0.0))
    ).drop("_values")
