"""Vector expressions over ``array<double>`` columns, and grouped vector means."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EPS = 1e-8

SQL_FUNCTIONS = {
    "vec_dot": "(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN "
    "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)",
    "vec_norm": "(a ARRAY<DOUBLE>) RETURNS DOUBLE RETURN "
    "sqrt(aggregate(a, 0D, (s, x) -> s + x * x))",
    "vec_scale": "(a ARRAY<DOUBLE>, f DOUBLE) RETURNS ARRAY<DOUBLE> RETURN transform(a, x -> x * f)",
}


def register_vector_functions(spark: SparkSession) -> None:
    """Ship the helpers as SQL functions, which Catalyst inlines."""
    for name, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def doubles(x) -> Column:
    return _c(x).cast("array<double>")


def total(x) -> Column:
    return F.aggregate(_c(x), F.lit(0.0), lambda s, v: s + v)


def dot(a, b) -> Column:
    return total(F.zip_with(_c(a), _c(b), lambda x, y: x * y))


def norm(a) -> Column:
    return F.sqrt(F.aggregate(_c(a), F.lit(0.0), lambda s, v: s + v * v))


def scale(a, factor) -> Column:
    f = _c(factor)
    return F.transform(_c(a), lambda v: v * f)


def unit(a, floor: float = EPS) -> Column:
    """L2-normalise; the divisor never falls below ``floor``."""
    n = F.greatest(norm(a), F.lit(floor))
    return F.transform(_c(a), lambda v: v / n)


def cosine(a, b, eps: float = EPS) -> Column:
    return dot(a, b) / ((norm(a) + F.lit(eps)) * (norm(b) + F.lit(eps)))


def subtract(a, b) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x - y)


def standardize(a, mean, sd, eps: float = 1e-6) -> Column:
    centred = subtract(a, mean)
    return F.zip_with(centred, _c(sd), lambda x, s: x / (s + F.lit(eps)))


def round_all(a, digits: int = 6) -> Column:
    return F.transform(_c(a), lambda v: F.round(v, digits))


def vector_stats(df: DataFrame, vec, keys: list[str] | None = None) -> DataFrame:
    """Element-wise mean and population deviation per key (one row without keys).

    ``Summarizer`` keeps one buffer per group and map task, so a hot key costs
    no more than any other and nothing is exploded.
    """
    v = array_to_vector(doubles(vec))
    agg = [
        Summarizer.metrics("mean", "variance", "count").summary(v).alias("_s"),
    ]
    out = df.groupBy(*(keys or [])).agg(*agg)
    n = F.col("_s.count").cast("double")
    var = vector_to_array(F.col("_s.variance"))
    return out.select(
        *(keys or []),
        vector_to_array(F.col("_s.mean")).alias("mean"),
        F.transform(var, lambda x: F.sqrt(x * (n - 1) / n)).alias("sd"),
        n.cast("bigint").alias("n"),
    )


def vector_mean(df: DataFrame, vec, keys: list[str] | None = None, name: str = "mean") -> DataFrame:
    v = array_to_vector(doubles(vec))
    out = df.groupBy(*(keys or [])).agg(Summarizer.mean(v).alias("_m"))
    return out.select(*(keys or []), vector_to_array(F.col("_m")).alias(name))
