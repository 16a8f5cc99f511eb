"""Guards and small helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def attach(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a one-row frame as a scalar subquery (no join, no cross product)."""
    s = one_row.select(F.struct("*").alias("s")).scalar()
    return df.withColumn("_one", s).select(*df.columns, "_one.*")


def resolve_budget(df: DataFrame, budget: float | int | None = None, *, fraction: float | None = None) -> Column:
    """Rows to keep: ``budget >= 1`` is a count, below 1 (or ``fraction``) a share of ``df``, at least one."""
    if fraction is None and budget is not None and budget >= 1:
        return F.lit(int(budget)).cast("bigint")
    share = float(budget if fraction is None else fraction)
    n = df.agg(F.greatest(F.lit(1.0), F.bround(F.count(F.lit(1)) * F.lit(share))).cast("bigint").alias("k"))
    return n.scalar()


def duplicates(df: DataFrame, key: str = "sample_id") -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def assert_unique(df: DataFrame, key: str = "sample_id") -> DataFrame:
    """Fail with a five-id preview when a key repeats."""
    bad = [r[0] for r in duplicates(df, key).orderBy(key).limit(5).collect()]
    if bad:
        raise ValueError(f"duplicate {key} values, for example {bad}")
    return df


def missing(wanted: DataFrame, have: DataFrame, key: str = "sample_id") -> DataFrame:
    return wanted.select(key).join(have.select(key), key, "left_anti")


def assert_covers(have: DataFrame, wanted: DataFrame, key: str = "sample_id") -> DataFrame:
    """Fail with count and preview when a wanted key is absent."""
    gap = missing(wanted, have, key)
    preview = [r[0] for r in gap.orderBy(key).limit(5).collect()]
    if preview:
        raise ValueError(f"{gap.count()} {key} values are missing, for example {preview}")
    return have


def assert_not_empty(df: DataFrame, what: str = "pool") -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"{what} is empty")
    return df


def skewed_join(left: DataFrame, right: DataFrame, key: str, rows_per_task: int = 1_000_000) -> DataFrame:
    """Inner join where ``key`` is unique on the right and may be very frequent on the left.

    Only keys with more than ``rows_per_task`` left rows are salted, and only their
    right rows are repeated. There can be at most rows / rows_per_task such keys,
    which bounds the broadcast.
    """
    hot = (
        left.groupBy(key)
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > rows_per_task)
        .select(key, F.ceil(F.col("_n") / rows_per_task).cast("int").alias("_salts"))
    )
    others = [c for c in left.columns if c != key] or [key]
    salts = F.coalesce(F.col("_salts"), F.lit(1))
    salted = left.join(F.broadcast(hot), key, "left").withColumn("_salt", F.pmod(F.xxhash64(*others), salts).cast("int"))
    repeated = right.join(F.broadcast(hot), key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return salted.drop("_salts").join(repeated.drop("_salts"), [key, "_salt"]).drop("_salt")
