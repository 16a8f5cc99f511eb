"""Paired comparisons: differences, resampling intervals, rank and dominance statistics."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwork.functions.ids import hash_index
from siftwork.functions.ranks import average_rank, value_ranks
from siftwork.operators.reports import without_nan


def paired_cells(results: DataFrame, a: str, b: str, keys: list[str]) -> DataFrame:
    """Per cell: mean of both methods and their difference; cells with one method drop out."""
    v = without_nan("metric")
    g = results.where(F.col("method").isin(a, b)).groupBy(*keys).agg(
        F.avg(F.when(F.col("method") == a, v)).alias("a"), F.avg(F.when(F.col("method") == b, v)).alias("b")
    )
    return g.where("a is not null and b is not null").withColumn("diff", F.col("a") - F.col("b"))


def paired_summary(cells: DataFrame) -> DataFrame:
    sd, n = F.stddev_samp("diff"), F.count(F.lit(1))
    m = F.avg("diff")
    return cells.agg(
        m.alias("mean"),
        F.sum((F.col("diff") > 0).cast("bigint")).alias("wins"),
        n.alias("n"),
        (m / sd).alias("cohen_d"),
        (m / (sd / F.sqrt(n))).alias("t"),
    )


def equivalence(cells: DataFrame, margin: float = 1.0) -> DataFrame:
    """The two one-sided t statistics for |mean| < margin."""
    se = F.stddev_samp("diff") / F.sqrt(F.count(F.lit(1)))
    m = F.avg("diff")
    return cells.agg(((m + margin) / se).alias("t_low"), ((m - margin) / se).alias("t_high"), (F.count(F.lit(1)) - 1).alias("df"))


def _draws(groups: DataFrame, resamples: int, seed: int, keys: list[str]) -> DataFrame:
    """(keys.., rep, draw, at): hashed indices below the group size."""
    d = groups.select(*keys, "n", F.explode(F.sequence(F.lit(1), F.lit(resamples))).alias("rep"))
    d = d.select("*", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("draw"))
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys], F.col("rep"), F.col("draw")))
    return d.withColumn("at", hash_index(h, F.col("n")))


def bootstrap(cells: DataFrame, order: list[str], resamples: int = 10_000, seed: int = 0, strata: str | None = None) -> DataFrame:
    """Percentile interval of the mean difference; with ``strata`` cells are drawn within their stratum.

    The resamples are rows: they are spread over the cluster and averaged by key.
    """
    from siftwork.functions.ranks import ranked

    keys = [strata] if strata else ["_all"]
    c = cells if strata else cells.withColumn("_all", F.lit(0))
    idx = ranked(c.select(*keys, *[o for o in order if o not in keys], "diff"), keys, order, name="at")
    idx = idx.withColumn("at", F.col("at") - 1)
    sizes = c.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    drawn = _draws(sizes, resamples, seed, keys).join(idx.select(*keys, "at", "diff"), [*keys, "at"])
    per = drawn.groupBy("rep", *keys).agg(F.avg("diff").alias("m")).groupBy("rep").agg(F.avg("m").alias("m"))
    return per.agg(
        F.percentile("m", F.lit(0.025)).alias("lo"), F.percentile("m", F.lit(0.975)).alias("hi"), F.avg("m").alias("centre")
    )


MOST_CELLS = 15  # 15^15 resamples still are a 64-bit count


def exact_bootstrap(cells: DataFrame, key: str) -> DataFrame:
    """All n^n resamples of a group of n cells (MOST_CELLS at most), each multiset of cells once with its number of orders.

    How often each cell is drawn is decided cell by cell; a multiset's orders are n! over the factorials of its counts,
    which the percentiles take as frequencies. C(2n - 1, n) rows stand for n^n.
    """
    g = cells.groupBy(key).agg(F.sort_array(F.collect_list("diff")).alias("d")).withColumn("n", F.size("d"))
    g = g.withColumn("n", F.when(F.col("n") <= MOST_CELLS, F.col("n")).otherwise(F.raise_error(F.lit(f"more than {MOST_CELLS} cells")).cast("int")))
    most = g.agg(F.max("n")).head()[0] or 0
    e = g.select(key, "d", "n", F.col("n").alias("left"), F.lit(0.0).alias("s"), F.factorial("n").alias("ways"))
    for i in range(most):
        drawn = F.when(F.col("n") <= i, F.array(F.lit(0))).when(F.col("n") == i + 1, F.array("left")).otherwise(F.sequence(F.lit(0), F.col("left")))
        e = e.select("*", F.explode(drawn).alias("c"))
        e = e.select(
            key,
            "d",
            "n",
            (F.col("left") - F.col("c")).alias("left"),
            (F.col("s") + F.col("c") * F.coalesce(F.get("d", F.lit(i)), F.lit(0.0))).alias("s"),
            F.expr("ways div factorial(c)").alias("ways"),
        )
        if i == 3:
            e = e.repartition(key, "left", "s")  # from here on a group is many tasks
    m = e.select(key, (F.col("s") / F.col("n")).alias("m"), "ways")
    return m.groupBy(key).agg(
        F.percentile("m", F.lit(0.025), F.col("ways")).alias("lo"), F.percentile("m", F.lit(0.975), F.col("ways")).alias("hi"), F.sum("ways").alias("n_resamples")
    )


@F.pandas_udf(T.DoubleType())
def _two_sided(z: pd.Series) -> pd.Series:
    return z.map(lambda v: None if v is None or v != v else math.erfc(v / math.sqrt(2.0)))


def wilcoxon(cells: DataFrame) -> DataFrame:
    """Signed-rank statistic with continuity and tie correction; zero differences are left out."""
    d = cells.where("diff <> 0").select("diff", F.abs("diff").alias("mag"))
    ties = value_ranks(d, [], "mag")
    t = ties.agg(F.coalesce(F.sum(F.pow("ties", F.lit(3)) - F.col("ties")), F.lit(0.0)).alias("tie")).scalar()
    r = average_rank(d, [], "mag", "r")
    a = r.agg(F.coalesce(F.sum(F.when(F.col("diff") > 0, F.col("r"))), F.lit(0.0)).alias("w_plus"), F.count(F.lit(1)).alias("n"))
    n = F.col("n").cast("double")
    a = a.withColumn("_var", n * (n + 1) * (2 * n + 1) / 24.0 - t / 48.0)
    z = (F.abs(F.col("w_plus") - n * (n + 1) / 4.0) - 0.5) / F.sqrt(F.nullif("_var", F.lit(0.0)))
    return a.withColumn("z", z).withColumn("p", _two_sided("z")).drop("_var")


def cliffs_delta(df: DataFrame, a: str, b: str, by: list[str] | None = None, value: str = "metric") -> DataFrame:
    """Dominance of a over b from rank sums: 2 U / (n m) - 1. No pairs of rows."""
    by = by or []
    d = df.where(F.col("method").isin(a, b) & ~F.isnan(value)).select(*by, "method", value)
    r = average_rank(d, by, value, "_r")
    first = F.col("method") == a
    g = r.groupBy(*by).agg(
        F.sum(F.when(first, F.col("_r"))).alias("_s"),
        F.sum(first.cast("double")).alias("_n"),
        F.sum((~first).cast("double")).alias("_m"),
    )
    u = F.col("_s") - F.col("_n") * (F.col("_n") + 1) / 2
    return g.select(*by, (2 * u / F.nullif(F.col("_n") * F.col("_m"), F.lit(0.0)) - 1).alias("delta"))


def relative_gains(results: DataFrame, a: str, others: list[str], by: str) -> DataFrame:
    """100 * (a - b) / b per key against each other method."""
    v = without_nan("metric")
    g = results.groupBy(by).agg(*[F.avg(F.when(F.col("method") == m, v)).alias(m) for m in [a, *others]])
    return g.select(by, *[(100.0 * (F.col(a) - F.col(o)) / F.nullif(o, F.lit(0.0))).alias(f"gain_{o}") for o in others])


def jackknife_correlation(points: DataFrame, left: str, right: str, x: str, y: str) -> DataFrame:
    """Range of Spearman(x, y) over pair rows when each name is left out in turn."""
    names = points.select(F.col(left).alias("out")).unionByName(points.select(F.col(right).alias("out"))).distinct()
    # names are configurations: at most the registry's size
    kept = points.join(F.broadcast(names), (F.col(left) != F.col("out")) & (F.col(right) != F.col("out")))
    from siftwork.operators.metrics import spearman

    s = spearman(kept, ["out"], "rho", x, y)
    return s.agg(F.min("rho").alias("lo"), F.max("rho").alias("hi"), F.count("rho").alias("n"))
