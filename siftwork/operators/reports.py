"""Aggregations over the result log: means, dispersion, sweeps, matrices."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from siftwork.functions.ranks import average_rank, ranked
from siftwork.operators import metrics as M
from siftwork.session import cut_lineage


def near(col: str, value: float) -> Column:
    """Float equality with the usual relative and absolute tolerance."""
    return F.abs(F.col(col) - F.lit(value)) <= F.lit(1e-8 + 1e-5 * abs(value))


def without_nan(col: str) -> Column:
    """NaN as NULL, so that aggregates skip it."""
    return F.when(~F.isnan(col), F.col(col))


def aggregate(df: DataFrame, by: list[str], value: str = "metric") -> DataFrame:
    """Mean, population deviation and count per key; missing values are skipped."""
    v = without_nan(value)
    out = df.groupBy(*by).agg(F.avg(v).alias("mean"), F.coalesce(F.stddev_pop(v), F.lit(0.0)).alias("std"), F.count(v).alias("n"))
    return out.where("n > 0")


def mean_and_spread(df: DataFrame, by: list[str], value: str = "metric") -> DataFrame:
    """Mean and sample deviation per key."""
    v = without_nan(value)
    return df.groupBy(*by).agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"))


def group_mean(df: DataFrame, keys: list[str], value: str = "metric") -> DataFrame:
    """Mean by key paths; ``extra.k`` reads the map."""
    cols = [F.try_element_at("extra", F.lit(k[6:])).alias(k[6:]) if k.startswith("extra.") else F.col(k) for k in keys]
    d = df.select(*cols, without_nan(value).alias("_v"))
    return d.groupBy(*[k[6:] if k.startswith("extra.") else k for k in keys]).agg(F.avg("_v").alias("mean"))


def pivot_mean(df: DataFrame, row: str, col: str, values: list, value: str = "metric", prefix: str = "c") -> DataFrame:
    """Row x column means with an explicit value list: one pass, no distinct job."""
    p = df.groupBy(row).pivot(col, values).agg(F.avg(without_nan(value)))
    return p.select(row, *[F.col(str(v)).alias(f"{prefix}{v}") for v in values])


def dispersion(df: DataFrame, row: str = "method", col: str = "config", seed: str = "seed", value: str = "metric") -> DataFrame:
    """Mean over tasks within a seed, then mean and sample deviation over seeds; plus an all-column 'Avg.' row."""
    v = without_nan(value)
    cells = df.groupBy(row, F.col(col).cast("string").alias(col), seed).agg(F.avg(v).alias("_m"))
    whole = df.groupBy(row, F.lit("Avg.").alias(col), seed).agg(F.avg(v).alias("_m"))
    return cells.unionByName(whole).groupBy(row, col).agg(F.avg("_m").alias("mean"), F.stddev_samp("_m").alias("std"))


def ablation(df: DataFrame, full: str, by: str = "method", value: str = "metric", second: str = "ndcg") -> DataFrame:
    """Per-variant means and the drop against the full variant."""
    g = df.groupBy(by).agg(F.avg(without_nan(value)).alias("mean"), F.avg(without_nan(second)).alias("mean_ndcg"), F.count(F.lit(1)).alias("n"))
    ref = F.max(F.when(F.col(by) == full, F.col("mean"))).over(W.partitionBy(F.lit(0)))  # one row per variant
    return g.withColumn("drop", ref - F.col("mean"))


def mark_best(df: DataFrame, by: list[str], value: str = "mean") -> DataFrame:
    """Flag the best row per column of a report."""
    return df.withColumn("best", F.abs(F.col(value) - F.max(value).over(W.partitionBy(*by))) < 1e-9)


def mismatch_matrix(df: DataFrame, src: str = "src", tgt: str = "tgt", value: str = "metric") -> DataFrame:
    """Mean per (source, target) over the diagonal of its target column."""
    g = df.groupBy(src, tgt).agg(F.avg(without_nan(value)).alias("mean"))
    diag = F.max(F.when(F.col(src) == F.col(tgt), F.col("mean"))).over(W.partitionBy(tgt))
    return g.withColumn("ratio", F.when(diag != 0, F.col("mean") / F.nullif(diag, F.lit(0.0))).otherwise(F.col("mean")))


def degradation(df: DataFrame, reference: DataFrame, key: str = "config", value: str = "metric") -> DataFrame:
    """1 - metric / reference mean of the same configuration; zero references drop out."""
    ref = reference.groupBy(key).agg(F.avg(without_nan(value)).alias("ref")).where("ref <> 0")
    return df.join(ref, key).withColumn("degradation", 1 - F.col(value) / F.col("ref"))


def transfer_matrix(df: DataFrame, random: DataFrame, agnostic: DataFrame) -> DataFrame:
    """(perf - random) / (diagonal - random) per target, and the same for the agnostic source."""
    v = without_nan("metric")
    perf = df.groupBy("tgt", "src").agg(F.avg(v).alias("perf"))
    rnd = random.groupBy("tgt").agg(F.avg(v).alias("rnd"))
    agn = agnostic.groupBy("tgt").agg(F.avg(v).alias("agn"))
    diag = F.max(F.when(F.col("src") == F.col("tgt"), F.col("perf"))).over(W.partitionBy("tgt"))
    d = perf.withColumn("diag", diag).join(rnd, "tgt", "left").join(agn, "tgt", "left")
    den = F.when(F.abs(F.col("diag") - F.col("rnd")) >= 1e-9, F.col("diag") - F.col("rnd"))
    return d.select("tgt", "src", "perf", ((F.col("perf") - F.col("rnd")) / den).alias("norm"), ((F.col("agn") - F.col("rnd")) / den).alias("norm_agnostic"))


def diagonal_gap(matrix: DataFrame, value: str = "norm") -> DataFrame:
    """Mean over targets of diagonal minus mean off-diagonal."""
    on = F.col("src") == F.col("tgt")
    g = matrix.groupBy("tgt").agg(F.max(F.when(on, F.col(value))).alias("d"), F.avg(F.when(~on, F.col(value))).alias("o"))
    return g.where("d is not null and o is not null").agg(F.avg(F.col("d") - F.col("o")).alias("gap"))


def tier_gaps(df: DataFrame, main: str, by: list[str], seed: str = "seed") -> DataFrame:
    """Main method minus the reference named in ``reference``, per tier: mean and sample deviation over seeds."""
    v = without_nan("metric")
    own = F.avg(F.when(F.col("method") == main, v))
    ref = F.avg(F.when(F.col("method") == F.col("reference"), v))
    per = df.groupBy(*by, seed).agg((own - ref).alias("_g"))
    return per.groupBy(*by).agg(F.avg("_g").alias("gap"), F.stddev_samp("_g").alias("sd"))


def stability(df: DataFrame, axes: list[str], value: str = "metric") -> DataFrame:
    """Spread of the mean along each axis, per method."""
    parts = []
    for a in axes:
        m = df.groupBy("method", a).agg(F.avg(without_nan(value)).alias("_m"))
        parts.append(m.groupBy("method").agg(F.stddev_samp("_m").alias("spread")).withColumn("axis", F.lit(a)))
    return reduce(DataFrame.unionByName, parts)


# -------------------------------------------------------- agreement of members

def pair_agreement(values: DataFrame, by: list[str], member: str, top_share: float = 0.05) -> DataFrame:
    """Spearman and top-share Jaccard of every pair of members over common samples.

    ``values`` is (by.., member, sample_id, value). A sample's ranks by all members become
    one array, and its pairs of members are summed by (left, right) before any shuffle, so no
    pairs of rows are built and the number of members is not limited.
    """
    keys = [*by, member]
    common = M.common_to_all(values, member, by=by)
    d = values.join(common, [*by, "sample_id"], "left_semi")
    d = cut_lineage(d.groupBy(*keys, "sample_id").agg(F.avg("value").alias("value")))
    top = ranked(d, keys, ["-value", "sample_id"], size_name="_n")
    top = top.where(F.col("rn") <= F.greatest(F.lit(1.0), F.bround(F.col("_n") * top_share)))
    r = average_rank(d, keys, "value", "_r").join(top.select(*keys, "sample_id", F.lit(1).alias("_t")), [*keys, "sample_id"], "left")
    one = F.struct(F.col(member).alias("m"), F.col("_r").alias("r"), F.coalesce("_t", F.lit(0)).alias("t"))
    per = r.groupBy(*by, "sample_id").agg(F.collect_list(one).alias("a"))

    def beside(x):
        later = F.filter("a", lambda y: y.m > x.m)
        return F.transform(later, lambda y: F.struct(x.m.alias("left"), y.m.alias("right"), x.r.alias("x"), y.r.alias("y"), x.t.alias("tx"), y.t.alias("ty")))

    pairs = per.select(*by, F.explode(F.flatten(F.transform("a", beside))).alias("p")).select(*by, "p.*")
    both = F.sum(F.col("tx") * F.col("ty"))
    return pairs.groupBy(*by, "left", "right").agg(
        M.correlation(F.col("x"), F.col("y")).alias("spearman"), (both / (F.sum("tx") + F.sum("ty") - both)).alias("jaccard")
    )
