"""Ranking and overlap metrics per group of a long (group.., sample_id, pred, truth) table."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from siftwork.functions.ids import hash_index
from siftwork.functions.ranks import average_rank, ranked, value_ranks

TOP = 100
SLICES_MOST = 1024  # slices of a side, besides values with a slice of their own; the table of counts is this squared
N_PAIRS = 5000


def correlation(a, b):
    """Pearson correlation as an aggregate; NULL without variance, also under ANSI division."""
    return F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))


def spearman(df: DataFrame, by: list[str], name: str = "spearman", a: str = "pred", b: str = "truth") -> DataFrame:
    """Correlation of average-tie ranks; NULL below two rows or without variance."""
    d = average_rank(df.select(*by, a, b), by, a, "_ra")
    d = average_rank(d, by, b, "_rb")
    return d.groupBy(*by).agg(correlation("_ra", "_rb").alias(name))


# --------------------------------------------------------------- Kendall tau-b


def _inversions(y: np.ndarray) -> int:
    """Pairs i < j with y_i > y_j, one stable pass per bit of the dense rank."""
    r = np.unique(y, return_inverse=True)[1].astype(np.int64)
    count = 0
    for bit in range(int(r.max(initial=0)).bit_length() - 1, -1, -1):
        prefix = r >> (bit + 1)
        order = np.argsort(prefix, kind="stable")
        one = (r[order] >> bit) & 1
        p = prefix[order]
        before = np.cumsum(one) - one
        start = np.r_[True, p[1:] != p[:-1]]
        base = np.repeat(before[start], np.diff(np.r_[np.flatnonzero(start), len(p)]))
        count += int((before - base)[one == 0].sum())
    return count


def signed_pairs(x: np.ndarray, y: np.ndarray) -> int:
    """Concordant minus discordant pairs; pairs tied in x or y count nothing."""
    up = np.lexsort((y, x))
    down = np.lexsort((-y, x))
    return _inversions(-y[down]) - _inversions(y[up])


def _sliced(df: DataFrame, by: list[str], col: str, out: str, rows_per_task: int) -> DataFrame:
    """Slice number of each value in value order; a value with many rows gets a slice of its own."""
    v = value_ranks(df, by, col)
    size = F.greatest(F.lit(rows_per_task), F.ceil(F.col("group_size") / SLICES_MOST))
    heavy = F.col("ties") >= size
    number = 2 * F.floor(F.col("below") / size) + heavy.cast("int")
    v = v.select(*by, col, number.cast("int").alias(out), heavy.alias(f"{out}_one"), F.col("ties").alias(f"{out}_ties"))
    return df.join(v, [*by, col])


def kendall_tau(df: DataFrame, by: list[str], name: str = "kendall_tau", rows_per_task: int = 500_000) -> DataFrame:
    """Tau-b by exact pair counts, without pairing rows.

    Both columns are cut into at most 2 * SLICES_MOST + 2 slices. Pairs in different slices on both
    sides come from the slice-by-slice table of counts; pairs that share a slice are
    counted inside it. A slice of one repeated value has no untied pair, so it is
    never gathered, and every other slice holds at most 2 * size rows.
    """
    from siftwork.session import cut_lineage

    d = _sliced(df.select(*by, "pred", "truth"), by, "pred", "a", rows_per_task)
    d = cut_lineage(_sliced(d, by, "truth", "b", rows_per_task))
    fields = ", ".join(f"{k} {dict(df.dtypes)[k]}" for k in by)

    def inside(*cuts: str) -> DataFrame:
        rows = d
        for c in cuts:
            rows = rows.where(~F.col(f"{c}_one"))

        def count(pdf: pd.DataFrame) -> pd.DataFrame:
            s = signed_pairs(pdf["pred"].to_numpy(), pdf["truth"].to_numpy())
            return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in by}, "s": [float(s)]})

        return rows.select(*by, *cuts, "pred", "truth").groupBy(*by, *cuts).applyInPandas(count, f"{fields}, s double")

    def across(pdf: pd.DataFrame) -> pd.DataFrame:
        table = np.zeros((int(pdf["a"].max()) + 1, int(pdf["b"].max()) + 1))
        table[pdf["a"], pdf["b"]] = pdf["n"]
        earlier = np.cumsum(table, axis=0) - table  # rows of earlier a
        low = np.cumsum(earlier, axis=1) - earlier
        high = earlier.sum(axis=1, keepdims=True) - low - earlier
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in by}, "s": [float((table * (low - high)).sum())]})

    cells = d.groupBy(*by, "a", "b").agg(F.count(F.lit(1)).alias("n"))
    cross = cells.groupBy(*by).applyInPandas(across, f"{fields}, s double")
    both = inside("a", "b").withColumn("s", -F.col("s"))
    signed = cross.unionByName(inside("a")).unionByName(inside("b")).unionByName(both)
    total = signed.groupBy(*by).agg(F.sum("s").alias("s"))
    ties = d.groupBy(*by).agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        (F.sum(F.col("a_ties") - 1) / 2.0).alias("tp"),
        (F.sum(F.col("b_ties") - 1) / 2.0).alias("tt"),
    )
    n0 = F.col("n") * (F.col("n") - 1) / 2
    den = F.sqrt((n0 - F.col("tp")) * (n0 - F.col("tt")))
    return total.join(ties, by).select(*by, F.when((F.col("n") >= 2) & (den > 0), F.col("s") / F.nullif(den, F.lit(0.0))).alias(name))


# ------------------------------------------------------------------ top-k


def _tops(df: DataFrame, by: list[str], k: int) -> tuple[DataFrame, DataFrame]:
    """Top k by prediction and by truth. The bound is constant: k rows per group and task are shuffled."""
    out = []
    for col in ("pred", "truth"):
        rn = F.row_number().over(W.partitionBy(*by).orderBy(F.desc(col), "sample_id"))
        out.append(df.withColumn("pos", rn).where(F.col("pos") <= k))
    return out[0], out[1]


def ndcg(df: DataFrame, by: list[str], k: int = TOP, name: str = "ndcg_at_k") -> DataFrame:
    """Gains are truth minus the group minimum; 0 when the ideal gain is 0."""
    low = df.groupBy(*by).agg(F.min("truth").alias("_low"))
    pred, ideal = _tops(df, by, k)

    def gain(top: DataFrame, out: str) -> DataFrame:
        g = (F.col("truth") - F.col("_low")) / F.log2(F.col("pos") + 1.0)
        return top.join(low, by).groupBy(*by).agg(F.sum(g).alias(out))

    j = gain(pred, "dcg").join(gain(ideal, "idcg"), by)
    return j.select(*by, F.when(F.col("idcg") > 0, F.col("dcg") / F.nullif("idcg", F.lit(0.0))).otherwise(0.0).alias(name))


def hit_rate(df: DataFrame, by: list[str], k: int = TOP, name: str = "topk_hit_rate") -> DataFrame:
    """Share of the true top k (at most the group size) found in the predicted top k."""
    pred, true = _tops(df, by, k)
    marks = pred.select(*by, "sample_id", F.lit(1).alias("p"), F.lit(0).alias("t")).unionByName(
        true.select(*by, "sample_id", F.lit(0).alias("p"), F.lit(1).alias("t"))
    )
    per = marks.groupBy(*by, "sample_id").agg(F.max("p").alias("p"), F.max("t").alias("t"))
    return per.groupBy(*by).agg((F.sum(F.col("p") * F.col("t")) / F.sum("t")).alias(name))


def pairwise_accuracy(df: DataFrame, by: list[str], n_pairs: int = N_PAIRS, seed: int = 0, name: str = "pairwise_acc") -> DataFrame:
    """Share of sampled pairs in the right order. Truth ties do not count; prediction ties are wrong."""
    rows = ranked(df.select(*by, "sample_id", "pred", "truth"), by, ["sample_id"], name="at")
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    p = sizes.select(*by, "n", F.explode(F.sequence(F.lit(1), F.lit(n_pairs))).alias("p"))

    def index(side: str):
        return hash_index(F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(side), F.col("p").cast("string"))), F.col("n")) + 1

    p = p.withColumn("i", index("i")).withColumn("j", index("j")).where("i <> j")
    need = p.select(*by, F.col("i").alias("at")).unionByName(p.select(*by, F.col("j").alias("at"))).distinct()
    few = rows.join(need, [*by, "at"])
    left = few.select(*by, F.col("at").alias("i"), F.col("pred").alias("pi"), F.col("truth").alias("ti"))
    right = few.select(*by, F.col("at").alias("j"), F.col("pred").alias("pj"), F.col("truth").alias("tj"))
    d = p.join(left, [*by, "i"]).join(right, [*by, "j"]).where("ti <> tj")
    same = F.signum(F.col("pi") - F.col("pj")) == F.signum(F.col("ti") - F.col("tj"))
    return d.groupBy(*by).agg(F.avg(same.cast("double")).alias(name))


def ranking_metrics(df: DataFrame, by: list[str], k: int = TOP) -> DataFrame:
    """All five metrics; a group with fewer than two labelled rows has NULLs."""
    known = df.where(F.col("truth").isNotNull() & F.col("pred").isNotNull())
    sizes = known.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where("_n >= 2").select(*by)
    known = known.join(sizes, by, "left_semi")
    out = df.select(*by).distinct()
    for m in (spearman(known, by), kendall_tau(known, by), ndcg(known, by, k), hit_rate(known, by, k), pairwise_accuracy(known, by)):
        out = out.join(m, by, "left")
    return out


# ---------------------------------------------------------------- set overlap


def overlap(members: DataFrame, set_col: str = "config", by: list[str] | None = None, id_col: str = "sample_id") -> DataFrame:
    """Jaccard of every pair of sets, diagonal included.

    Rows with the same membership pattern are counted first; only distinct patterns
    (not rows) are expanded into set pairs.
    """
    by = by or []
    pattern = members.groupBy(*by, id_col).agg(F.sort_array(F.collect_set(set_col)).alias("_sets"))
    counts = pattern.groupBy(*by, "_sets").agg(F.count(F.lit(1)).alias("_n"))
    p = counts.withColumn("left", F.explode("_sets")).withColumn("right", F.explode("_sets"))
    inter = p.groupBy(*by, "left", "right").agg(F.sum("_n").alias("inter"))
    size = counts.withColumn("s", F.explode("_sets")).groupBy(*by, "s").agg(F.sum("_n").alias("n"))
    ids = size.groupBy(*by).agg(F.collect_list(F.struct("s", "n")).alias("_all"))
    grid = ids.select(*by, F.explode("_all").alias("x"), "_all").select(*by, "x", F.explode("_all").alias("y"))
    grid = grid.select(*by, F.col("x.s").alias("left"), F.col("y.s").alias("right"), F.col("x.n").alias("na"), F.col("y.n").alias("nb"))
    g = grid.join(inter, [*by, "left", "right"], "left")
    i = F.coalesce("inter", F.lit(0))
    return g.select(*by, "left", "right", i.alias("inter"), (i / (F.col("na") + F.col("nb") - i)).alias("jaccard"))


def jaccard_of(inter, a, b):
    """Jaccard from counts; two empty sets agree fully."""
    union = F.col(a) + F.col(b) - F.col(inter)
    return F.when(union == 0, F.lit(1.0)).otherwise(F.col(inter) / F.nullif(union, F.lit(0)))


def common_to_all(members: DataFrame, set_col: str = "config", id_col: str = "sample_id", by: list[str] | None = None) -> DataFrame:
    """Ids that occur in every set of their group."""
    by = by or []
    wanted = members.groupBy(*by).agg(F.count_distinct(set_col).alias("_p")) if by else members.agg(F.count_distinct(set_col).alias("_p"))
    have = members.groupBy(*by, id_col).agg(F.count_distinct(set_col).alias("_h"))
    j = have.join(wanted, by) if by else have.withColumn("_p", wanted.scalar())
    return j.where("_h = _p").select(*by, id_col)
