"""Token budgets, smoothed bigram statistics, pooled token vectors and layer statistics."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.functions import vectors as V
from siftwork.operators.bigrams import bigram_sums
from siftwork.operators.common import attach

BOS, EOS = "<s>", "</s>"


def with_token_budget(
    df: DataFrame, instr: Column, resp: Column, max_len: int | None = 1024, bos: str | None = BOS, eos: str | None = EOS
) -> DataFrame:
    """Add ``tokens`` and 0/1 ``mask``: the response is kept first, the instruction loses its head.

    ``max_len=None`` keeps whole texts.
    """
    if max_len is not None and max_len <= 0:
        raise ValueError("max_len must be positive")
    i = F.concat(F.array(F.lit(bos)), instr) if bos else instr
    r = F.concat(resp, F.array(F.lit(eos))) if eos else resp
    d = df.withColumn("_i", i).withColumn("_r", r)
    if max_len is None:
        mask = F.concat(F.array_repeat(F.lit(0), F.size("_i")), F.array_repeat(F.lit(1), F.size("_r")))
        return d.withColumn("tokens", F.concat("_i", "_r")).withColumn("mask", mask).drop("_i", "_r")
    room = F.lit(max_len) - F.size("_r")
    keep = F.least(F.size("_i"), F.greatest(room, F.lit(0)))
    kept = F.when(keep > 0, F.slice("_i", F.size("_i") - keep + 1, keep)).otherwise(F.array().cast("array<string>"))
    d = d.withColumn("_k", kept)
    d = d.withColumn("tokens", F.when(room <= 0, F.slice("_r", 1, max_len)).otherwise(F.concat("_k", "_r")))
    mask = F.when(room <= 0, F.array_repeat(F.lit(1), max_len)).otherwise(
        F.concat(F.array_repeat(F.lit(0), F.size("_k")), F.array_repeat(F.lit(1), F.size("_r")))
    )
    d = d.withColumn("mask", mask)
    # at least one supervised token
    forced = F.transform("mask", lambda m, at: F.when(at == F.size("mask") - 1, 1).otherwise(m))
    d = d.withColumn("mask", F.when((F.size("mask") > 0) & (F.coalesce(F.array_max("mask"), F.lit(0)) == 0), forced).otherwise(F.col("mask")))
    return d.drop("_i", "_r", "_k")


def bigram_counts(tokenised: DataFrame) -> DataFrame:
    """(prev, next, c): bigrams of all rows, combined before they are shuffled."""
    n = F.size("tokens") - 1
    steps = F.arrays_zip(F.slice("tokens", 1, n).alias("prev"), F.slice("tokens", 2, n).alias("next"))
    d = tokenised.where(F.size("tokens") >= 2).select(F.explode(steps).alias("t")).select("t.*")
    return d.groupBy("prev", "next").agg(F.count(F.lit(1)).alias("c"))


def bigram_model(pairs: DataFrame, k: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Add-k model of stored counts (prev, next, c): (prev, next, lp, entropy) with the entropy of the context, and the vocabulary size."""
    # with a(c) = (c + k) ln(c + k) and d = total + k * vocabulary the entropy is a sum over the context's own rows
    a = (F.col("c") + k) * F.log(F.col("c") + k)
    ctx = pairs.groupBy("prev").agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("seen"), F.sum(a).alias("_a"))
    words = pairs.select(F.col("prev").alias("w")).distinct().unionByName(pairs.select(F.col("next").alias("w")).distinct())
    size = words.distinct().agg(F.count(F.lit(1)).cast("double").alias("vocab"))
    d = F.col("total") + k * F.col("vocab")
    seen = (F.log(d) * (F.col("total") + k * F.col("seen")) - F.col("_a")) / d
    unseen = (F.col("vocab") - F.col("seen")) * (F.lit(float(k)) / d) * F.log(F.lit(float(k)) / d)
    ctx = attach(ctx, size).select("prev", F.log(d).alias("_d"), (seen - unseen).alias("entropy"))
    # a context has at most one row per word, so nothing larger than the vocabulary meets here
    p = pairs.join(ctx, "prev")
    return p.select("prev", "next", (F.log(F.col("c") + k) - F.col("_d")).alias("lp"), "entropy"), size


def token_stats(tokenised: DataFrame, id_col: str = "sample_id", k: float = 0.5) -> DataFrame:
    """The seven model statistics per row, under the add-k bigram model of the pool.

    Loss is over supervised tokens, or over all when none is supervised; rows of one id count as one. See
    ``bigrams.bigram_sums``: bigrams move packed, once a chunk of rows.
    """
    sums = bigram_sums(tokenised, id_col, k)
    how = {"n": F.sum, "l1": F.sum, "l2": F.sum, "lmin": F.min, "h1": F.sum, "hmax": F.max}
    s = F.col("supervised")
    over = [f(F.when(s == on, F.col(c))).alias(f"{c}_{t}") for t, on in (("s", True), ("a", False)) for c, f in how.items()]
    a = sums.groupBy(id_col).agg(*over)

    def pick(name: str) -> Column:
        return F.when(F.coalesce("n_s", F.lit(0)) > 0, F.col(f"{name}_s")).otherwise(F.col(f"{name}_a"))

    n = pick("n")
    mean = -pick("l1") / n
    var = pick("l2") / n - mean * mean
    return a.select(
        id_col,
        mean.alias("loss_mean"),
        F.sqrt(F.greatest(var, F.lit(0.0))).alias("loss_std"),
        (-pick("lmin")).alias("loss_max"),
        F.exp(F.least(mean, F.lit(20.0))).alias("ppl"),
        (-mean).alias("avg_logprob"),
        (pick("h1") / n).alias("entropy_mean"),
        pick("hmax").alias("entropy_max"),
    )


MODEL_STATS = ["loss_mean", "loss_std", "loss_max", "ppl", "avg_logprob", "entropy_mean", "entropy_max"]


def with_model_stats(pool: DataFrame, stats: DataFrame, id_col: str = "sample_id") -> DataFrame:
    """Rows with fewer than two tokens have all statistics zero."""
    d = pool.join(stats, id_col, "left")
    for c in MODEL_STATS:
        d = d.withColumn(c, F.coalesce(c, F.lit(0.0)))
    return d


# --------------------------------------------------------------- token vectors


def masked(df: DataFrame, keys: list[str], mask: str = "mask") -> DataFrame:
    """Rows under the mask, or all rows of a key whose mask is empty. Keys are (row, layer): token-budget sized."""
    any_on = df.groupBy(*keys).agg(F.max(mask).alias("_any"))
    return df.join(any_on, keys).where((F.col(mask) == 1) | (F.col("_any") == 0)).drop("_any")


def pool_mean(df: DataFrame, keys: list[str], vec: str = "vec") -> DataFrame:
    return V.vector_mean(masked(df, keys), vec, keys, "pooled")


def pool_last(df: DataFrame, keys: list[str], vec: str = "vec") -> DataFrame:
    return df.groupBy(*keys).agg(F.max_by(vec, "pos").alias("pooled"))


def pool_weighted(df: DataFrame, keys: list[str], weight: str, vec: str = "vec") -> DataFrame:
    v = array_to_vector(V.doubles(vec))
    m = df.groupBy(*keys).agg(Summarizer.mean(v, F.col(weight).cast("double")).alias("_m"))
    return m.select(*keys, vector_to_array("_m").alias("pooled"))


def layer_stats(df: DataFrame, keys: list[str], head_blocks: int = 8) -> DataFrame:
    """Eight statistics per (row, layer) from token vectors ``attn``, ``mlp``, ``resid`` with ``pos`` and ``mask``."""
    ends = df.groupBy(*keys).agg(F.min_by("resid", "pos").alias("f"), F.max_by("resid", "pos").alias("l"))
    d = masked(df, keys)
    width = F.size("attn")
    nb = F.greatest(F.lit(1), F.least(F.lit(head_blocks), width))
    per = F.floor(width / nb).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), nb - 1), lambda b: V.norm(F.slice("attn", b * per + 1, per)))
    d = d.withColumn("na", V.norm("attn")).withColumn("_b", blocks)
    bm = V.total("_b") / F.size("_b")
    d = d.withColumn("_bm", bm)
    block_var = F.aggregate("_b", F.lit(0.0), lambda s, x: s + (x - F.col("_bm")) * (x - F.col("_bm"))) / F.size("_b")
    mean_abs = V.total(F.transform("mlp", lambda x: F.abs(x))) / F.size("mlp")
    a = d.groupBy(*keys).agg(
        F.avg("na").alias("norm_attn"),
        F.avg(V.norm("mlp")).alias("norm_mlp"),
        F.avg(V.norm("resid")).alias("norm_resid"),
        F.collect_list("na").alias("_na"),  # at most one value per token of the budget
        F.avg(block_var).alias("head_norm_var"),
        F.avg(mean_abs).alias("mlp_mean_abs"),
        Summarizer.metrics("variance", "count").summary(array_to_vector(V.doubles("resid"))).alias("_r"),
    )
    n = F.col("_r.count").cast("double")
    var = vector_to_array(F.col("_r.variance"))
    token_var = F.when(n > 1, V.total(var) / F.size(var) * (n - 1) / n).otherwise(0.0)
    total = F.greatest(V.total("_na"), F.lit(1e-8))
    a = a.withColumn("token_var", token_var).withColumn("_t", total)
    share = F.transform("_na", lambda x: x / F.col("_t"))
    a = a.withColumn("_p", share).withColumn("attn_entropy", -V.total(F.transform("_p", lambda p: p * F.log(p + 1e-12))))
    a = a.join(ends, keys).withColumn(
        "first_last", V.dot("f", "l") / F.greatest(V.norm("f") * V.norm("l"), F.lit(1e-8))
    )
    return a.select(
        *keys, "norm_attn", "norm_mlp", "norm_resid", "attn_entropy", "head_norm_var", "mlp_mean_abs", "token_var", "first_last"
    )
