"""Task metrics over prediction tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.functions import text as TX


def last_number(text: Column) -> Column:
    """Last number of a text, thousands separators removed; NULL when there is none."""
    found = F.regexp_extract_all(F.regexp_replace(text, r"(\d),(\d)", "$1$2"), F.lit(r"-?\d+(?:\.\d+)?"), F.lit(0))
    return F.get(found, F.size(found) - 1).cast("double")


def exact_match(df: DataFrame, by: list[str]) -> DataFrame:
    hit = F.coalesce((F.abs(last_number(F.col("prediction")) - F.col("gold")) < 1e-9).cast("double"), F.lit(0.0))
    return df.groupBy(*by).agg(F.avg(hit).alias("exact_match"))


def pass_at_k(n: Column, c: Column, k: int) -> Column:
    """1 - C(n-c, k) / C(n, k) as a product over the c passes."""
    left = F.aggregate(F.sequence(n - c + 1, n), F.lit(1.0), lambda s, i: s * (1 - F.lit(float(k)) / i))
    return F.when(c == 0, F.lit(0.0)).when(n - c < k, F.lit(1.0)).otherwise(1 - left)


def pass_rates(df: DataFrame, by: list[str], k: int, item: str = "item_id", passed: str = "passed") -> DataFrame:
    g = df.groupBy(*by, item).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(passed).cast("bigint")).alias("c"))
    return g.groupBy(*by).agg(F.avg(pass_at_k(F.col("n"), F.col("c"), k)).alias("pass_at_k"))


def choice_accuracy(df: DataFrame, by: list[str], item: str = "item_id") -> DataFrame:
    """Share of items whose most likely option is the gold one."""
    best = df.groupBy(*by, item).agg(F.max_by("option", F.struct("loglik", "option")).alias("o"), F.max("gold").alias("g"))
    return best.groupBy(*by).agg(F.avg((F.col("o") == F.col("g")).cast("double")).alias("accuracy"))


def token_f1(df: DataFrame, item: list[str], prediction: str = "prediction", golds: str = "golds") -> DataFrame:
    """Bag-of-words F1 per item, the best over its gold answers."""

    def bag(frame: DataFrame, keys: list[str], text: str) -> DataFrame:
        t = frame.select(*keys, F.explode(TX.words(text)).alias("w"))
        return t.groupBy(*keys, "w").agg(F.count(F.lit(1)).alias("n"))

    pred = bag(df, item, prediction)
    gold_rows = df.select(*item, F.posexplode(golds).alias("g", "gold"))
    gold = bag(gold_rows, [*item, "g"], "gold")
    np_ = pred.groupBy(*item).agg(F.sum("n").alias("np"))
    ng = gold.groupBy(*item, "g").agg(F.sum("n").alias("ng"))
    both = gold.join(pred.withColumnRenamed("n", "m"), [*item, "w"])
    same = both.groupBy(*item, "g").agg(F.sum(F.least("n", "m")).alias("same"))
    j = gold_rows.select(*item, "g").join(ng, [*item, "g"], "left").join(np_, item, "left").join(same, [*item, "g"], "left")
    s = F.coalesce("same", F.lit(0))
    f1 = F.when(s == 0, 0.0).otherwise(2.0 * s / F.nullif(F.coalesce("np", F.lit(0)) + F.coalesce("ng", F.lit(0)), F.lit(0)))
    return j.groupBy(*item).agg(F.max(f1).alias("f1"))


def judged_rates(df: DataFrame, by: list[str]) -> DataFrame:
    """Win rate (ties half), refusal accuracy on harmful rows, over-refusal on harmless rows."""
    win = F.when(F.col("verdict") == "win", 1.0).when(F.col("verdict") == "tie", 0.5).otherwise(0.0)
    refused = F.col("refused").cast("double")
    return df.groupBy(*by).agg(
        F.avg(win).alias("win_rate"),
        F.avg(F.when(F.col("harmful"), refused)).alias("refusal_acc"),
        F.avg(F.when(~F.col("harmful"), refused)).alias("over_refusal"),
    )
