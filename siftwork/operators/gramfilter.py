"""Bloom filter over the grams of test items, tested inside the scan of a corpus."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_GRAM = 16  # with four probes about one gram in 400 passes without being an item's
MOST_BITS = 1 << 27  # 16 MB in every task; more grams than that are joined without a filter


def _probes(gram: Column, bits: int) -> list[Column]:
    """Four bit numbers of a 64-bit gram hash: either half of it and of its own hash."""
    out = []
    for h in (gram, F.xxhash64(gram)):
        out += [half.bitwiseAND(F.lit(bits - 1).cast("bigint")) for half in (h, F.shiftrightunsigned(h, 32))]
    return out


def bloom(grams: DataFrame, column: str = "gram") -> tuple[Column, int] | None:
    """The filter over all values of a column: an array of 64-bit words and its bits; None where it would be too large.

    Bits are set by one aggregation over the table where it lies; the words are a scalar subquery, so only they
    travel. The size follows the counted values.
    """
    distinct = grams.select(F.col(column).alias("g")).distinct()
    bits = max(64, 1 << (BITS_PER_GRAM * max(1, distinct.count()) - 1).bit_length())
    if bits > MOST_BITS:
        return None
    at = distinct.select(F.explode(F.array(*_probes(F.col("g"), bits))).alias("at"))
    one = F.expr("shiftleft(1L, CAST(at & 63 AS INT))")
    words = at.groupBy(F.shiftright("at", 6).alias("w")).agg(F.bit_or(one).alias("b"))
    every = grams.sparkSession.range(bits // 64).select(F.col("id").alias("w")).join(words, "w", "left")
    rows = F.sort_array(F.collect_list(F.struct("w", F.coalesce("b", F.lit(0).cast("bigint")).alias("b"))))
    return every.agg(F.transform(rows, lambda r: r.b).alias("words")).scalar(), bits


def only_likely(df: DataFrame, grams: str, known: tuple[Column, int] | None) -> DataFrame:
    """``df`` with the array ``grams`` cut down to what the filter knows: all of the items' grams and few others."""
    if known is None:
        return df
    words, bits = known

    def test(g: Column) -> Column:
        def is_set(at: Column) -> Column:
            word = F.get("_words", F.shiftright(at, 6).cast("int"))
            bit = at.bitwiseAND(F.lit(63).cast("bigint")).cast("int")
            return F.call_function("shiftright", word, bit).bitwiseAND(F.lit(1).cast("bigint")) == 1

        return reduce(lambda a, b: a & b, map(is_set, _probes(g, bits)))

    return df.withColumn("_words", words).withColumn(grams, F.filter(grams, test)).drop("_words")
