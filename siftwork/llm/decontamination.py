"""Benchmark items inside documents: SimHash windows, Hamming blocks, weighted shingles (built-in functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwork.functions.text import bind
from siftwork.llm.common import small, store

SHINGLE = 5
BITS = 64
RADIUS = 21  # of 64 bits: four deviations above the mean distance of a pair at a similarity of 0.8


def words(text: str) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def grams(w: Column, k: Column) -> Column:
    """Shingles of k words at each position as one string each; needs size(w) >= k."""
    return F.transform(F.sequence(F.lit(1), F.size(w) - k + 1), lambda i: F.array_join(F.slice(w, i, k), " "))


def gram_length(w: Column, n: int = SHINGLE) -> Column:
    return F.least(F.size(w), F.lit(n))


def signed(h: str, weight: str) -> list[Column]:
    """The weight in whole 2^20ths, signed by each bit of a shingle's hash: sums of them are exact in any order."""
    whole = F.round(F.col(weight) * (1 << 20)).cast("bigint")
    return [F.when(F.shiftrightunsigned(h, i).bitwiseAND(F.lit(1).cast("bigint")) == 1, whole).otherwise(-whole) for i in range(BITS)]


def simhash(sums: list[str]) -> Column:
    """64-bit fingerprint: bit i is the sign of the i-th sum of signed weights."""
    out = F.lit(0).cast("bigint")
    for i, s in enumerate(sums):
        out = out.bitwiseOR(F.when(F.col(s) >= 0, F.shiftleft(F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint")))
    return out


def blocks(print_: Column, radius: int = RADIUS) -> Column:
    """radius + 1 blocks of bits: fingerprints within the radius agree on one block at least."""
    n = radius + 1
    parts = []
    for b in range(n):
        lo, hi = BITS * b // n, BITS * (b + 1) // n
        value = F.shiftrightunsigned(print_, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1).cast("bigint"))
        parts.append(F.struct(F.lit(b).alias("b"), value.alias("v")))
    return F.array(*parts)


def near_prints(windows: DataFrame, prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(window, distance) of the ``windows`` (window, item, f) within ``radius`` bits of their item's print (item, print).

    Multi-index: a window and an item meet where one of radius + 1 blocks is equal, so none within the radius is missed.
    """
    left = windows.select("window", "item", "f", F.explode(blocks(F.col("f"), radius)).alias("x")).select("window", "item", "f", "x.*")
    right = prints.select("item", "print", F.explode(blocks(F.col("print"), radius)).alias("x")).select("item", "print", "x.*")
    met = left.join(right, ["item", "b", "v"]).withColumn("distance", F.bit_count(F.col("f").bitwiseXOR(F.col("print"))))
    return met.where(F.col("distance") <= radius).select("window", "distance").distinct()


def find_items(docs: DataFrame, items: DataFrame, threshold: float = 0.8, n: int = SHINGLE) -> DataFrame:
    """(doc_id, item_id, start, n_words, similarity, distance): where documents hold benchmark items.

    ``docs`` (doc_id, text) and ``items`` (item_id, text). Texts are lowered and split at white space; a shingle is
    n words (all words of a shorter item). Its weight is 1 + ln((items + 1) / (items with it + 1)). The similarity
    of an item and a window of as many words is the weight of common shingles over the weight of all.

    1. An item's anchors are its rarest shingles, as many as a window must share one of to reach the threshold at
       all. Every window of the item's size that contains an anchor, wherever in the window it stands, gets a SimHash
       fingerprint. Its 64 sums of signed weights are running sums over the starts: a shingle counts from where a
       window first reaches it (or has passed its occurrence before) up to its own place.
    2. Hamming blocks find the windows within RADIUS bits of the item's fingerprint, all of them.
    3. The exact similarity, from running sums as well, verifies them. A window beyond the radius that reaches the
       threshold all the same (about one in 10,000 at 0.8) is taken by its similarity, with distance NULL. The best
       window of each (document, item) is returned.

    A document without a match has no row. NULL or empty texts match nothing; equal rows give one result; rows
    with equal ids and different texts are searched apart; rows without an id are searched too. Other columns are
    not read. Anchors and matched ids are broadcast only up to a counted size.
    """
    best = _windows(docs, items, threshold, n).groupBy("doc_id", "item_id").agg(
        F.max_by(F.struct("start", "m", "similarity", "distance"), F.struct("similarity", -F.col("start"))).alias("x")
    )
    return best.select("doc_id", "item_id", "x.start", F.col("x.m").alias("n_words"), "x.similarity", "x.distance")


def _windows(docs: DataFrame, items: DataFrame, threshold: float = 0.8, n: int = SHINGLE) -> DataFrame:
    """(doc_id, t, item_id, m, start, similarity, distance) of windows that match; t is the hash of the row's text."""
    it = items.select("item_id", words("text").alias("w")).where(F.size("w") > 0).distinct()
    it = it.withColumn("k", gram_length(F.col("w"), n)).withColumn("item", F.xxhash64("item_id", "w"))
    parts = store(
        it.select("item_id", "item", "k", F.size("w").alias("m"), F.posexplode(grams(F.col("w"), F.col("k"))).alias("off", "g")),
        "items",
    )
    total = parts.agg(F.count_distinct("item").alias("c"))
    df = parts.groupBy("g").agg(F.count_distinct("item").alias("df"))
    weight = F.lit(1.0) + F.log((F.lit(1.0) + total.scalar()) / (1.0 + F.coalesce(F.col("df"), F.lit(0))))
    df = small(store(df.withColumn("weight", weight).select("g", "weight"), "weights"))
    absent = F.lit(1.0) + F.log(F.lit(1.0) + total.scalar())
    weighed = parts.groupBy("item_id", "item", "k", "m", "g").agg(F.min("off").alias("off")).join(df, "g")
    rare = Window.partitionBy("item").orderBy(F.col("weight").desc(), F.xxhash64("g"))
    from_here = F.sum("weight").over(rare.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    whole = F.sum("weight").over(Window.partitionBy("item"))
    weighed = store(
        weighed.withColumn("anchor", from_here >= threshold * whole * (1 - 1e-9)).withColumn("total", whole), "weighed"
    )

    weighed = weighed.withColumn("h", F.xxhash64("g"))
    anchors = small(store(weighed.where("anchor").select("k", "h", "item", "m"), "anchors"))
    lengths = [r[0] for r in parts.select("k").distinct().collect()]  # at most n values
    d = docs.select(F.col("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("t"), "text")

    def hashes(w: Column) -> Column:
        def of(k: int) -> Column:
            each = F.transform(grams(w, F.lit(k)), lambda g: F.xxhash64(g))
            return F.struct(F.lit(k).alias("k"), F.when(F.size(w) >= k, each).alias("hs"), F.size(w).alias("n"))

        return F.array(*[of(k) for k in lengths])

    if not lengths:
        lengths = [n]
    by_length = d.select("doc_id", "t", F.explode(bind(words("text"), hashes)).alias("x")).select("doc_id", "t", "x.*")
    placed = by_length.select("doc_id", "t", "k", "n", F.posexplode("hs").alias("pos", "h")).join(anchors, ["k", "h"])
    ends = placed.groupBy("doc_id", "t", "item", "k", "m", "n").agg(F.min("pos").alias("a"), F.max("pos").alias("z"))
    # the first and the last start of a window that has an anchor
    first = F.greatest(F.lit(0), F.col("a") - F.col("m") + F.col("k"))
    last = F.least(F.col("z"), F.greatest(F.lit(0), F.col("n") - F.col("m")))
    pairs = store(ends.select("doc_id", "t", "item", "k", "m", first.alias("lo"), last.alias("hi")), "pairs")

    hit = small(store(pairs.select(F.col("doc_id").alias("_d"), F.col("t").alias("_t")).distinct(), "hits"))
    found = d.join(hit, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("t") == F.col("_t")), "left_semi")
    found = found.dropDuplicates(["doc_id", "t"]).select(F.col("doc_id").alias("_d"), F.col("t").alias("_t"), words("text").alias("w"))
    near = pairs.join(found, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("t") == F.col("_t")))
    region = F.slice("w", F.col("lo") + 1, F.col("hi") - F.col("lo") + F.col("m"))
    near = near.select("doc_id", "t", "item", "k", "m", "lo", "hi", region.alias("w")).where(F.size("w") >= F.col("k"))
    each = near.select("doc_id", "t", "item", "k", "m", "lo", "hi", F.posexplode(grams(F.col("w"), F.col("k"))).alias("pos", "g"))
    each = each.withColumn("pos", F.col("pos") + F.col("lo")).withColumn("h", F.xxhash64("g"))
    weights = small(store(df.select(F.xxhash64("g").alias("h"), "weight"), "shingle-weights"))
    own = small(store(weighed.select("item", "h", F.col("weight").alias("common")), "item-shingles"))
    each = each.drop("g").join(weights, "h", "left").join(own, ["item", "h"], "left")
    before = F.lag("pos").over(Window.partitionBy("doc_id", "t", "item", "h").orderBy("pos"))
    start = F.greatest(F.col("lo"), F.col("before") + 1, F.col("pos") - F.col("m") + F.col("k"))
    w, c = F.coalesce("weight", absent), F.coalesce("common", F.lit(0.0))
    change = F.array(
        F.struct(start.alias("start"), w.alias("w"), c.alias("c")), F.struct((F.col("pos") + 1).alias("start"), (-w).alias("w"), (-c).alias("c"))
    )
    changes = each.withColumn("before", before).select("doc_id", "t", "item", "m", "hi", "h", F.explode(change).alias("x"))
    changes = changes.select("doc_id", "t", "item", "m", "hi", "h", "x.*")
    names = [f"s{i}" for i in range(BITS)]
    bits = [F.sum(c).alias(s) for c, s in zip(signed("h", "w"), names)]
    changes = changes.groupBy("doc_id", "t", "item", "m", "hi", "start").agg(F.sum("w").alias("w"), F.sum("c").alias("c"), *bits)
    upto = Window.partitionBy("doc_id", "t", "item").orderBy("start").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = changes.select("doc_id", "t", "item", "m", "hi", "start", *[F.sum(s).over(upto).alias(s) for s in ("w", "c", *names)])
    windows = sums.where("start <= hi AND c > 0.5").select("doc_id", "t", "item", "m", "start", "w", "c", simhash(names).alias("f"))
    windows = store(windows.withColumn("window", F.xxhash64("doc_id", "t", "item", "start")), "windows")

    one = weighed.groupBy("item", "item_id").agg(F.max("total").alias("of"), *[F.sum(c).alias(s) for c, s in zip(signed("h", "weight"), names)])
    named = store(one.select("item", "item_id", "of", simhash(names).alias("print")), "item-prints")
    close = near_prints(windows, named)
    scored = windows.join(small(named), "item").join(close, "window", "left")
    similarity = F.round(F.col("c") / (F.col("w") + F.col("of") - F.col("c")), 9)
    scored = scored.withColumn("similarity", similarity).where(F.col("similarity") >= threshold)
    return scored.select("doc_id", "t", "item_id", "m", "start", "similarity", "distance")


def decontaminate(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows in which an item was found; other rows of the same id, or without one, stay."""
    bad = _windows(docs, items, **options).select(F.col("doc_id").alias("_bad"), F.col("t").alias("_t")).distinct()
    text = F.xxhash64(F.coalesce("text", F.lit("")))
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("_bad")) & (text == F.col("_t")), "left_anti")
