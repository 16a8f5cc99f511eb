"""Exact, normalised and near-duplicate removal, and decontamination.

Keep-first everywhere: of rows that match, and of a component of near duplicates, the
one with the smallest id stays. Groups of copies are never gathered: keepers come from
a combined ``min`` and are joined back on the unique id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.functions import text as TX
from siftwork.operators.gramfilter import bloom, only_likely
from siftwork.operators.setjoin import similar_components
from siftwork.session import cut_lineage

GRAM = 5


def keepers(df: DataFrame, key: Column, id_col: str = "sample_id") -> DataFrame:
    """Ids of the first row of every group of equal keys."""
    return df.select(id_col, key.alias("_k")).groupBy("_k").agg(F.min(id_col).alias(id_col)).select(id_col)


def drop_equal(df: DataFrame, key: Column, id_col: str = "sample_id") -> DataFrame:
    """Rows that are first among rows with an equal key."""
    return df.join(keepers(df, key, id_col), id_col, "left_semi")


def removed_equal(df: DataFrame, key: Column, id_col: str = "sample_id") -> DataFrame:
    return df.join(keepers(df, key, id_col), id_col, "left_anti")


# ------------------------------------------------------------- near duplicates


def gram_sets(df: DataFrame, text: str, id_col: str = "sample_id", n: int = GRAM) -> DataFrame:
    """(id, grams) of the rows that have at least one word."""
    return df.where(TX.has_word(text)).select(id_col, TX.ngram_hashes(TX.words(text), n).alias("grams"))


def near_components(df: DataFrame, text: str, id_col: str = "sample_id", threshold: float = 0.8) -> DataFrame:
    """(id, component) of the rows with a word: the smallest id that links of Jaccard >= threshold over word 5-grams lead to.

    See ``setjoin.similar_components``: exact, by prefix filter and star contraction.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text).alias("_text"))

    def sets_of(ids: DataFrame | None, how: str) -> DataFrame:
        return gram_sets(rows if ids is None else rows.join(ids, "id", how), "_text", "id")

    return similar_components(sets_of, threshold).withColumnRenamed("id", id_col)


def near_duplicates(df: DataFrame, text: str, id_col: str = "sample_id", threshold: float = 0.8) -> DataFrame:
    """Ids of rows that are not the first of their component of near duplicates."""
    return near_components(df, text, id_col, threshold).where(F.col(id_col) != F.col("component")).select(id_col)


def dedup_stages(df: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(sample_id, stage) of every row: exact, normalised, near, or kept."""
    whole = F.concat_ws(" ", "instruction", "response")
    exact = F.sha2(F.concat_ws("\u001f", "instruction", "response", F.coalesce("source", F.lit(""))), 256)
    narrow = df.select("sample_id", exact.alias("h"), F.md5(TX.normal_form(whole)).alias("norm"), whole.alias("text"))
    first = cut_lineage(drop_equal(narrow, F.col("h")))
    second = cut_lineage(drop_equal(first, F.col("norm")))
    near = cut_lineage(near_duplicates(second, "text", threshold=threshold))

    def tag(rows: DataFrame, stage: str) -> DataFrame:
        return rows.select("sample_id", F.lit(stage).alias("stage"))

    parts = [
        tag(narrow.join(first, "sample_id", "left_anti"), "exact"),
        tag(first.join(second, "sample_id", "left_anti"), "normalised"),
        tag(near, "near"),
        tag(second.join(near, "sample_id", "left_anti"), "kept"),
    ]
    return reduce(DataFrame.unionByName, parts)


# ------------------------------------------------------------ decontamination


def line_windows(df: DataFrame, items: DataFrame, text: str = "text", item_text: str = "text") -> DataFrame:
    """(sample_id, first_line, n_lines, text, norm): every run of as many lines as some item has, and its normal form.

    The distinct line counts of the items (a handful) are read first. One-line items thus
    meet single lines, and an item of three lines meets every three lines of a row. Normal
    forms are made once a line: a run's is that of its lines, put together.
    """
    def lines(c):
        return F.split(F.col(c), "\n", -1)

    def with_norms(all_lines):
        return TX.bind(F.transform(all_lines, TX.normal_form), lambda norms: windows(all_lines, norms))

    counts = sorted(r[0] for r in items.select(F.size(lines(item_text)).alias("n")).where("n > 0").distinct().collect())

    def windows(all_lines, norms):
        def of(n):
            starts = F.when(F.size(all_lines) >= n, F.sequence(F.lit(1), F.size(all_lines) - n + 1)).otherwise(F.array().cast("array<int>"))
            return F.transform(
                starts,
                lambda i: F.struct(
                    i.cast("bigint").alias("first_line"),
                    F.lit(n).cast("bigint").alias("n_lines"),
                    F.array_join(F.slice(all_lines, i, F.lit(n)), "\n").alias("text"),
                    F.array_join(F.slice(norms, i, F.lit(n)), "").alias("norm"),
                ),
            )

        return F.flatten(F.array(*[of(n) for n in counts or [1]]))

    each = df.where(F.col(text).isNotNull()).select("sample_id", F.explode(TX.bind(lines(text), with_norms)).alias("w"))
    return each.select("sample_id", "w.*")


def matching_items(df: DataFrame, items: DataFrame, text: str = "text", item_text: str = "text") -> DataFrame:
    """Rows equal to a test item, exactly or in normal form (column ``norm``, where there is one). Aggregated keys, no pairs."""

    def kinds(exact: Column, norm: Column) -> Column:
        made = [F.struct(F.lit(kind).alias("kind"), F.md5(c).alias("k")) for kind, c in (("exact", exact), ("normalised", norm))]
        return F.explode(F.array(*made)).alias("w")

    norm = F.col("norm") if "norm" in df.columns else TX.normal_form(text)
    keys = items.select(kinds(F.col(item_text), TX.normal_form(item_text))).select("w.*").distinct()
    both = df.select("sample_id", kinds(F.col(text), norm)).select("sample_id", "w.*")
    return both.join(keys, ["kind", "k"], "left_semi").select("sample_id", "kind")


def _shared_grams(docs: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    """(id, item_id, jaccard) of the sets (id, grams) and item sets (item_id, grams) that reach the threshold.

    Grams that no item has are dropped inside the scan by a Bloom filter over the items' grams, and so is a row whose
    remaining grams are less than ``threshold`` of all of its own (its similarity to any item is below that share).
    What is left is joined on the gram; counts are exact.
    """
    its = cut_lineage(items.withColumn("ni", F.size("grams")))
    grams = its.select("item_id", "ni", F.explode("grams").alias("gram"))
    some = only_likely(docs.withColumn("nd", F.size("grams")), "grams", bloom(grams))
    some = some.where((F.size("grams") > 0) & (F.size("grams") >= F.lit(threshold) * F.col("nd")))
    hits = some.select("id", "nd", F.explode("grams").alias("gram")).join(grams, "gram")
    hits = hits.groupBy("id", "item_id", "nd", "ni").agg(F.count(F.lit(1)).alias("inter"))
    j = F.col("inter") / (F.col("nd") + F.col("ni") - F.col("inter"))
    return hits.withColumn("jaccard", j).where(F.col("jaccard") >= threshold).select("id", "item_id", "jaccard")


def gram_overlap(df: DataFrame, items: DataFrame, text: str = "text", n: int = 13, threshold: float = 0.5) -> DataFrame:
    """(sample_id, item_id, jaccard) with n-gram Jaccard >= threshold; only grams that an item has leave the scan."""
    docs = gram_sets(df, text, "sample_id", n).withColumnRenamed("sample_id", "id")
    return _shared_grams(docs, gram_sets(items, "text", "item_id", n), threshold).withColumnRenamed("id", "sample_id")


def near_items(df: DataFrame, items: DataFrame, text: str = "text", threshold: float = 0.8) -> DataFrame:
    """(sample_id, item_id) at 5-gram Jaccard >= threshold, exactly."""
    docs = gram_sets(df, text, "sample_id").withColumnRenamed("sample_id", "id")
    found = _shared_grams(docs, gram_sets(items, "text", "item_id"), threshold)
    return found.select(F.col("id").alias("sample_id"), "item_id")


def near_windows(df: DataFrame, items: DataFrame, text: str = "text", threshold: float = 0.8) -> DataFrame:
    """(sample_id, first_line, n_lines, item_id): ``line_windows`` at 5-gram Jaccard >= threshold with an item, exactly.

    Every run of GRAM words of a window is one of its row, and a window shares at least ``threshold`` of an item's grams.
    So a row is tested once by Bloom filters of the items' grams (two, because a long row has many grams that one lets
    pass), and windows are cut only from rows that hold that share of the shortest item, or that have lines of fewer
    words where an item has as few.
    """
    def again(gram):
        return F.xxhash64(gram, F.lit(1))

    long = gram_sets(items.where(F.size(TX.words("text")) >= GRAM), "text", "item_id")
    grams = long.select(F.explode("grams").alias("gram"))
    least = long.agg(F.min(F.size("grams"))).head()[0] or 1
    tested = df.where(F.col(text).isNotNull()).withColumn("_g", TX.ngram_hashes(TX.words(text), GRAM))
    tested = only_likely(tested, "_g", bloom(grams)).withColumn("_g", F.transform("_g", again))
    keep = F.size("_g") >= F.lit(threshold * least - 1e-9)
    tested = only_likely(tested, "_g", bloom(grams.select(again("gram").alias("gram"))))
    if not items.where(F.size(TX.words("text")).between(1, GRAM - 1)).isEmpty():
        keep = keep | F.exists(F.split(F.col(text), "\n", -1), lambda line: F.size(TX.words(line)) < GRAM)
    windows = line_windows(tested.where(keep).drop("_g"), items, text)
    keyed = windows.select(F.struct("sample_id", "first_line", "n_lines").alias("sample_id"), "text")
    return near_items(keyed, items, threshold=threshold).select("sample_id.*", "item_id")


def backfill(removed: DataFrame, reserve: DataFrame, seed: int = 0, bucket: str = "source") -> DataFrame:
    """Rows of the reserve that replace removed rows, bucket by bucket."""
    from siftwork.functions.ids import order_key
    from siftwork.functions.ranks import ranked

    need = removed.groupBy(bucket).agg(F.count(F.lit(1)).alias("need"))
    keyed = reserve.join(F.broadcast(need) if bucket == "source" else need, bucket)
    keyed = keyed.withColumn("_h", order_key(seed, "sample_id"))
    return ranked(keyed, [bucket], ["_h", "sample_id"], upto="need", name="fill").drop("_h", "need")


def disjoint(df: DataFrame, *others: DataFrame, key: str = "content") -> DataFrame:
    """Rows whose content hash occurs in none of the other sets."""
    for o in others:
        df = df.join(o.select(key), key, "left_anti")
    return df


def manifest(df: DataFrame, by: str = "source") -> DataFrame:
    """Rows and an order-free checksum per source; combines map-side."""
    digest = F.conv(F.substring(F.sha2(F.concat_ws("\u001f", "instruction", "response"), 256), 1, 15), 16, 10)
    return df.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_rows"), F.bit_xor(digest.cast("bigint")).alias("checksum")
    )
