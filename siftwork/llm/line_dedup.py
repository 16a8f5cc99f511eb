"""Line deduplication: a line that many documents share stays only in the first of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.functions.text import bind
from siftwork.llm.common import LOWER, SPACE, UPPER, body, store


def _stripped(line) -> Column:
    return F.btrim(line, F.lit(SPACE))


def line_dedup(docs: DataFrame, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """``docs`` (doc_id, text, ...) with ``kept_text``, ``n_lines`` and ``n_dropped`` added.

    A line's key is the line stripped and with A-Z lowered. Keys of ``min_chars`` code points or more that
    ``min_docs`` documents hold lose all their lines except in the smallest doc_id that holds the key.

    NULL text is one empty line. Rows with the same doc_id are one document; rows without an id are one document
    that comes after all others. Existing columns of the three names are replaced. An empty table gives none.

    Only hashes of lines are shuffled. A line that a third of all documents share is combined before its shuffle;
    in the join back it is split by adaptive execution, as nothing is grouped by key after that join.
    """
    made = ("kept_text", "n_lines", "n_dropped")
    docs = docs.drop(*made)
    key = [F.col("doc_id"), F.xxhash64(body()).alias("_t")]
    lines = docs.select(*key, F.posexplode(F.split(body(), "\n", -1)).alias("_pos", "_line"))
    long = lines.where(F.length(_stripped("_line")) >= min_chars)
    norm = long.withColumn("_key", F.translate(_stripped("_line"), UPPER, LOWER))
    keyed = store(
        norm.select("doc_id", "_t", "_pos", F.xxhash64("_key").alias("_a"), F.xxhash64(F.lit(7), "_key").alias("_b")),
        "line-keys",
    )
    first, holders = F.min("doc_id"), F.count_distinct("doc_id")
    if min_docs == 2:  # two ids suffice to tell, and they combine before the shuffle
        holders = F.when(F.min("doc_id") < F.max("doc_id"), 2).otherwise(F.count("doc_id").cast("boolean").cast("int"))
    none = F.max(F.col("doc_id").isNull().cast("int"))
    shared = (
        keyed.groupBy("_a", "_b")
        .agg(first.alias("_first"), (holders + none).alias("_n"))
        .where((F.col("_n") >= min_docs) & F.col("_first").isNotNull())
        .select("_a", "_b", "_first")
    )
    # a stored right side lets adaptive execution split a key that is frequent on the left
    lost = keyed.join(store(shared, "shared-lines"), ["_a", "_b"]).where(F.col("doc_id").isNull() | (F.col("doc_id") > F.col("_first")))
    drops = lost.groupBy("doc_id", "_t").agg(F.collect_set("_pos").alias("_drop"))

    d = docs.withColumn("_t", F.xxhash64(body())).alias("d")
    both = d.join(
        drops.alias("x"), F.col("d.doc_id").eqNullSafe(F.col("x.doc_id")) & (F.col("d._t") == F.col("x._t")), "left"
    ).select(*[F.col(f"d.`{c}`") for c in docs.columns], "x._drop")

    def rest(all_lines: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), F.col("_drop"))
        return F.array_join(F.transform(stay, lambda i: F.get(all_lines, i)), "\n")

    n_dropped = F.coalesce(F.size("_drop"), F.lit(0))
    kept = F.when(F.col("_drop").isNull(), body()).otherwise(bind(F.split(body(), "\n", -1), rest))
    return both.select(
        *docs.columns,
        kept.alias("kept_text"),
        (F.length(body()) - F.length(F.replace(body(), F.lit("\n"))) + 1).cast("bigint").alias("n_lines"),
        F.greatest(n_dropped, F.lit(0)).cast("bigint").alias("n_dropped"),
    )
