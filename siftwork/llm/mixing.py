"""Mixing sources to target weights by Pareto order sampling (built-in functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwork.llm.common import WORD, small, store

SLOTS = 16  # bits of the draw that make a slot; a slot holds about a 65,536th of a source


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def draw(seed: str) -> Column:
    """A number in (0, 1) from md5 of the id: 52 bits, the same in every run and engine."""
    text = F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """Targets of sources (source, source_size): weights repeat over the sources in code point order, NULL last.

    A target above ``cap`` times its source stops there and the excess goes to the others by weight. Sources sorted
    by the level at which they fill up give the answer in one pass. The windows hold one row for each source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(w) for w in weights])
    w = sizes.withColumn("_w", F.get(cycle, F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))))
    full = F.col("source_size") * F.lit(cap)
    fill = Window.orderBy((full / F.col("_w")).asc(), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(1))
    onward = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.sum("source_size").over(whole) * F.lit(share) - F.coalesce(F.sum(full).over(before), F.lit(0.0))
    w = w.withColumn("_level", left / F.sum("_w").over(onward))
    w = w.withColumn("_full", full <= F.col("_level") * F.col("_w"))
    level = F.max(F.when(~F.col("_full"), F.col("_level"))).over(Window.partitionBy(F.lit(1)))
    return w.withColumn("_at", level).select(
        "source", "source_size", F.when(F.col("_full"), full).otherwise(F.col("_at") * F.col("_w")).alias("target")
    )


def mix_sources(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    cap: float = 2.0,
    seed: str = "mix",
) -> DataFrame:
    """``docs`` (doc_id, text, source, ...) with size, source_size, target and ``taken`` (words) added.

    Each document of a source with target t and size s is due t / s copies. The whole part is certain and given to
    every document; p, the rest, is its inclusion probability. Documents are ranked by the odds of a shared uniform
    draw over the odds of p, and the sample is filled in that order up to the words still due; the document at the
    edge gives only the words that are missing, so a source's sum is its target rounded to a word.

    The order is cut into slots by the draw. Slots before the edge are taken whole from per-slot sums, and only
    the edge slot is ranked, so no task ranks a whole source. NULL text has size 0 and takes 0; a NULL source is a
    source of its own; NULL ids draw as empty text; equal ids rank by their text. Existing columns of the added names are replaced.
    """
    made = ("size", "source_size", "target", "taken")
    docs = docs.drop(*made)
    base = docs.withColumn("size", word_count()).withColumn("_u", draw(seed))
    base = base.withColumn("_text", F.xxhash64("text"))
    rows = base.withColumn("_slot", F.floor(F.col("_u") * (1 << SLOTS)).cast("int"))
    by_slot = store(rows.groupBy("source", "_slot").agg(F.sum("size").alias("_in_slot")), "slots")
    sizes = by_slot.groupBy("source").agg(F.sum("_in_slot").alias("source_size"))
    targets = store(source_targets(sizes, weights, share, cap), "targets")
    ratio = F.coalesce(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0))
    targets = targets.withColumn("_copies", F.floor(ratio)).withColumn("_p", ratio - F.floor(ratio))
    targets = targets.withColumn("_due", F.round("target").cast("bigint") - F.col("_copies") * F.col("source_size"))
    run = Window.partitionBy("source").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = by_slot.withColumn("_before", F.coalesce(F.sum("_in_slot").over(run), F.lit(0)))
    edges = (
        slots.join(targets.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
        .where((F.col("_before") <= F.col("_due")) & (F.col("_due") < F.col("_before") + F.col("_in_slot")))
        .select(F.col("_s").alias("_es"), F.col("_slot").alias("_edge"), F.col("_before").alias("_base"))
    )
    plan = targets.withColumnRenamed("source", "_s").join(edges, F.col("_s").eqNullSafe(F.col("_es")), "left")
    at = rows.join(small(store(plan.drop("_es"), "plan")), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")

    odds = (F.col("_u") / (1 - F.col("_u"))) / (F.col("_p") / (1 - F.col("_p")))
    on_edge = F.col("_slot") == F.col("_edge")
    rank = (
        Window.partitionBy("source", "_slot")
        .orderBy("_q", F.col("doc_id").asc_nulls_first(), "_text")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    edge = at.where(on_edge).withColumn("_q", F.when(F.col("_p") > 0, odds)).withColumn(
        "_sofar", F.col("_base") + F.coalesce(F.sum("size").over(rank), F.lit(0))
    )
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_due") - F.col("_sofar")))
    inside = F.when(F.col("_edge").isNull() | (F.col("_slot") < F.col("_edge")), F.least(F.col("size"), F.col("_due"))).otherwise(0)
    sure = F.col("_copies") * F.col("size")
    keep = [F.col(c) for c in docs.columns] + [F.col("size"), F.col("source_size"), F.col("target").cast("double")]
    rest = at.where(F.col("_edge").isNull() | ~on_edge)
    taken = lambda extra: (sure + extra).cast("bigint").alias("taken")
    return rest.select(*keep, taken(inside)).unionByName(edge.select(*keep, taken(part)))
