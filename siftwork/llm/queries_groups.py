"""Queries that relate documents to each other."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwork.llm.common import table
from siftwork.llm.decontamination import find_items
from siftwork.llm.near_dedup import near_duplicates
from siftwork.llm.passages import repeated_passages
from siftwork.llm.queries import query
from siftwork.llm.suffix_dedup import remove_repeats


@query("op3_near_dedup")
def op3_near_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


@query("op9_decontamination")
def op9_decontamination(spark, sf_dir):
    return find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op5_suffix_dedup")
def op5_suffix_dedup(spark, sf_dir):
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


@query("op6_fuzzy_passages")
def op6_fuzzy_passages(spark, sf_dir):
    return repeated_passages(table(spark, sf_dir, "documents"))
