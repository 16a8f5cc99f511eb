"""Queries of the trained models: quality rules and language-model scores."""

from __future__ import annotations

from siftwork.llm.common import id_remainder, table
from siftwork.llm.context_tree import score_texts
from siftwork.llm.language_id import fit_languages, identify
from siftwork.llm.quality import fit_rules, labelled_rows, score_quality
from siftwork.llm.queries import query


@query("op7_quality_rules")
def op7_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = fit_rules(labelled_rows(docs, table(spark, sf_dir, "labels")))
    scored = score_quality(docs, model)
    return scored.select("doc_id", (id_remainder(5) == 0).alias("held_out"), "score", "predicted")


@query("op1_context_tree")
def op1_context_tree(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = id_remainder(5) == 1
    out = score_texts(docs, docs.where(~held_out))
    columns = ["n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"]
    return out.select("doc_id", held_out.alias("held_out"), *columns)


@query("op12_language_id")
def op12_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = id_remainder(5) == 0
    out = identify(docs.select("doc_id", "text"), fit_languages(docs.where(~held_out)))
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
