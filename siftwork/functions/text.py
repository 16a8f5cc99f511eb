"""Text expressions: normal form, words, n-gram hashes and cheap flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NOT_WORD = r"[^\p{L}\p{N}]+"  # fixed pattern


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row.

    Inside a higher-order function the optimizer may inline an expensive column
    into the lambda and evaluate it for every element; a lambda variable is safe.
    """
    return F.get(F.transform(F.array(value), body), 0)


def has_word(text) -> Column:
    return _c(text).rlike(r"[\p{L}\p{N}]")


def normal_form(text) -> Column:
    """Lower case without white space and punctuation."""
    return F.regexp_replace(F.lower(_c(text)), NOT_WORD, "")


def words(text) -> Column:
    return F.filter(F.split(F.lower(_c(text)), NOT_WORD), lambda w: w != "")


def ngram_hashes(word_array, n: int) -> Column:
    """Distinct hashes of word n-grams; a shorter text is one gram."""

    def grams(w: Column) -> Column:
        last = F.greatest(F.size(w) - n, F.lit(0))
        return F.array_distinct(F.transform(F.sequence(F.lit(1), last + 1), lambda i: F.xxhash64(F.slice(w, i, n))))

    return bind(F.transform(_c(word_array), lambda w: F.xxhash64(w)), grams)


def jaccard(a, b) -> Column:
    inter = F.size(F.array_intersect(_c(a), _c(b)))
    union = F.size(_c(a)) + F.size(_c(b)) - inter
    return F.when(union == 0, F.lit(1.0)).otherwise(inter / F.nullif(union, F.lit(0)))


def flag(condition: Column) -> Column:
    return F.when(condition, 1.0).otherwise(0.0)


def text_stats(instruction="instruction", response="response", language_prefix: int | None = None) -> dict[str, Column]:
    """The model-free slots of the difficulty vector, by name.

    The language rule reads the whole text, or its first ``language_prefix`` characters.
    """
    i, r = _c(instruction), _c(response)
    li, lr = F.length(i), F.length(r)
    low = F.lower(r)
    head = F.concat(i, F.lit(" "), r)
    head = F.substring(head, 1, language_prefix) if language_prefix else head
    cjk = head.rlike(r"[一-鿿]")
    ascii_only = head.rlike(r"\A[\x00-\x7F]*\z")
    return {
        "len_instr": F.log1p(li),
        "len_resp": F.log1p(lr),
        "len_total": F.log1p(li + lr),
        "ratio": lr / F.greatest(li, F.lit(1)),
        "has_steps": flag(low.contains("step") | low.contains("let's think")),
        "has_code": flag(r.contains("```") | r.contains("def ")),
        "has_question": flag(i.contains("?")),
        "lang_en": flag(~cjk & ascii_only),
        "lang_zh": flag(cjk),
    }


# slot order of the 16-d difficulty vector
DIFFICULTY_SLOTS = (
    "len_instr len_resp len_total ratio "
    "loss_mean loss_std loss_max ppl avg_logprob entropy_mean entropy_max "
    "has_steps has_code has_question lang_en lang_zh"
).split()


def difficulty_vector() -> Column:
    return F.array(*[F.coalesce(F.col(s).cast("double"), F.lit(0.0)) for s in DIFFICULTY_SLOTS])
