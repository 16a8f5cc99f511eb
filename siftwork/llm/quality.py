"""Quality classifier: tree paths become conjunctive rules, a lasso weighs them, the rules are Spark columns."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.llm.common import body, store

FIT_ROWS = 20_000  # bound of the labelled sample that the trees and the lasso see

STATS = (
    "n_chars n_words word_len upper symbols pipes bangs digits distinct_words line_len distinct_lines long_words"
).split()


def _left(pattern: str) -> Column:
    """Code points of the text that the pattern leaves standing."""
    return F.length(F.regexp_replace("_body", pattern, ""))


def text_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with one column ``_s_<name>`` for each of STATS; shares are of all code points, 0 for empty texts."""
    d = docs.withColumn("_body", body(text))
    d = d.withColumn("_words", F.filter(F.split("_body", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    d = d.withColumn("_lines", F.split("_body", "\n", -1))
    n, w = F.greatest(F.length("_body"), F.lit(1)).cast("double"), F.greatest(F.size("_words"), F.lit(1)).cast("double")
    values = {
        "n_chars": F.log1p(F.length("_body")),
        "n_words": F.log1p(F.size("_words")),
        "word_len": F.length("_body") / w,
        "upper": _left(r"[^\p{Lu}]+") / n,
        "symbols": _left(r"[\p{L}\p{N}\s]+") / n,
        "pipes": (F.length("_body") - F.length(F.replace("_body", F.lit("|")))) / n,
        "bangs": (F.length("_body") - F.length(F.replace("_body", F.lit("!")))) / n,
        "digits": _left(r"[^\p{N}]+") / n,
        "distinct_words": F.size(F.array_distinct("_words")) / w,
        "line_len": F.log1p(n / F.greatest(F.size("_lines"), F.lit(1))),
        "distinct_lines": F.size(F.array_distinct("_lines")) / F.greatest(F.size("_lines"), F.lit(1)),
        "long_words": F.size(F.filter("_words", lambda x: F.length(x) >= 12)) / w,
    }
    return d.select(*docs.columns, *[values[s].cast("double").alias(f"_s_{s}") for s in STATS])


@dataclass(frozen=True)
class Rule:
    """Bounds low < statistic <= high, all of which must hold."""

    bounds: tuple[tuple[int, float, float], ...]

    def column(self) -> Column:
        tests = [
            test
            for i, low, high in self.bounds
            for test in (
                [F.col(f"_s_{STATS[i]}") > low] * (low > float("-inf")) + [F.col(f"_s_{STATS[i]}") <= high] * (high < float("inf"))
            )
        ]
        return F.when(reduce(lambda a, b: a & b, tests), 1.0).otherwise(0.0)


@dataclass(frozen=True)
class RuleEnsemble:
    rules: tuple[Rule, ...]
    weights: tuple[float, ...]
    intercept: float

    def score(self) -> Column:
        margin = reduce(lambda a, b: a + b, [r.column() * w for r, w in zip(self.rules, self.weights, strict=True)], F.lit(self.intercept))
        return 1.0 / (1.0 + F.exp(-margin))


def _paths(node, bounds: dict, out: set) -> None:
    """Every node below the root is a rule: the conditions on the way to it, joined by statistic."""
    if bounds:
        out.add(Rule(tuple(sorted((i, lo, hi) for i, (lo, hi) in bounds.items()))))
    if node.getClass().getSimpleName() == "LeafNode":
        return
    i, cut = node.split().featureIndex(), float(node.split().threshold())
    lo, hi = bounds.get(i, (float("-inf"), float("inf")))
    _paths(node.leftChild(), bounds | {i: (lo, min(hi, cut))}, out)
    _paths(node.rightChild(), bounds | {i: (max(lo, cut), hi)}, out)


def fit_rules(
    labelled: DataFrame,
    label: str = "quality",
    trees: int = 12,
    depth: int = 3,
    lasso: float = 0.0005,
    rows: int = FIT_ROWS,
    seed: int = 7,
) -> RuleEnsemble:
    """Fit on at most ``rows`` rows of ``labelled`` (doc_id, text, label), taken in the order of a hash of the id.

    Only rules with a weight are kept. With no labelled row every score is 0.5; with one class only, its smoothed share.
    """
    # the bound is taken over narrow rows, before any text is read
    chosen = labelled.where(F.col(label).isNotNull()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    data = text_statistics(chosen).select(F.col(label).cast("double").alias("label"), *[f"_s_{s}" for s in STATS])
    data = store(data, "quality-fit")
    n, ones = data.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if ones in (0.0, float(n)):
        share = (ones + 0.5) / (n + 1.0)
        return RuleEnsemble((), (), float(__import__("math").log(share / (1 - share))))
    stats = data.select("label", array_to_vector(F.array(*[F.col(f"_s_{s}") for s in STATS])).alias("features"))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="onethird", minInstancesPerNode=5)
    found: set[Rule] = set()
    for tree in forest.fit(stats).trees:
        _paths(tree._call_java("rootNode"), {}, found)
    rules = sorted(found, key=lambda r: r.bounds)
    hits = data.select("label", array_to_vector(F.array(*[r.column() for r in rules])).alias("features"))
    model = LogisticRegression(elasticNetParam=1.0, regParam=lasso, standardization=False, maxIter=60).fit(store(hits, "quality-rules"))
    kept = [(r, float(w)) for r, w in zip(rules, model.coefficients.toArray(), strict=True) if abs(w) > 1e-6]
    return RuleEnsemble(tuple(r for r, _ in kept), tuple(w for _, w in kept), float(model.intercept))


def score_quality(docs: DataFrame, model: RuleEnsemble, threshold: float = 0.3) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted``; existing columns of these names are replaced.

    NULL and empty texts have statistics 0 and get a score; rows with equal ids are scored apart.
    """
    docs = docs.drop("score", "predicted")
    scored = text_statistics(docs).select(*docs.columns, model.score().alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = FIT_ROWS) -> DataFrame:
    """Texts of at most ``rows`` labelled documents whose crc32(doc_id) mod 5 is not 0."""
    from siftwork.llm.common import id_remainder

    some = labels.where((id_remainder(5) != 0) & F.col(label).isNotNull()).select("doc_id", label)
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id", label).limit(rows)
    return docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")
