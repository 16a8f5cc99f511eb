"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams, trained by
follow-the-regularised-leader with elastic-net penalties, calibrated by a temperature."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.llm.common import store

BITS = 16  # n-grams are hashed to 2^BITS features; one more is constant
SIZE = 1 << BITS
ROWS_PER_LANGUAGE = 2_000  # expected rows of a language in the fit, documented bound
SHARDS = 16  # parts of the sample that train side by side
BLOCK = 4_096  # features of a block that are averaged together
PIECE = 1 << 20  # characters that are hashed at once
HELD_BACK = 5  # one row in so many is kept for the temperature
UND = "und"  # fixed: the answer for texts without letters

_TABLES: list[np.ndarray] = []


def _lowered() -> np.ndarray:
    """For each code point its lower-case letter, or 0 where it is no letter."""
    if not _TABLES:
        table = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            if chr(c).isalpha():
                table[c] = ord(chr(c).lower()[0])
        _TABLES.append(table)
    return _TABLES[0]


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed 1-, 2- and 3-grams of a text and their counts; runs of other characters than letters read as one blank.

    Empty for NULL and for texts without a letter. Works through PIECE characters at a time.
    """
    table = _lowered()
    total, tail, some, few = None, np.zeros(1, np.uint32), False, not text or len(text) <= PIECE
    for at in range(0, len(text or ""), PIECE):
        piece = text[at : at + PIECE].encode("utf-32-le", "surrogatepass")
        c = table[np.minimum(np.frombuffer(piece, np.uint32), 0x10FFFF)]
        some = some or bool(c.any())
        c = np.concatenate((tail, c, np.zeros(int(at + PIECE >= len(text)), np.uint32)))
        kept = np.ones(len(c), bool)
        kept[1:] = (c[1:] != 0) | (c[:-1] != 0)
        c = c[kept]
        seen = min(len(tail), len(c))
        h = [c * np.uint32(0x9E3779B1)]
        h.append(h[0][:-1] * np.uint32(0x85EBCA6B) + c[1:] * np.uint32(0xC2B2AE35) + np.uint32(1))
        h.append(h[1][:-1] * np.uint32(0x27D4EB2F) + c[2:] * np.uint32(0x165667B1) + np.uint32(2))
        # n-grams that lie wholly in what the piece before brought along are counted already
        new = [x[max(0, seen - n) :] for n, x in enumerate(h)]
        slots = np.concatenate([((x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(32 - BITS)).astype(np.uint16) for x in new])
        tail = c[-2:]
        if few:
            slots.sort(kind="stable")
            total = slots
        else:
            total = np.bincount(slots, minlength=SIZE) + (0 if total is None else total)
    if not some:
        return np.empty(0, np.uint16), np.empty(0, np.int64)
    if few:
        head = np.flatnonzero(np.concatenate(([True], total[1:] != total[:-1])))
        return total[head], np.diff(np.append(head, len(total)))
    at = np.flatnonzero(total)
    return at.astype(np.uint16), total[at]


def vector(text: str | None, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """TF-IDF vector of unit length and the constant feature; None for texts without letters."""
    at, count = grams(text)
    if not len(at):
        return None
    x = (1.0 + np.log(count)) * idf[at]
    size = np.sqrt(x @ x)
    x = x / size if size else x
    return np.append(at.astype(np.int64), SIZE), np.append(x, 1.0)


@dataclass(frozen=True)
class LanguageModel:
    """Learned languages, weights (features x languages, most of them 0) and the factor on the margins (1 / temperature)."""

    languages: tuple[str, ...]
    idf: np.ndarray
    weights: np.ndarray
    sharpness: float = 1.0

    def margins(self, text: str | None) -> np.ndarray | None:
        v = vector(text, self.idf)
        return None if v is None else v[1] @ self.weights[v[0]]

    def predict(self, text: str | None) -> tuple[str, float]:
        m = self.margins(text) if self.languages else None
        if m is None:
            return UND, 0.0
        e = np.exp(self.sharpness * (m - m.max()))
        best = int(np.argmax(m))
        return self.languages[best], float(e[best] / e.sum())


@dataclass(frozen=True)
class Leader:
    """Follow-the-regularised-leader: per feature and language the sum z of shifted gradients and n of squared ones."""

    rate: float = 0.5
    smooth: float = 1.0
    l1: float = 0.05
    l2: float = 0.1

    def weights(self, z: np.ndarray, n: np.ndarray) -> np.ndarray:
        w = (np.sign(z) * self.l1 - z) / ((self.smooth + np.sqrt(n)) / self.rate + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def step(self, z: np.ndarray, n: np.ndarray, at: np.ndarray, x: np.ndarray, label: int) -> None:
        """One row: its gradient moves z and n in place."""
        za, na = z[at], n[at]
        w = self.weights(za, na)
        m = x @ w
        p = np.exp(m - m.max())
        p /= p.sum()
        p[label] -= 1.0
        g = x[:, None] * p
        z[at] = za + g - (np.sqrt(na + g * g) - np.sqrt(na)) / self.rate * w
        n[at] = na + g * g


def _document_counts(batches) -> Iterator:
    import pyarrow as pa

    counts = np.zeros(SIZE + 1, np.int64)
    for b in batches:
        for text in b.column("text").to_pylist():
            at, _ = grams(text)
            counts[at] += 1
            counts[SIZE] += bool(len(at))
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["feature", "docs"])


def _vectors(idf, label_of):
    def run(batches) -> Iterator:
        import pyarrow as pa

        for b in batches:
            rows = []
            for text, lang, h in zip(*[b.column(c).to_pylist() for c in ("text", "lang", "h")]):
                v = vector(text, idf.value)
                if v is not None:
                    rows.append((h % SHARDS, h, label_of[lang], v[0].astype("<i4").tobytes(), v[1].astype("<f4").tobytes()))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            columns = zip(*rows) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=["shard", "h", "label", "at", "x"])

    return run


def _row(at: bytes, x: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(at, "<i4").astype(np.int64), np.frombuffer(x, "<f4").astype(np.float64)


def _pass(state, leader: Leader, k: int):
    """One shard's pass over its rows from the common state; (block, shard, state of the block)."""

    def run(table):
        import pyarrow as pa

        z, n = (a.copy() for a in state.value)
        rows = sorted(zip(*[table.column(c).to_pylist() for c in ("h", "label", "at", "x")]))
        for _, label, at, x in rows:
            leader.step(z, n, *_row(at, x), label)
        out = []
        for i, a in enumerate(range(0, SIZE + 1, BLOCK)):
            out.append((i, table.column("shard")[0].as_py(), np.stack((z[a : a + BLOCK], n[a : a + BLOCK])).tobytes()))
        return pa.table({c: pa.array(list(x), t) for c, x, t in zip(("block", "shard", "state"), zip(*out), (pa.int64(), pa.int64(), pa.binary()))})

    return run


def _mean(table):
    """The shards' states of one block, averaged in the order of the shards."""
    import pyarrow as pa

    rows = sorted(zip(table.column("shard").to_pylist(), table.column("state").to_pylist()))
    total = sum(np.frombuffer(s) for _, s in rows) / len(rows)
    return pa.table({"block": pa.array([table.column("block")[0].as_py()], pa.int64()), "state": pa.array([total.tobytes()], pa.binary())})


def _losses(model, factors):
    """Summed negative log-likelihoods of the rows under each factor, in millionths."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        total = np.zeros(len(factors), np.int64)
        for b in batches:
            for label, at, x in zip(*[b.column(c).to_pylist() for c in ("label", "at", "x")]):
                i, v = _row(at, x)
                m = np.outer(factors, v @ model.value.weights[i])
                m -= m.max(axis=1, keepdims=True)
                total += np.round(1e6 * (np.log(np.exp(m).sum(axis=1)) - m[:, label])).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(factors))), pa.array(total)], names=["i", "loss"])

    return run


def _best_factor(rows: DataFrame, model) -> float:
    """The factor on the margins with the least loss on the held-back rows: a coarse grid, then a fine one around its best."""
    low, high = -4.0, 4.0
    best = 0.0
    for _ in range(2):
        grid = np.linspace(low, high, 33)
        losses = rows.mapInArrow(_losses(model, np.exp2(grid)), "i bigint, loss bigint").groupBy("i").agg(F.sum("loss").alias("loss"))
        found = sorted((r.loss, r.i) for r in losses.collect())
        if not found or not found[0][0] and found[0][0] == found[-1][0]:
            return 1.0
        best = float(grid[found[0][1]])
        low, high = max(-4.0, best - 0.25), min(4.0, best + 0.25)
    return float(2.0**best)


def fit_languages(
    labelled: DataFrame,
    text: str = "text",
    lang: str = "lang",
    key: str = "doc_id",
    rows_per_language: int = ROWS_PER_LANGUAGE,
    passes: int = 4,
    leader: Leader | None = None,
) -> LanguageModel:
    """Learn the languages of ``labelled`` (rows with a NULL language count nothing).

    Document frequencies come from all rows. Weights and temperature come from a sample of about
    ``rows_per_language`` rows a language (a row is in by a hash of ``key`` and text; a smaller language is in whole), one in HELD_BACK of which only serves the temperature. In each of ``passes``
    rounds, SHARDS tasks run follow-the-regularised-leader over their rows from the common state, and the states are
    averaged, block by block of features. Without labelled rows the model knows no language and answers ``und``;
    with one language every text with letters is that language with score 1.
    """
    leader = leader or Leader()
    spark = labelled.sparkSession
    rows = labelled.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"), F.xxhash64(key, text).alias("h"))
    rows = rows.where("lang IS NOT NULL")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = tuple(sorted(sizes, key=lambda s: s.encode()))
    if not languages:
        return LanguageModel((), np.zeros(SIZE), np.zeros((SIZE + 1, 0)))
    found = rows.select("text").mapInArrow(_document_counts, "feature bigint, docs bigint").groupBy("feature").agg(F.sum("docs").alias("docs"))
    docs = np.zeros(SIZE + 1)
    for r in found.collect():
        docs[r.feature] = r.docs
    idf = np.log((1.0 + docs[SIZE]) / (1.0 + docs[:SIZE])) + 1.0

    share = F.create_map(*[F.lit(x) for s, n in sizes.items() for x in (s, min(1.0, rows_per_language / n))])
    sample = rows.where(F.pmod(F.shiftright("h", 20), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))
    idf_ = spark.sparkContext.broadcast(idf)
    label_of = {s: i for i, s in enumerate(languages)}
    sample = sample.mapInArrow(_vectors(idf_, label_of), "shard bigint, h bigint, label bigint, at binary, x binary")
    sample = store(sample, "language-sample")
    held = F.pmod(F.shiftright("h", 8), F.lit(HELD_BACK)) == 0
    fit = sample.where(~held)
    shape = (SIZE + 1, len(languages))
    z, n = np.zeros(shape), np.zeros(shape)
    for _ in range(passes):
        state = spark.sparkContext.broadcast((z, n))
        moved = fit.groupBy("shard").applyInArrow(_pass(state, leader, len(languages)), "block bigint, shard bigint, state binary")
        moved = moved.groupBy("block").applyInArrow(_mean, "block bigint, state binary").collect()
        for r in moved:
            part = np.frombuffer(r.state).reshape(2, -1, len(languages))
            a = r.block * BLOCK
            z[a : a + part.shape[1]], n[a : a + part.shape[1]] = part
        state.destroy()
    model = LanguageModel(languages, idf, leader.weights(z, n))
    shared = spark.sparkContext.broadcast(model)
    return replace(model, sharpness=_best_factor(sample.where(held), shared))


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score (0 to 1) added; existing columns of these names are replaced.

    NULL texts and texts without a letter are ``und`` with score 0. Equal margins go to the bytewise smaller
    language. Whole texts are read; rows with equal ids are judged apart; an empty table gives no rows.
    """
    from pyspark.sql.types import DoubleType, StringType, StructType

    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType(list(docs.schema)).add("lang_pred", StringType()).add("score", DoubleType())

    def run(batches) -> Iterator:
        import pyarrow as pa

        for b in batches:
            found = [shared.value.predict(t) for t in b.column(text).to_pylist()]
            made = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*b.columns, *made], names=schema.names)

    return docs.mapInArrow(run, schema)
