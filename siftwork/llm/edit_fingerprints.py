"""Document fingerprints by a randomised edit embedding: shared random walks map edit distance to Hamming distance."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.llm.common import mix, packs, store

PIECE = 256  # code points of one walk; every piece of a text walks with the same random bits
BITS = 256  # sampled steps, one fingerprint bit each
GRAM = 5  # code points that make the symbol at a position
WALKS = 8192  # pieces that walk at once
_rng = np.random.default_rng(8)
_MOVE = _rng.integers(0, 2**63, 3 * PIECE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SIGN = _rng.integers(0, 2**63, 3 * PIECE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SAMPLED = np.sort(_rng.choice(2 * PIECE, BITS, replace=False))  # a walk ends after about 2 * PIECE steps


def _symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the GRAM code points from each position on, and where each text begins and ends."""
    codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    sizes = np.array([len(c) for c in codes], np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes + GRAM)))[:-1]
    flat = np.zeros(int(sizes.sum()) + GRAM * (len(texts) + 1), np.uint64)
    for s, c in zip(starts, codes):
        flat[s : s + len(c)] = c
    h = np.zeros(len(flat) - GRAM + 1, np.uint64)
    for i in range(GRAM):
        h = h * np.uint64(0x9E3779B97F4A7C15) + flat[i : len(flat) - GRAM + 1 + i]
    return mix(h), starts, starts + sizes


def embed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bits, used), each len(texts) x BITS: the fingerprint and which of its bits any walk reached.

    A walk stands at a code point, emits its symbol, and a random function of step and symbol, the same for all
    texts, decides whether it moves on. Walks of similar pieces fall into step again after an edit, so most emitted
    symbols agree. A piece votes on bit b with the sign of the symbol at sampled step b; the votes of all pieces are
    summed. Pieces have a fixed length: a text that grew by a few code points moves few of them over each border.
    """
    symbol, start, end = _symbols(texts)
    votes = np.zeros((BITS, len(texts)), np.int32)
    used = np.zeros((BITS, len(texts)), bool)
    pieces = -(-(end - start) // PIECE)
    owner = np.repeat(np.arange(len(texts)), pieces)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    for at in range(0, len(owner), WALKS):
        doc = owner[at : at + WALKS]
        here = start[doc] + nth[at : at + WALKS] * PIECE
        stop = np.minimum(here + PIECE, end[doc])
        seen = np.zeros((BITS, len(doc)), np.int8)
        column = 0
        for step in range(int(_SAMPLED[-1]) + 1):
            walking = here < stop
            s = symbol[here]
            if column < BITS and _SAMPLED[column] == step:
                up = ((s * _SIGN[step]) >> np.uint64(63)).astype(np.int8)
                seen[column] = (2 * up - 1) * walking
                column += 1
                if not walking.any():
                    break
            here += ((s * _MOVE[step]) >> np.uint64(63)).astype(np.int64) * walking
        first = np.flatnonzero(np.diff(doc, prepend=-1))
        ids = doc[first]
        votes[:, ids] += np.add.reduceat(seen, first, axis=1, dtype=np.int32)
        used[:, ids] |= np.add.reduceat(seen != 0, first, axis=1, dtype=np.int32) > 0
    return (votes > 0).T, used.T


def as_text(bits: np.ndarray, used: np.ndarray) -> list[str]:
    return [a.tobytes().hex() + b.tobytes().hex() for a, b in zip(np.packbits(bits, axis=1), np.packbits(used, axis=1))]


def likeness(bits: np.ndarray, used: np.ndarray, other: np.ndarray, other_used: np.ndarray) -> np.ndarray:
    """0 (as unlike as chance) to 1 over the bits that either side used; two empty texts are alike."""
    either = (used | other_used).sum(axis=1)
    same = ((bits == other) & used & other_used).sum(axis=1)
    share = np.maximum(0.0, 2.0 * same / np.maximum(either, 1) - 1.0)
    return np.where(either == 0, 1.0, share)


def edited(text: str, following: str) -> str:
    """The last half of ``text`` replaced by as many first code points of ``following``, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_RESULT = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def _rows(ids: list, texts: list[str], following: list[str]) -> list[list]:
    both = [edited(t, f) for t, f in zip(texts, following)]
    b, u = embed(texts)
    eb, eu = embed(both)
    nb, nu = embed(following)
    shas = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in both]
    near = likeness(b, u, eb, eu).tolist(), likeness(b, u, nb, nu).tolist()
    return [ids, [len(t) for t in texts], shas, as_text(b, u), as_text(eb, eu), *near]


def edit_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every row of ``docs`` (doc_id, text) and of its edited text, and likeness to it and the next row.

    The next row is the one that follows by doc_id (ids that are NULL last, then by a hash of the text); the first
    one follows the last, and a single row follows itself. NULL text is empty. Rows with equal ids each have a row.
    Other columns are not read; an empty table gives no rows.

    Rows are range-partitioned and sorted by id, so a task knows the next row of all but its last one. First and
    last rows of tasks are paired afterwards: two rows a task.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    spark = docs.sparkSession
    schema = _RESULT + ", edge int, text string"
    arrow = to_arrow_schema(_parse_datatype_string(schema))
    names = arrow.names

    def batch(columns: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], names=names)

    def edge(doc_id, text: str, side: int) -> pa.RecordBatch:
        return batch([[doc_id], *[[None]] * 6, [side], [text]])

    def walk(batches) -> Iterator:
        held = None
        for b in packs(batches, 1 << 21):
            ids, texts = b.column("doc_id").to_pylist(), [t or "" for t in b.column("text").to_pylist()]
            if held is None:
                yield edge(ids[0], texts[0], 0)
            else:
                ids, texts = [held[0], *ids], [held[1], *texts]
            held = ids[-1], texts[-1]
            if len(ids) > 1:
                done = _rows(ids[:-1], texts[:-1], texts[1:])
                yield batch([*done, [None] * (len(ids) - 1), [None] * (len(ids) - 1)])
        if held is not None:
            yield edge(*held, 1)

    def pair(batches) -> Iterator:
        for b in batches:
            if b.num_rows:
                cols = {n: b.column(n).to_pylist() for n in ("doc_id", "text", "following")}
                done = _rows(cols["doc_id"], cols["text"], cols["following"])
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(done, arrow)], names=names[:7])

    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
    ranged = narrow.repartitionByRange(*order).sortWithinPartitions(*order)
    # the sort column of the plan is dropped again before rows go to Python
    made = store(ranged.select("doc_id", "text").mapInArrow(walk, schema), "fingerprints")

    edges = made.where("edge IS NOT NULL").select("doc_id", "text", "edge")
    if edges.isEmpty():
        return spark.createDataFrame([], _RESULT)
    at = [F.col("doc_id").isNull(), F.col("doc_id"), F.xxhash64("text"), F.col("edge")]
    first = edges.agg(F.min_by("text", F.struct(*at)).alias("t")).first()[0]
    from pyspark.sql import Window

    follow = F.lead("text").over(Window.orderBy(*at))  # two rows a task
    last = edges.withColumn("following", F.coalesce(follow, F.lit(first))).where("edge = 1")
    ends = last.select("doc_id", "text", "following").mapInArrow(pair, _RESULT)
    return made.where("edge IS NULL").select(*names[:7]).unionByName(ends)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) for every row of ``docs`` (doc_id, text); NULL text is empty."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        for b in packs(batches, 1 << 21):
            prints = as_text(*embed([t or "" for t in b.column("text").to_pylist()]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(prints)], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, fingerprint string")


def fingerprint_likeness(a: str, b: str) -> Column:
    """The likeness of two fingerprint columns as an expression."""
    width = BITS // 4

    def part(x: str, at: int) -> list[Column]:
        return [F.conv(F.substring(x, at + 1 + 16 * i, 16), 16, -10).cast("bigint") for i in range(width // 16)]

    bits, used = list(zip(part(a, 0), part(b, 0))), list(zip(part(a, width), part(b, width)))
    either = sum((F.bit_count(u.bitwiseOR(v)) for u, v in used), F.lit(0))
    same = sum((F.bit_count(F.bitwise_not(x.bitwiseXOR(y)).bitwiseAND(u).bitwiseAND(v)) for (x, y), (u, v) in zip(bits, used)), F.lit(0))
    return F.when(either == 0, 1.0).otherwise(F.greatest(F.lit(0.0), 2.0 * same / F.nullif(either, F.lit(0)) - 1.0))


def similar_documents(docs: DataFrame, least: float = 0.8, bands: int = 32, bits: int = 12, seed: int = 3) -> DataFrame:
    """(a, b, likeness): each document with the smallest doc_id of every band bucket it is in, verified.

    A band is ``bits`` sampled bits of the fingerprint. Buckets tie their rows to their first row only, so a group
    of n copies makes n pairs; documents without a similar one have no row.
    """
    prints = store(fingerprints(docs).where("doc_id IS NOT NULL"), "prints")
    rng = np.random.default_rng(seed)
    nibbles = [sorted(rng.choice(BITS // 4, bits // 4, replace=False).tolist()) for _ in range(bands)]
    keys = F.array(*[F.xxhash64(F.lit(i), *[F.substring("fingerprint", c + 1, 1) for c in n]) for i, n in enumerate(nibbles)])
    rows = prints.select("doc_id", F.explode(keys).alias("key"))
    first = rows.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).where("a < z").select("key", "a")
    pairs = rows.join(store(first, "bands"), "key").where("doc_id > a").select("a", F.col("doc_id").alias("b")).distinct()
    left = prints.select(F.col("doc_id").alias("a"), F.col("fingerprint").alias("x"))
    right = prints.select(F.col("doc_id").alias("b"), F.col("fingerprint").alias("y"))
    scored = pairs.join(left, "a").join(right, "b").withColumn("likeness", fingerprint_likeness("x", "y"))
    return scored.where(F.col("likeness") >= least).select("a", "b", "likeness")
