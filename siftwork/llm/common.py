"""Helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.session import scratch_path

SPACE = " \t\n\x0b\x0c\r"  # fixed: what separates words and is stripped from lines
WORD = r"[^\x20\x09-\x0D]+"  # fixed pattern
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())
PIECE = 1 << 21  # bytes that are hashed at once
BROADCAST_ROWS = 200_000  # tables of more rows are joined by a shuffle


def store(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, keeps column pruning."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A stored table with a broadcast hint where its counted rows allow it."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def body(text: str = "text") -> Column:
    """The text, empty where it is NULL."""
    return F.coalesce(F.col(text), F.lit(""))


def id_remainder(n: int, key: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo n (NULL reads as empty text)."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(n))


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer, so that every input bit reaches every output bit."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    h ^= h >> np.uint64(33)
    return h


_rng = np.random.default_rng(20240229)
BYTE_KEY = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
STEP = 0x5851F42D4C957F2D  # odd, so it has an inverse modulo 2**64
STEP_INVERSE = pow(STEP, -1, 2**64)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACE.encode())] = True


def powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[:1] = 1
    out[1:] = np.uint64(base)
    return np.cumprod(out, dtype=np.uint64)


_POWERS: dict[tuple[int, int], np.ndarray] = {}


def cached_powers(base: int, n: int) -> np.ndarray:
    size = 1 << max(10, (n - 1).bit_length())
    key = (base, size)
    if key not in _POWERS:
        _POWERS[key] = powers(base, size)
    return _POWERS[key][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Sums of keyed bytes times powers of STEP; a substring's hash is a difference times an inverse power."""
    out = np.empty(len(data) + 1, np.uint64)
    out[0] = 0
    np.cumsum(BYTE_KEY[data] * cached_powers(STEP, len(data)), out=out[1:])
    return out


def _word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    space = _IS_SPACE[data]
    edge = np.diff(np.concatenate(([True], space, [True])).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(start):
        return np.empty(0, np.uint64), start
    total = prefix_hash(data)
    h = (total[end] - total[start]) * cached_powers(STEP_INVERSE, len(data) + 1)[start]
    return mix(h + (end - start).astype(np.uint64)), start


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (as bytes.split() finds them) and, for each text, where its words begin (n + 1 offsets).

    Works through at most PIECE bytes at a time, cut at white space, so memory stays near nine bytes a word.
    """
    joined = b"\n".join(texts)
    data = np.frombuffer(joined, np.uint8)
    hashes, starts, at = [], [], 0
    while at < len(data):
        stop = min(len(data), at + PIECE)
        if stop < len(data):
            gap = np.flatnonzero(_IS_SPACE[data[at:stop]])
            while not len(gap) and stop < len(data):
                stop = min(len(data), stop + PIECE)
                gap = np.flatnonzero(_IS_SPACE[data[at:stop]])
            if stop < len(data):
                stop = at + int(gap[-1]) + 1
        h, s = _word_hashes(data[at:stop])
        hashes.append(h)
        starts.append(s + at)
        at = stop
    h = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
    s = np.concatenate(starts) if starts else np.empty(0, np.int64)
    ends = np.cumsum([len(t) + 1 for t in texts]) if texts else np.empty(0, np.int64)
    return h, np.concatenate(([0], np.searchsorted(s, ends, "left"))).astype(np.int64)


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive words at each position; the whole sequence where it is shorter."""
    if not len(words):
        return words
    n = min(n, len(words))
    h = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + words[i : len(words) - n + 1 + i]
    return mix(h + np.uint64(n))


def lower_bytes(text: str | None) -> bytes:
    """UTF-8 with only A-Z lowered."""
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER_BYTES)


def packs(batches, limit: int = 1 << 22) -> Iterator:
    """Arrow batches cut so that the texts of one piece stay near ``limit`` bytes (a longer text comes alone)."""
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column("text").cast("large_binary")), 0)))
        at = 0
        while at < batch.num_rows:
            before = int(size[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(size, before + limit, "right")))
            yield batch.slice(at, to - at)
            at = to
