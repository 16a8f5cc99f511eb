"""Byte-level deduplication: repeated strings of a given length found through a logarithmic family of sorted suffixes."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from siftwork.llm.common import STEP_INVERSE, cached_powers, mix, packs, prefix_hash, store

SEED = 8  # bytes of the seed that decides where a string is compared
UNIT_BYTES = 1 << 22  # text whose strips a task packs together
PART_BYTES = 1 << 20  # text that is hashed at once
BUCKET_BYTES = 1 << 21  # text whose strings meet in one bucket, on average
BATCH = 1 << 18  # suffixes of a batch
NO_ID = np.iinfo(np.int64).max
SPLIT = 1 << 21  # longer texts are cut into overlapping parts


class SuffixFamily:
    """Suffixes of documents in ascending order of id, ordered by their first ``length`` bytes (as 64-bit keys).

    A new batch is sorted, merge-scanned against each level for suffixes that agree over the length with one of a
    smaller document, and what no level holds becomes a level of its own. While the last level is at least half as
    large as the one before it, the two are merged, so n suffixes lie in O(log n) levels and each is merged
    O(log n) times.
    """

    def __init__(self) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, keys: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Add a batch (docs ascending, not below earlier ones); whether each suffix repeats a smaller document's."""
        order = np.argsort(keys)
        k, d = keys[order], docs[order]
        head = _heads(k)
        group = np.cumsum(head) - 1
        key, first = k[head], np.minimum.reduceat(d, np.flatnonzero(head))
        known = np.zeros(len(key), bool)
        for level, owner in self.levels:
            at = np.minimum(np.searchsorted(level, key), len(level) - 1)
            hit = level[at] == key
            first[hit] = np.minimum(first[hit], owner[at[hit]])
            known |= hit
        repeated = np.empty(len(k), bool)
        repeated[order] = d > first[group]
        if not known.all():
            self.levels.append((key[~known], first[~known]))
        while len(self.levels) > 1 and 2 * len(self.levels[-1][0]) >= len(self.levels[-2][0]):
            (a, x), (b, y) = self.levels.pop(), self.levels.pop()
            key, owner = np.concatenate((a, b)), np.concatenate((x, y))
            order = np.argsort(key, kind="stable")
            self.levels.append((key[order], owner[order]))
        return repeated


def _sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    step, m = 1, v
    while 2 * step <= width:
        m = np.minimum(m[:-step], m[step:])
        step *= 2
    return np.minimum(m[: len(m) - (width - step)], m[width - step :]) if width > step else m


def _substring(total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    inverse = cached_powers(STEP_INVERSE, len(total))
    return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))


def strips(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Cut all strings of ``length`` bytes into strips that share their seed: (row, first, last, seed position, total).

    The seed of a string is its SEED bytes with the smallest hash, the leftmost of equals, so equal strings have the
    same seed at the same place. Strings that follow each other and share a seed form a strip, and every string is
    in exactly one strip. first and last are string starts in ``data``.
    """
    total = prefix_hash(data)
    none = np.empty(0, np.int64)
    if len(data) < length:
        return none, none, none, none, total
    at = np.arange(len(data) - SEED + 1)
    gram = _substring(total, at, at + SEED)
    low = np.uint64((1 << 23) - 1)
    best = _sliding_min((gram & ~low) | at.astype(np.uint64), length - SEED + 1)
    row = np.repeat(np.arange(len(starts)), np.maximum(0, ends - starts - length + 1))
    if not len(row):
        return none, none, none, none, total
    counts = np.maximum(0, ends - starts - length + 1)
    first = np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(len(row))
    seed = (best[first] & low).astype(np.int64)
    new = np.ones(len(row), bool)
    new[1:] = (seed[1:] != seed[:-1]) | (row[1:] != row[:-1])
    begin = np.flatnonzero(new)
    last = first[np.append(begin[1:], len(row)) - 1]
    return row[begin], first[begin], last, seed[begin], total


def merged(spans: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that strings cover; a span is the first and last start of strings."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    start, end = spans[:, 0], np.maximum.accumulate(spans[:, 1] + length)
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > end[:-1]
    at = np.flatnonzero(new)
    return start[at], end[np.append(at[1:], len(start)) - 1]


def _heads(v: np.ndarray) -> np.ndarray:
    """Where a value differs from the one before it."""
    head = np.ones(len(v), bool)
    head[1:] = v[1:] != v[:-1]
    return head


def _gather(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of all slices, one after the other."""
    total = int(size.sum())
    at = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(total)
    return data[at]


def _planes(*arrays: np.ndarray) -> bytes:
    """int64 arrays of one length, low bytes together: what is small packs well."""
    return b"".join(a.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes() for a in arrays)


def _from_planes(raw: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(n, 8, -1)
    whole = planes.transpose(0, 2, 1).copy()  # one value a plane is contiguous already, and the buffer is read-only
    return whole.view("<i8").reshape(n, -1)


def _pack_spans(lo: np.ndarray, hi: np.ndarray) -> bytes:
    return zlib.compress(_planes(np.diff(lo, prepend=0), hi - lo), 1)


def _unpack_spans(raw: bytes) -> np.ndarray:
    start, size = _from_planes(zlib.decompress(raw), 2)
    lo = np.cumsum(start)
    return np.stack((lo, lo + size), axis=1)


_ROW = "bucket bigint, doc bigint, nth bigint, spans binary, text binary, meta binary"


def _prepare(length: int, buckets: int):
    """Strips of each unit of text, packed by the bucket of their seed.

    Of equal strips in a unit only those of the smallest document travel; the others are repeats already. A string
    that a third of all documents hold so arrives once from each unit.
    """

    def run(batches) -> Iterator:
        import pyarrow as pa
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=6)
        schema = pa.schema(
            [("bucket", pa.int64()), ("doc", pa.int64()), ("nth", pa.int64()), ("spans", pa.binary()), ("text", pa.binary()), ("meta", pa.binary())]
        )
        for b in packs(batches, UNIT_BYTES):
            ids = np.asarray(b.column("doc_id"))
            nth = np.asarray(b.column("nth"))
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in b.column("text").to_pylist()]
            parts = [(i, at) for i, t in enumerate(texts) for at in range(0, max(1, len(t) - length + 1), SPLIT)]
            for lo, hi in _shares(parts, texts, length):
                chunk = parts[lo:hi]
                pieces = [texts[i][at : at + SPLIT + length - 1] for i, at in chunk]
                at = [i for i, _ in chunk]
                yield from _unit(pieces, ids[at], nth[at], np.array([at for _, at in chunk], np.int64), schema, squeeze)

    def _shares(parts, texts, length):
        at, size = 0, 0
        for j, (i, start) in enumerate(parts):
            n = min(len(texts[i]) - start, SPLIT + length - 1)
            if size and size + n > UNIT_BYTES + SPLIT:
                yield at, j
                at, size = j, 0
            size += n
        yield at, len(parts)

    def _unit(pieces, ids, nth, base, schema, squeeze):
        import pyarrow as pa

        data = np.frombuffer(b"".join(pieces), np.uint8)
        sizes = np.array([len(p) for p in pieces], np.int64)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        made, at = [], 0
        while at < len(pieces):
            to = max(at + 1, int(np.searchsorted(ends, starts[at] + PART_BYTES, "right")))
            low = starts[at]
            row, first, last, seed, total = strips(data[low : ends[to - 1]], starts[at:to] - low, ends[at:to] - low, length)
            if len(row):
                keys = _substring(total, first, last + length), _substring(total, seed, seed + SEED)
                made.append((row + at, first + low, last + low, seed + low, *keys))
            at = to
        if not made:
            return
        row, first, last, seed, whole, seed_key = (np.concatenate(c) for c in zip(*made))
        del made, total
        doc, copy = ids[row], nth[row]
        place = base[row] + first - starts[row]
        order = np.argsort(whole)
        w, d = whole[order], doc[order]
        head = _heads(w)
        least = np.minimum.reduceat(d, np.flatnonzero(head))[np.cumsum(head) - 1]
        repeat = np.empty(len(w), bool)
        repeat[order] = d > least
        bucket = (seed_key % np.uint64(buckets)).astype(np.int64)
        columns = [[], [], [], [], [], []]
        if repeat.any():
            o = np.flatnonzero(repeat)
            o = o[np.lexsort((place[o], copy[o], doc[o]))]
            cut = np.append(np.flatnonzero(_heads(doc[o]) | _heads(copy[o])), len(o))
            lo, hi = place[o], place[o] + last[o] - first[o]
            for a, z in zip(cut[:-1], cut[1:]):
                i, n = int(doc[o[a]]), int(copy[o[a]])
                for c, x in zip(columns, ((i + n) % buckets, i, n, _pack_spans(lo[a:z], hi[a:z]), None, None)):
                    c.append(x)
        o = np.flatnonzero(~repeat)
        o = o[np.lexsort((doc[o], bucket[o]))]
        cut = np.append(np.flatnonzero(_heads(bucket[o])), len(o))
        for a, z in zip(cut[:-1], cut[1:]):
            s = o[a:z]
            size = last[s] - first[s] + length
            meta = _planes(np.diff(doc[s], prepend=0), copy[s], place[s], size, seed[s] - first[s])
            text = squeeze.compress(_gather(data, first[s], size).tobytes())
            for c, x in zip(columns, (int(bucket[s[0]]), None, None, None, text, squeeze.compress(meta))):
                c.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return run


def _match(length: int):
    """The repeated strings of one bucket, and what its units had found themselves."""

    def run(table):
        import pyarrow as pa
        import zstandard

        docs, copies, spans = [], [], []
        loose = zstandard.ZstdDecompressor()
        metas, texts = [], []
        for doc, copy, span, text, meta in zip(*[table.column(c).to_pylist() for c in ("doc", "nth", "spans", "text", "meta")]):
            if meta is None:
                docs.append(doc)
                copies.append(copy)
                spans.append(span)
            else:
                m = _from_planes(loose.decompress(meta), 5)
                m[0] = np.cumsum(m[0])
                metas.append(m)
                texts.append(np.frombuffer(loose.decompress(text), np.uint8))
        if metas:
            found = _in_bucket(np.concatenate(metas, axis=1), np.concatenate(texts), length)
            order = np.lexsort((found[2], found[1], found[0]))
            doc, copy, lo, hi = (x[order] for x in found)
            cut = np.append(np.flatnonzero(_heads(doc) | _heads(copy)), len(doc))
            for a, z in zip(cut[:-1], cut[1:]):
                docs.append(int(doc[a]))
                copies.append(int(copy[a]))
                spans.append(_pack_spans(lo[a:z], hi[a:z]))
        return pa.table({"doc": pa.array(docs, pa.int64()), "nth": pa.array(copies, pa.int64()), "spans": pa.array(spans, pa.binary())})

    return run


def _in_bucket(meta: np.ndarray, data: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(doc, nth, first, last) of repeated strings among strips (doc, nth, place, size, seed offset; one after the other in data)."""
    doc, copy, place, size, offset = meta
    start = np.cumsum(size) - size
    seed, at = np.empty(len(size), np.uint64), 0
    while at < len(size):
        to = max(at + 1, int(np.searchsorted(start, start[at] + PART_BYTES)))
        total = prefix_hash(data[start[at] : start[to - 1] + size[to - 1]])
        here = start[at:to] - start[at] + offset[at:to]
        seed[at:to] = _substring(total, here, here + SEED)
        at = to
    # a seed that one document holds alone cannot match
    order = np.argsort(seed)
    s, d = seed[order], doc[order]
    head = _heads(s)
    group = np.cumsum(head) - 1
    at = np.flatnonzero(head)
    shared = np.minimum.reduceat(d, at) < np.maximum.reduceat(d, at)
    use = np.zeros(len(s), bool)
    use[order] = shared[group]
    use = np.flatnonzero(use)
    use = use[np.argsort(doc[use], kind="stable")]
    family = SuffixFamily()
    out = []
    count = size[use] - length + 1
    upto = np.cumsum(count)
    a = 0
    while a < len(use):
        z = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + BATCH, "right")))
        strip = np.repeat(use[a:z], count[a:z])
        shift = np.arange(len(strip)) - np.repeat(np.cumsum(count[a:z]) - count[a:z], count[a:z])
        begin = np.cumsum(size[use[a:z]]) - size[use[a:z]]
        total = prefix_hash(_gather(data, start[use[a:z]], size[use[a:z]]))
        p = np.repeat(begin, count[a:z]) + shift
        hit = family.add(_substring(total, p, p + length), doc[strip])
        # runs of hits, cut where a strip ends
        left = hit & (np.concatenate(([True], ~hit[:-1])) | (np.diff(strip, prepend=-1) != 0))
        right = hit & (np.concatenate((~hit[1:], [True])) | (np.diff(strip, append=-1) != 0))
        lo, hi = np.flatnonzero(left), np.flatnonzero(right)
        out.append((doc[strip[lo]], copy[strip[lo]], place[strip[lo]] + shift[lo], place[strip[lo]] + shift[hi]))
        a = z
    if not out:
        none = np.empty(0, np.int64)
        return none, none, none, none
    return tuple(np.concatenate(x) for x in zip(*out))


def remove_repeats(docs: DataFrame, length: int = 50) -> DataFrame:
    """``docs`` (doc_id, text, ...) with kept (binary), n_bytes, n_removed and n_spans added.

    Texts are UTF-8 bytes (NULL: none). A byte goes when a string of ``length`` bytes covers it that also starts in a
    document with a smaller doc_id. Strings are judged on the input and never cross documents. Rows with equal ids
    are one document and do not remove each other's bytes; rows without an id are one document after all others.
    Existing columns of the added names are replaced; an empty table gives none.

    Every string belongs to one strip by its seed, and strips are dealt to buckets by seed; a bucket holds about
    BUCKET_BYTES of text at any size of the input. Within a bucket the strings of documents in ascending order are
    added batch by batch to a SuffixFamily. Equal strips meet before they are dealt, so frequent text costs one strip
    a unit of input. Keys are 64 bits and only strings of one bucket are compared.
    """
    made = ("kept", "n_bytes", "n_removed", "n_spans")
    docs = docs.drop(*made)
    d = docs.withColumn("_id", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(int(NO_ID))))
    if d.groupBy("_id").count().where("count > 1").isEmpty():
        d = d.withColumn("_nth", F.lit(0).cast("bigint"))
    else:
        d = store(d.withColumn("_nth", F.monotonically_increasing_id()), "numbered")  # read back, so a retry sees the same numbers
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-total // BUCKET_BYTES))
    narrow = d.select(F.col("_id").alias("doc_id"), F.col("_nth").alias("nth"), F.col("text").cast("string"))
    packed = narrow.mapInArrow(_prepare(length, buckets), _ROW)
    found = packed.groupBy("bucket").applyInArrow(_match(length), "doc bigint, nth bigint, spans binary")
    spans = found.groupBy(F.col("doc").alias("_id"), F.col("nth").alias("_nth")).agg(F.collect_list("spans").alias("_spans"))
    small = StructType([*[f for f in d.schema if f.name != "text"], StructField("_packed", BinaryType())])
    both = d.mapInArrow(_squeezed(small.names), small).join(spans, ["_id", "_nth"], "left")
    names = [*docs.columns, *made]

    def cut(batches) -> Iterator:
        import pyarrow as pa
        import zstandard

        loose = zstandard.ZstdDecompressor()
        for b in batches:
            rows, texts = [], []
            for packed, found_here in zip(*[b.column(c).to_pylist() for c in ("_packed", "_spans")]):
                raw = b"" if packed is None else loose.decompress(packed)
                texts.append(None if packed is None else raw)
                if not found_here:
                    rows.append((raw, len(raw), 0, 0))
                    continue
                start, end = merged(np.concatenate([_unpack_spans(x) for x in found_here]), length)
                kept = b"".join(raw[a:b] for a, b in zip([0, *end.tolist()], [*start.tolist(), len(raw)]))
                rows.append((kept, len(raw), int((end - start).sum()), len(start)))
            if rows:
                held = {"text": pa.array(texts, pa.binary()).view(pa.string())}
                held |= dict(zip(made, (pa.array(list(c), t) for c, t in zip(zip(*rows), (pa.binary(), pa.int64(), pa.int64(), pa.int64())))))
                yield pa.RecordBatch.from_arrays([held[c] if c in held else b.column(c) for c in names], names=names)

    schema = StructType(list(docs.schema))
    for name in made:
        schema = schema.add(name, BinaryType() if name == "kept" else LongType())
    return both.mapInArrow(cut, schema)


def _squeezed(names: list[str]):
    """Rows with their texts packed, so that the join with the spans moves less."""

    def run(batches) -> Iterator:
        import pyarrow as pa
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=3)
        for b in batches:
            texts = b.column("text").cast(pa.binary()).to_pylist()
            packed = pa.array([None if t is None else squeeze.compress(t) for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([packed if c == "_packed" else b.column(c) for c in names], names=names)

    return run
