"""Log-probabilities and entropies of an add-k bigram model, summed per row, from packed chunks of word hashes.

Rows are read in chunks of about CHUNK bigrams. A chunk keeps its distinct bigrams once, ordered by the hash of the
first word, and of each row only numbers into them. The distinct bigrams are dealt by the first word to cells, where
all bigrams of a word meet: a cell answers every chunk with the counts of the chunk's bigrams over all rows, with what
the entropy of its first words needs, and with the number of its words. The chunk then adds up its rows. What moves is
thus bounded by the distinct bigrams of the chunks, and a word that very many rows hold comes once a chunk and follower.
Nothing is stored: the rows' numbers go through the shuffle of the cells and on with the answers. Rows are ordered before
they are cut into chunks, so a task that runs again cuts the same chunks.

Words are 64-bit hashes, followers of one word the upper 56 bits of theirs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 1 << 21  # bigrams that are combined before they move; a task needs about 100 bytes for each
CELL_BITS = 10  # first words are dealt to so many bits of cells


def _cell(words: np.ndarray) -> np.ndarray:
    """Cells in the order of the hashes, so that a cell is a slice of a sorted chunk."""
    return ((words >> np.int64(64 - CELL_BITS)) + (1 << (CELL_BITS - 1))).astype(np.int64)


def _pack(a: np.ndarray) -> bytes:
    """Compressed numbers; bytes of equal weight lie together, so that the leading zeros of small numbers cost nothing."""
    import pyarrow as pa

    raw = a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(b: bytes, kind) -> np.ndarray:
    import pyarrow as pa

    n, width = int.from_bytes(b[:8], "little"), np.dtype(kind).itemsize
    raw = pa.decompress(b[8:], n, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, n // width).T).view(kind).reshape(n // width)


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    """Elements of a list column one after the other, and the n + 1 offsets of its rows."""
    at = np.asarray(column.offsets).astype(np.int64)
    return column.values.slice(at[0], at[-1] - at[0]).to_numpy(zero_copy_only=False), at - at[0]


def _joined(held: list):
    """One batch of all, which are let go."""
    import pyarrow as pa

    table = pa.Table.from_batches(held)
    held.clear()
    return table.combine_chunks().to_batches()[0]


def _chunks(batches) -> Iterator:
    """Rows (id, words, mask) put together or cut so that a chunk stays near CHUNK words; a longer row comes alone."""
    held, size = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        ends = np.asarray(b.column("words").offsets).astype(np.int64)
        at = 0
        while at < b.num_rows:
            to = max(at + (not held), int(np.searchsorted(ends, ends[at] + CHUNK - size, "right")) - 1)
            if to > at:
                held.append(b.slice(at, to - at))
                size += int(ends[to] - ends[at])
            at = to
            if at < b.num_rows:
                yield _joined(held)
                size = 0
    if held:
        yield _joined(held)


def _packed(batches) -> Iterator:
    """Chunks as one row a cell with the distinct bigrams, and one row (a negative cell of its own) with the ids and their bigrams."""
    import pyarrow as pa
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    for b in _chunks(batches):
        words, at = _flat(b.column("words"))
        mask, _ = _flat(b.column("mask"))
        row = np.repeat(np.arange(b.num_rows, dtype=np.int32), np.diff(at))
        inner = row[1:] == row[:-1]  # a bigram begins at every word but the last of a row
        last = np.unique(words[at[1:] - 1])
        vocabulary, word = np.unique(words, return_inverse=True)
        del words
        pairs = word[:-1][inner] << np.int64(31)
        pairs |= word[1:][inner]
        del word
        pairs, index, counts = np.unique(pairs, return_inverse=True, return_counts=True)
        index = index.astype(np.uint32)
        prev, start = np.unique(pairs >> np.int64(31), return_index=True)
        follows = vocabulary[pairs & np.int64((1 << 31) - 1)].view(np.uint64) >> np.uint64(8)
        runs = np.diff(np.append(start, len(pairs))).astype(np.uint32)
        prev = vocabulary[prev]

        # a row is scored by its supervised bigrams, or by all where it has none
        row, on = row[:-1][inner], mask[1:][inner]
        supervised = np.bincount(row, on, b.num_rows) > 0
        used = on | ~supervised[row]
        n = np.bincount(row[used], minlength=b.num_rows)
        # rows of bigrams in ascending order, each as the steps between them
        index = np.sort(row[used].astype(np.int64) << np.int64(32) | index[used].astype(np.int64)) & np.int64((1 << 32) - 1)
        step = np.diff(index, prepend=0)
        begin = (np.cumsum(n) - n)[n > 0]
        step[begin] = index[begin]

        cells = np.arange(1 << CELL_BITS)  # all of them, because each tells the number of its words
        of_prev, of_last = (np.searchsorted(_cell(v), np.arange(len(cells) + 1)) for v in (prev, last))
        of_pair = np.append(start, len(pairs))[of_prev]
        counts = counts.astype(np.uint32)
        kinds = [("prev", prev, of_prev), ("runs", runs, of_prev), ("follows", follows, of_pair), ("counts", counts, of_pair), ("last", last, of_last)]
        made = {name: [_pack(v[i:j]) for i, j in zip(edge[:-1], edge[1:])] + [None] for name, v, edge in kinds}
        none = [None] * len(cells)
        listed = pa.ListArray.from_arrays(pa.array([0] * (len(cells) + 1) + [b.num_rows], pa.int32()), b.column("id"))
        columns = [
            pa.array([number] * (len(cells) + 1), pa.int64()),
            pa.array([*cells.tolist(), -1 - number], pa.int64()),
            *[pa.array(v, pa.binary()) for v in made.values()],
            listed,
            pa.array([*none, _pack(n.astype(np.uint32))], pa.binary()),
            pa.array([*none, supervised.tobytes()], pa.binary()),
            pa.array([*none, _pack(step.astype(np.uint32))], pa.binary()),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["chunk", "cell", *made, "ids", "n", "supervised", "step"])
        number += 1


def _answers(k: float):
    """For every chunk of a cell: counts over all rows of its bigrams; total, followers and entropy part of its first words.

    The rows of a chunk pass through.
    """
    rows_only, answers_only = ("ids", "n", "supervised", "step"), ("counts", "total", "seen", "part")

    def run(table):
        import pyarrow as pa

        def filled(columns: dict):
            """With NULL in the columns that only the other kind of row has, in the order of all."""
            none = {c: pa.nulls(len(table), table.schema.field(c).type) for c in rows_only}
            none |= {c: pa.nulls(len(table), pa.binary()) for c in answers_only} | {"n_words": pa.nulls(len(table), pa.int64())}
            kept = {c: table.column(c) for c in ("chunk", "cell", "runs")}
            return pa.table(kept | none | columns).select(["chunk", "cell", "runs", *answers_only, "n_words", *rows_only])

        if table.column("cell")[0].as_py() < 0:
            return filled({c: table.column(c) for c in rows_only})

        def column(name, kind):
            return [_unpack(b, kind) for b in table.column(name).to_pylist()]

        prev, runs = column("prev", np.int64), column("runs", np.uint32)
        follows, counts = np.concatenate(column("follows", np.uint64)), np.concatenate(column("counts", np.uint32)).astype(np.int64)
        words, word = np.unique(np.concatenate(prev), return_inverse=True)
        of = np.repeat(word, np.concatenate(runs))
        order = np.lexsort((follows, of))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(of[order]) != 0) | (np.diff(follows[order]) != 0)
        c = np.add.reduceat(counts[order], np.flatnonzero(new)) if len(order) else counts
        each = np.empty(len(order), np.uint64)
        each[order] = c[np.cumsum(new) - 1]
        owner = of[order][new]
        total, seen = np.bincount(owner, c, len(words)).astype(np.uint64), np.bincount(owner, minlength=len(words)).astype(np.uint32)
        part = np.bincount(owner, (c + k) * np.log(c + k), len(words))
        n_words = len(np.union1d(words, np.concatenate(column("last", np.int64))))
        edge, pair_edge = np.cumsum([0, *map(len, prev)]), np.cumsum([0, *[int(r.sum()) for r in runs]])
        made = {"counts": [_pack(each[i:j]) for i, j in zip(pair_edge[:-1], pair_edge[1:])]}
        for name, v in (("total", total), ("seen", seen), ("part", part)):
            made[name] = [_pack(v[word[i:j]]) for i, j in zip(edge[:-1], edge[1:])]
        made = {name: pa.array(v, pa.binary()) for name, v in made.items()}
        return filled(made | {"n_words": pa.array([n_words] * len(table), pa.int64())})

    return run


def _sums(k: float, kind):
    """Sums of a chunk's rows from the answers of all its cells."""

    def run(table):
        import pyarrow as pa

        table = table.sort_by("cell")  # the chunk's rows, then the answers
        rows, a = table.slice(0, 1), table.slice(1)
        kinds = {"runs": np.uint32, "counts": np.uint64, "total": np.uint64, "seen": np.uint32, "part": np.float64}
        runs, counts, total, seen, part = (np.concatenate([_unpack(b, t) for b in a.column(c).to_pylist()]) for c, t in kinds.items())
        vocabulary = sum(a.column("n_words").to_pylist())
        norm = total + k * vocabulary
        # minus p ln p, summed over the followers that were seen and those that were not
        entropy = (np.log(norm) * (total + k * seen) - part) / norm - (vocabulary - seen.astype(np.float64)) * (k / norm) * np.log(k / norm)
        norm, entropy = np.repeat(np.log(norm), runs), np.repeat(entropy, runs)
        lp = np.log(counts + k) - norm
        n, step = (_unpack(rows.column(c)[0].as_py(), np.uint32).astype(np.int64) for c in ("n", "step"))
        # steps add up within a row; every row has a bigram
        index = np.cumsum(step)
        begin = np.cumsum(n) - n
        index -= np.repeat(index[begin] - step[begin], n)
        l, h = lp[index], entropy[index]
        made = [
            pa.array(np.frombuffer(rows.column("supervised")[0].as_py(), bool)),
            pa.array(n),
            *[pa.array(np.add.reduceat(v, begin)) for v in (l, l * l, h)],
            pa.array(np.minimum.reduceat(l, begin)),
            pa.array(np.maximum.reduceat(h, begin)),
        ]
        ids = rows.column("ids").combine_chunks().flatten().cast(kind)
        return pa.Table.from_arrays([ids, *made], names=["id", "supervised", "n", "l1", "l2", "h1", "lmin", "hmax"])

    return run


def bigram_sums(tokenised: DataFrame, id_col: str = "sample_id", k: float = 0.5) -> DataFrame:
    """(id, supervised, n, l1, l2, h1, lmin, hmax) of every row of two tokens or more.

    Sums of the log-probability, its square and the entropy of the first word over the row's supervised bigrams, or
    over all of them (supervised is false) where it has none; the model counts all bigrams of all rows.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = tokenised.schema[id_col].dataType
    words = F.transform("tokens", lambda w: F.xxhash64(w))
    rows = tokenised.where(F.size("tokens") >= 2).select(F.col(id_col).alias("id"), words.alias("words"), F.transform("mask", lambda m: m == 1).alias("mask"))
    rows = rows.sortWithinPartitions("id", "words", "mask")
    members = f"ids array<{kind.simpleString()}>, n binary, supervised binary, step binary"
    packed = rows.mapInArrow(_packed, f"chunk bigint, cell bigint, prev binary, runs binary, follows binary, counts binary, last binary, {members}")
    answer = f"chunk bigint, cell bigint, runs binary, counts binary, total binary, seen binary, part binary, n_words bigint, {members}"
    answers = packed.groupBy("cell").applyInArrow(_answers(k), answer)
    out = f"id {kind.simpleString()}, supervised boolean, n bigint, l1 double, l2 double, h1 double, lmin double, hmax double"
    return answers.groupBy("chunk").applyInArrow(_sums(k, to_arrow_type(kind)), out).withColumnRenamed("id", id_col)
