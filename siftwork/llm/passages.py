"""Fuzzy repeated passages: shared k-mer seeds, collinear chaining through a Fenwick tree, alignment of chains."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwork.llm.common import STEP, STEP_INVERSE, body, cached_powers, lower_bytes, mix, packs, shingle_hashes, small, store, word_hashes

K = 5  # words of a seed
WINDOW = 12  # of so many seeds in a row the one with the smallest hash is kept
DENSE_K, DENSE_WINDOW = 4, 6  # of the seeds for what those leave apart
GAP = 0.08  # cost of a word between two matches; a match of K words pays for 62
MIN_WORDS = 50
IDENTITY = 0.8
REACH = 34  # words beyond a chain's ends that the alignment may add
ALIGNED, CELLS = 256, 1 << 15  # chains, and cells of a row, that are aligned side by side


def seeds_of(words: np.ndarray, start: np.ndarray, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, position) of the minimizers of each text: two texts that share k + window - 1 words share one."""
    docs, places, hashes = [], [], []
    for i in range(len(start) - 1):
        w = words[start[i] : start[i + 1]]
        if len(w) < k + window - 1:
            continue
        h = shingle_hashes(w, k)
        low = np.lib.stride_tricks.sliding_window_view(h, window).argmin(axis=1) + np.arange(len(h) - window + 1)
        at = np.unique(low)
        docs.append(np.full(len(at), i))
        places.append(at)
        hashes.append(h[at])
    if not docs:
        none = np.empty(0, np.int64)
        return none.astype(np.uint64), none, none
    return np.concatenate(hashes), np.concatenate(docs), np.concatenate(places)


def chains(x: np.ndarray, y: np.ndarray, k: int = K, gap: float = GAP) -> list[np.ndarray]:
    """Best collinear chains of matches (x[i], y[i]); each is an array of match indices in order.

    The score of a match is the k words it covers plus the best score of a match before it in both texts, less the
    gap cost of half the words between them in either. That cost splits into one part for each end, so the best
    predecessor is a prefix maximum over y, which a Fenwick tree holds while matches are taken in order of x.
    Chains are read off from the best end down; a match belongs to one chain.
    """
    order = np.lexsort((-y, x))
    rank = np.searchsorted(np.unique(y), y) + 1
    n = int(rank.max(initial=0))
    best, who = [float("-inf")] * (n + 1), [-1] * (n + 1)
    score, before = np.empty(len(x)), np.full(len(x), -1)
    half = gap / 2
    for i in order.tolist():
        r, s, j = int(rank[i]) - 1, float("-inf"), -1
        while r > 0:
            if best[r] > s:
                s, j = best[r], who[r]
            r -= r & -r
        here = float(x[i] + y[i]) * half
        gain = s - here + k * gap
        # overlapping matches add only the words that are new
        if j >= 0:
            gain -= max(0, k - int(min(x[i] - x[j], y[i] - y[j])))
        score[i] = k
        if j >= 0 and gain > 0:
            score[i] += gain
            before[i] = j
        r, s = int(rank[i]), score[i] + here
        while r <= n:
            if s > best[r]:
                best[r], who[r] = s, i
            r += r & -r
    used, out = np.zeros(len(x), bool), []
    for i in np.argsort(-score, kind="stable").tolist():
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(i)
            i = int(before[i])
        if chain:
            out.append(np.array(chain[::-1]))
    return out


def _next_row(row: np.ndarray, word: np.ndarray, b: np.ndarray, step: np.ndarray) -> np.ndarray:
    """The row of the edit distance table after one more word; a column is one pair of texts."""
    new = np.empty_like(row)
    new[0] = row[0] + 1
    new[1:] = np.minimum(row[:-1] + (b != word), row[1:] + 1)
    return np.minimum.accumulate(new - step, axis=0) + step


def _side_by_side(arrays: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Arrays as columns of one table, and their lengths; what lies beyond an array's end is not looked at."""
    size = np.array([len(w) for w in arrays])
    table = np.zeros((len(arrays), int(size.max(initial=0))), np.uint64)
    table[np.arange(table.shape[1]) < size[:, None]] = np.concatenate(arrays)
    return np.ascontiguousarray(table.T), size


def edit_distances(pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Words to insert, delete or replace in each pair; pairs of similar length share the rows of one table."""
    out = np.zeros(len(pairs), np.int64)
    open_ = []
    for n, (a, b) in enumerate(pairs):
        if not len(a) or not len(b):
            out[n] = max(len(a), len(b))
        elif len(a) != len(b) or a.tobytes() != b.tobytes():
            open_.append((n, a, b) if len(a) >= len(b) else (n, b, a))
    open_.sort(key=lambda r: (len(r[1]), len(r[2])))
    at = 0
    while at < len(open_):
        least, to, wide = len(open_[at][1]), at, 0
        while to < len(open_) and len(open_[to][1]) <= 2 * least and (to == at or (to - at + 1) * max(wide, len(open_[to][2])) <= CELLS):
            wide = max(wide, len(open_[to][2]))
            to += 1
        (a, long), (b, short) = (_side_by_side([r[i] for r in open_[at:to]]) for i in (1, 2))
        step = np.arange(len(b) + 1, dtype=np.int32)[:, None]
        row = np.repeat(step, to - at, axis=1)
        number = np.array([r[0] for r in open_[at:to]])
        for i in range(len(a)):
            row = _next_row(row, a[i], b, step)
            done = np.flatnonzero(long == i + 1)
            out[number[done]] = row[short[done], done]
        at = to
    return out


def edit_distance(a: np.ndarray, b: np.ndarray) -> int:
    """Words to insert, delete or replace."""
    return int(edit_distances([(a, b)])[0])


def _extend(a: np.ndarray, b: np.ndarray, drop: int = 6) -> tuple[int, int]:
    """Words and mismatches of the best extension along both arrays: a match adds 1, a mismatch takes 2."""
    n = min(len(a), len(b))
    same = a[:n] == b[:n]
    total = np.cumsum(np.where(same, 1, -2))
    if not n:
        return 0, 0
    low = np.flatnonzero(np.maximum.accumulate(np.maximum(total, 0)) - total > drop)
    upto = int(low[0]) if len(low) else n
    if not upto:
        return 0, 0
    at = int(np.argmax(total[:upto]))
    return (at + 1, int((~same[: at + 1]).sum())) if total[at] > 0 else (0, 0)


def _extend_gapped(pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int, int]]:
    """Of each pair: words of a, words of b and edits of the best extension along both, words left out of one included."""
    (a, long), (b, short) = (_side_by_side([p[i][:REACH] for p in pairs]) for i in (0, 1))
    step = np.arange(len(b) + 1, dtype=np.int32)[:, None]
    rows = [np.repeat(step, len(pairs), axis=1)]
    for w in a:
        rows.append(_next_row(rows[-1], w, b, step))
    edits = np.stack(rows)
    # a matched word of both adds 1, an edit takes 2
    gain = np.arange(len(a) + 1, dtype=np.int32)[:, None, None] + step - 5 * edits
    inside = (np.arange(len(a) + 1)[:, None, None] <= long) & (step <= short)
    best = np.where(inside, gain, np.iinfo(np.int32).min).reshape(-1, len(pairs)).argmax(axis=0)
    i, j = np.unravel_index(best, edits.shape[:2])
    return list(zip(i.tolist(), j.tolist(), edits[i, j, np.arange(len(pairs))].tolist()))


def _between(chains_: list[tuple], k: int) -> np.ndarray:
    """Edits between the matches x, y of each chain (a, b, x, y)."""
    edits, gaps, owner = np.zeros(len(chains_), np.int64), [], []
    for n, (a, b, x, y) in enumerate(chains_):
        da, db = np.diff(x) - k, np.diff(y) - k
        over = (da < 0) | (db < 0)  # overlaps the match before: a change of diagonal is so many insertions
        edits[n] = np.abs(da - db)[over].sum()
        for m in np.flatnonzero(~over & ((da > 0) | (db > 0))).tolist():
            i, j = int(x[m]) + k, int(y[m]) + k
            gaps.append((a[i : i + int(da[m])], b[j : j + int(db[m])]))
            owner.append(n)
    np.add.at(edits, np.array(owner, np.int64), edit_distances(gaps))
    return edits


def _ends(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, k: int) -> tuple:
    """What lies after a chain, and before it from the chain outwards, in both word arrays."""
    return (a[int(x[-1]) + k :], b[int(y[-1]) + k :]), (a[: int(x[0])][::-1], b[: int(y[0])][::-1])


def passages(chains_: list[tuple], min_words: int, identity: float, k: int = K) -> list[tuple[int, int, int, int, int] | None]:
    """(start, end, start, end, edits) of the passages of chains (a, b, x, y) that are long and alike enough, else None.

    x, y are a chain's matches in the word arrays a, b. Between matches the words are aligned by edit distance; both
    ends are extended word by word, and what falls short gets a second try past words that only one side has.
    """
    edits = _between(chains_, k).tolist()

    def judged(n, right, left):
        x, y = chains_[n][2:]
        s, e, t, u = int(x[0]) - left[0], int(x[-1]) + k + right[0], int(y[0]) - left[1], int(y[-1]) + k + right[1]
        wrong = edits[n] + right[2] + left[2]
        return (s, e, t, u, wrong) if e - s >= min_words and 1 - wrong / (e - s) >= identity else None

    out = []
    for n, c in enumerate(chains_):
        out.append(judged(n, *[(words, words, wrong) for words, wrong in (_extend(*e) for e in _ends(*c, k))]))
    short = [n for n, got in enumerate(out) if got is None]
    for at in range(0, len(short), ALIGNED):
        some = short[at : at + ALIGNED]
        found = _extend_gapped([e for n in some for e in _ends(*chains_[n], k)])
        for n, right, left in zip(some, found[::2], found[1::2]):
            out[n] = judged(n, right, left)
    return out


def passage(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, min_words: int, identity: float, k: int = K) -> tuple[int, int, int, int, int] | None:
    """``passages`` of one chain."""
    return passages([(a, b, x, y)], min_words, identity, k)[0]


def _seeds(docs: DataFrame) -> DataFrame:
    def run(batches) -> Iterator:
        import pyarrow as pa

        for b in packs(batches):
            ids = np.asarray(b.column("doc_id"))
            cut = word_hashes([lower_bytes(t) for t in b.column("text").to_pylist()])
            for dense, size in ((False, (K, WINDOW)), (True, (DENSE_K, DENSE_WINDOW))):
                h, doc, at = seeds_of(*cut, *size)
                made = [h.view(np.int64), ids[doc], at, np.full(len(h), dense)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in made], names=["h", "doc", "pos", "dense"])

    return docs.select("doc_id", "text").mapInArrow(run, "h bigint, doc bigint, pos bigint, dense boolean")


def _preceding(seeds: DataFrame) -> DataFrame:
    """(doc, other, pos, at): where each holder of a seed has it first, with where the holder just before it has it last.

    Seeds are dealt to sorted ranges of (seed, document), so one that very many documents hold is several ranges; the
    first row of a range takes the last row of the ranges before it.
    """

    def run(batches) -> Iterator:
        import pyarrow as pa

        last = np.empty((4, 0), np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            here = np.stack([np.asarray(b.column(c)) for c in ("part", "h", "doc", "pos")])
            both = np.concatenate((last, here), axis=1)
            same = (both[0, 1:] == both[0, :-1]) & (both[1, 1:] == both[1, :-1]) & (both[2, 1:] > both[2, :-1])
            at = np.flatnonzero(same)
            made = (both[2, at + 1], both[2, at], both[3, at + 1], both[3, at])
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in made], names=["doc", "other", "pos", "at"])
            last = here[:, -1:]

    ranges = seeds.repartitionByRange("h", "doc", "pos").sortWithinPartitions("h", "doc", "pos")
    ranges = store(ranges.select(F.spark_partition_id().cast("bigint").alias("part"), "h", "doc", "pos"), "seed-ranges")
    inner = ranges.repartition("part").sortWithinPartitions("part", "h", "doc", "pos").mapInArrow(run, "doc bigint, other bigint, pos bigint, at bigint")
    row = F.struct("h", "doc", "pos")
    ends = store(ranges.groupBy("part").agg(F.min(row).alias("first"), F.max(row).alias("last")), "range-ends")  # one row a range
    before = F.lag("last").over(Window.orderBy("part"))
    over = ends.withColumn("b", before).where("b.h = first.h AND b.doc < first.doc")
    return inner.unionByName(over.select(F.col("first.doc").alias("doc"), F.col("b.doc").alias("other"), F.col("first.pos").alias("pos"), F.col("b.pos").alias("at")))


def runs_of(h: np.ndarray, doc: np.ndarray, pos: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, index, last index) of the runs of seeds (sorted by document and position) that begin within ``span`` words.

    A run begins at any seed whose followers come without a gap; its hash is one of its seeds and their distances.
    """
    number = np.cumsum(np.diff(doc, prepend=doc[:1]) != 0)
    at = number << 32 | pos
    piece = np.cumsum(np.diff(at, prepend=at[:1]) > DENSE_WINDOW)
    last = np.searchsorted(at, at + span, "right") - 1
    i = np.flatnonzero((piece == piece[last]) & (pos[last] - pos > span - DENSE_WINDOW))
    size = int(pos.max(initial=0)) + 1
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(mix(h.view(np.uint64)) * cached_powers(STEP, size)[pos], out=total[1:])
    return mix((total[last[i] + 1] - total[i]) * cached_powers(STEP_INVERSE, size)[pos[i]]), i, last[i]


def _runs(seeds: DataFrame, span: int) -> DataFrame:
    def run(batches) -> Iterator:
        import pyarrow as pa

        def out(rows):
            h, i, j = runs_of(*rows, span)
            made = [h.view(np.int64), rows[1][i], rows[2][i], rows[2][j] + DENSE_K]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in made], names=["h", "doc", "pos", "to"])

        held = np.empty((3, 0), np.int64)
        for b in batches:
            held = np.concatenate((held, np.stack([np.asarray(b.column(c)) for c in ("h", "doc", "pos")])), axis=1)
            new = np.flatnonzero(np.diff(held[1])) + 1
            if len(new):
                yield out(held[:, : new[-1]])
                held = held[:, new[-1] :]
        if held.shape[1]:
            yield out(held)

    ordered = seeds.repartition("doc").sortWithinPartitions("doc", "pos")
    return ordered.mapInArrow(run, "h bigint, doc bigint, pos bigint, to bigint")


def _windows(areas: DataFrame, d: DataFrame, n: int) -> DataFrame:
    """(h, doc, pos): the runs of n words in the areas lo..hi of each document."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for doc, text, lo, hi in zip(*[b.column(c).to_pylist() for c in ("doc_id", "text", "lo", "hi")]):
                words = word_hashes([lower_bytes(text)])[0]
                if len(words) < n:
                    continue
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, np.clip(lo, 0, len(words)), 1)
                np.add.at(edge, np.clip(hi, 0, len(words)), -1)
                whole = np.cumsum(np.concatenate(([0], np.cumsum(edge)[:-1] > 0)))
                at = np.flatnonzero(whole[n:] - whole[:-n] == n)
                h = shingle_hashes(words, n)[at]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(len(at), doc)), pa.array(at)], names=["h", "doc", "pos"])

    lists = areas.groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list(F.struct("lo", "hi")).alias("areas"))  # parts of one document
    asked = d.join(lists, "doc_id").select("doc_id", "text", F.col("areas.lo").alias("lo"), F.col("areas.hi").alias("hi"))
    return asked.mapInArrow(run, "h bigint, doc bigint, pos bigint")


def _first_holders(seeds: DataFrame) -> DataFrame:
    """(h, other, at): the smallest document of each seed that at least two hold, and where it has it first."""
    first = seeds.groupBy("h").agg(F.min(F.struct("doc", "pos")).alias("f"), F.max("doc").alias("last"))
    return first.where("f.doc < last").select("h", F.col("f.doc").alias("other"), F.col("f.pos").alias("at"))


def _apart(shared: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of ``shared`` (h, doc, pos, to, other, at) without a passage over pos..to that leads to a smaller holder of h.

    Where no holder of h but the first is left, all passages over it lead to the first.
    """
    later = shared.where("doc > other")
    over = found.select(F.col("doc_id").alias("doc"), F.col("other_id").alias("holder"), F.col("start").alias("s"), F.col("end").alias("e"))
    over = later.join(over, "doc").where("s <= pos AND e >= to").select("h", "doc", "pos", "holder")
    held = shared.select("h", F.col("doc").alias("holder")).distinct()
    closed = over.join(held, ["h", "holder"], "left_semi").select("h", "doc", "pos").distinct()
    return later.join(closed, ["h", "doc", "pos"], "left_anti")


def _links_apart(seeds: DataFrame, d: DataFrame, found: DataFrame, min_words: int) -> DataFrame:
    """(doc, other, pos, at) that tie what the passages ``found`` leave apart: each run of ``min_words`` equal words to its first holder.

    Any such run of words holds a run of seeds of a known span. The words around runs of seeds that are apart are
    looked at one by one, in all documents that hold them.
    """
    runs = store(_runs(seeds, max(0, min_words - DENSE_K - 2 * (DENSE_WINDOW - 1))), "runs")
    shared = store(runs.join(store(_first_holders(runs), "first-runs"), "h"), "shared-runs")
    apart = store(_apart(shared, found).select("h").distinct(), "runs-apart")
    room = 2 * DENSE_WINDOW  # a run of seeds begins and ends so near to the ends of the words that hold it
    areas = shared.join(apart, "h", "left_semi").select("doc", (F.col("pos") - room).alias("lo"), (F.col("to") + room).alias("hi"))
    windows = store(_windows(areas, d, min_words), "windows")
    shared = store(windows.join(_first_holders(windows), "h").withColumn("to", F.col("pos") + min_words), "shared-windows")
    steps = F.array(*[F.lit(i).cast("bigint") for i in sorted({*range(0, min_words - DENSE_K, 2 * DENSE_K), max(0, min_words - DENSE_K)})])
    return _apart(shared, found).withColumn("step", F.explode(steps)).selectExpr("doc", "other", "pos + step AS pos", "at + step AS at").distinct()


def _chained(links: DataFrame, min_words: int, k: int) -> DataFrame:
    """Chains of each (doc, other) from rows sorted by them: their ends and matches."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        def groups():
            """Pairs with two matches or more; most chance pairs have one and are passed over at once."""
            held = np.empty((4, 0), np.int64)
            for b in batches:
                held = np.concatenate((held, np.stack([np.asarray(b.column(c)) for c in ("doc", "other", "pos", "at")])), axis=1)
                new = np.flatnonzero((np.diff(held[0]) != 0) | (np.diff(held[1]) != 0)) + 1
                if len(new):
                    begin = np.concatenate(([0], new[:-1]))
                    for a, z in zip(begin[new - begin > 1].tolist(), new[new - begin > 1].tolist()):
                        yield held[:, a:z]
                    held = held[:, new[-1] :]
            yield held

        rows = []
        for g in groups():
            if g.shape[1] < 2:
                continue
            for c in chains(g[2], g[3], k):
                x, y = g[2][c], g[3][c]
                if len(c) > 1 and x[-1] - x[0] + k + 2 * REACH >= min_words:
                    rows.append((int(g[0][0]), int(g[1][0]), int(x[0]), int(x[-1]) + k, int(y[0]), int(y[-1]) + k, np.stack((x, y)).tobytes()))
            if len(rows) > 2000:
                yield out(rows)
                rows = []
        if rows:
            yield out(rows)

    def out(rows):
        import pyarrow as pa

        kinds = [pa.int64()] * 6 + [pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], names=["doc", "other", "x0", "x1", "y0", "y1", "matches"])

    ordered = links.repartition("doc").sortWithinPartitions("doc", "other", "pos", "at")
    return ordered.mapInArrow(run, "doc bigint, other bigint, x0 bigint, x1 bigint, y0 bigint, y1 bigint, matches binary")


def _slices(wanted: DataFrame) -> DataFrame:
    """Word hashes lo..hi of each row's text, as bytes; rows of one text follow each other."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        last, words = None, None
        for b in batches:
            cut, size = [], []
            for text, lo, hi in zip(*[b.column(c).to_pylist() for c in ("text", "lo", "hi")]):
                if text != last:
                    last, words = text, word_hashes([lower_bytes(text)])[0]
                cut.append(words[max(0, lo) : hi].tobytes())
            yield pa.RecordBatch.from_arrays([b.column("chain"), b.column("side"), pa.array(cut, pa.binary())], names=["chain", "side", "words"])

    return wanted.select("chain", "side", "lo", "hi", "text").mapInArrow(run, "chain bigint, side int, words binary")


def _aligned(links: DataFrame, d: DataFrame, min_words: int, identity: float, k: int = K, least: int = 0) -> DataFrame:
    """Passages of the pairs that the links (doc, other, pos, at) tie: their chains of ``least`` words or more, aligned on the words of both."""
    found = _chained(links, min_words, k).where(F.col("x1") - F.col("x0") >= least).withColumn("chain", F.xxhash64("doc", "other", "x0", "y0", "x1", "y1"))
    found = store(found, "chains")

    sides = F.array(
        F.struct(F.col("doc").alias("id"), F.lit(0).alias("side"), F.col("x0").alias("from"), F.col("x1").alias("to")),
        F.struct(F.col("other").alias("id"), F.lit(1).alias("side"), F.col("y0").alias("from"), F.col("y1").alias("to")),
    )
    asked = found.select("chain", F.explode(sides).alias("s")).select(
        "chain", "s.side", F.col("s.id").alias("doc_id"), (F.col("s.from") - REACH).alias("lo"), (F.col("s.to") + REACH).alias("hi")
    )
    cut = store(_slices(asked.join(d, "doc_id")), "slices")
    left = cut.where("side = 0").select("chain", F.col("words").alias("a"))
    right = cut.where("side = 1").select("chain", F.col("words").alias("b"))

    def run(batches) -> Iterator:
        import pyarrow as pa

        for b in batches:
            rows, asked, ends = [], [], []
            for r in zip(*[b.column(c).to_pylist() for c in ("doc", "other", "x0", "y0", "matches", "a", "b")]):
                doc, other, x0, y0, matches, wa, wb = r
                x, y = np.frombuffer(matches, np.int64).reshape(2, -1)
                dx, dy = max(0, x0 - REACH), max(0, y0 - REACH)
                ends.append((doc, other, dx, dy))
                asked.append((np.frombuffer(wa, np.uint64), np.frombuffer(wb, np.uint64), x - dx, y - dy))
            for (doc, other, dx, dy), got in zip(ends, passages(asked, min_words, identity, k)):
                if got:
                    s, e, t, u, edits = got
                    rows.append((doc, other, s + dx, e + dx, t + dy, u + dy, e - s, round(1 - edits / (e - s), 6)))
            if rows:
                kinds = [pa.int64()] * 7 + [pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=names)

    names = ["doc_id", "other_id", "start", "end", "other_start", "other_end", "n_words", "identity"]
    schema = ", ".join(f"`{n}` bigint" for n in names[:7]) + ", identity double"
    whole = found.join(left, "chain").join(right, "chain")
    return whole.select("doc", "other", "x0", "y0", "matches", "a", "b").mapInArrow(run, schema)


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, identity: float = IDENTITY) -> DataFrame:
    """(doc_id, other_id, start, end, other_start, other_end, n_words, identity): passages that an earlier document holds.

    Positions are words (A-Z lowered, split at white space), ends exclusive. A passage has ``min_words`` words or more
    and 1 - edits / words of at least ``identity``. other_id is smaller than doc_id.

    Equal texts are one document: a copy gets one row over its whole text, to the smallest id. Each seed is tied to
    the smallest document that holds it and to the holder just before, so a passage in n documents makes at most
    2 n pairs, not n squared. Denser seeds that no such passage covers are tied in the same way, and runs of ``min_words``
    equal words that are still apart to their first holder, so rows lead from each holder of such a run to every other. Rows without an id, and NULL or short texts,
    have no rows. Rows with equal ids count as one document. Other columns are not read.
    """
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), body().alias("text")).where("doc_id IS NOT NULL")
    marks = [F.xxhash64("text").alias("a"), F.xxhash64(F.lit(3), "text").alias("b")]
    n_words = F.size(F.split(F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " ")), " "))
    keyed = d.select("doc_id", *marks)
    least = keyed.groupBy("a", "b").agg(F.min("doc_id").alias("rep"))
    copies = store(keyed.join(store(least, "texts"), ["a", "b"]).where("doc_id > rep").select("doc_id", "rep").distinct(), "copies")
    copies_hint = small(copies)

    seeds = store(_seeds(d).join(copies_hint.select(F.col("doc_id").alias("doc")), "doc", "left_anti"), "seeds")
    first = store(_first_holders(seeds), "first-holders")
    shared = store(seeds.join(first, "h"), "shared-seeds")
    links = shared.where("NOT dense AND doc > other").select("doc", "other", "pos", "at")
    links = links.unionByName(_preceding(shared.where("NOT dense").select("h", "doc", "pos"))).distinct()
    near = store(_aligned(links, d, min_words, identity), "passages")

    dense = shared.where("dense").withColumn("to", F.col("pos") + DENSE_K)
    apart = store(_apart(dense, near), "seeds-apart")
    links = apart.select("doc", "other", "pos", "at").unionByName(_preceding(apart.select("h", "doc", "pos"))).distinct()
    near = store(near.unionByName(_aligned(links, d, min_words, identity, DENSE_K)), "more-passages")

    links = _links_apart(dense.select("h", "doc", "pos"), d, near, min_words)
    # a run of equal words is a match every few words, so shorter chains are what repeats within it
    fuzzy = near.unionByName(_aligned(links, d, min_words, identity, DENSE_K, min_words // 2)).distinct()
    zero = F.lit(0).cast("bigint")
    # asked of both sides, so that only the copies' words are counted
    n_words = F.when(F.col("doc_id") > F.col("rep"), n_words.cast("bigint"))
    sized = d.join(copies_hint.withColumnRenamed("doc_id", "_c"), F.col("doc_id") == F.col("_c")).withColumn("n", n_words)
    same = sized.where(F.col("n") >= min_words).select(
        "doc_id", F.col("rep").alias("other_id"), zero.alias("start"), F.col("n").alias("end"),
        zero.alias("other_start"), F.col("n").alias("other_end"), F.col("n").alias("n_words"), F.lit(1.0).alias("identity"),
    )
    return fuzzy.unionByName(same.distinct())
