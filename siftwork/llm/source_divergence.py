"""Source divergence audit: hash-consed segment trees of term counts, priced pair of nodes by pair of nodes."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from siftwork.llm.common import LOWER_BYTES, store

TERM = rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"  # fixed pattern; over UTF-8 bytes it finds what it finds over code points
UNIT, SMOOTH = 1_000_000_000, 5  # fixed: the scale of a share and what is added to each count
MIN_DOCS = 30  # fixed: documents of a language that must hold a term
TOP_TERMS = 50  # fixed
BLOCK = 1024  # terms of a block, on average
SLICE = 128  # sources of a block whose pairs one task prices
HELD = 300_000  # distinct (source, term) a task holds before it passes them on
PIECE = 1 << 20  # bytes of a text that are cut into terms at once

_TERM = re.compile(TERM)
_OTHER = re.compile(rb"[\x00-\x40\x5B-\x60\x7B-\x7F]")


def _terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, piece by piece; a piece ends where a term cannot."""
    at = 0
    while at < len(text):
        stop = at + PIECE
        if stop < len(text):
            gap = _OTHER.search(text, stop)
            stop = gap.start() if gap else len(text)
        yield _TERM.findall(text[at:stop].translate(LOWER_BYTES))
        at = stop


def _count(batches) -> Iterator:
    """(lang, source, term, n, docs) of each task, combined as far as HELD goes; a row without a term names each group."""
    import pyarrow as pa

    n: dict[tuple[str, str], Counter] = {}
    docs: dict[tuple[str, str], Counter] = {}

    def rows():
        out = [(g[0], g[1], None, 0, 0) for g in n]
        for g, c in n.items():
            d = docs[g]
            out += [(g[0], g[1], t, k, d[t]) for t, k in c.items()]
        n.clear()
        docs.clear()
        types = (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64())
        arrays = [pa.array(list(c), t) for c, t in zip(zip(*out), types)]
        return pa.RecordBatch.from_arrays(arrays, names=["lang", "source", "term", "n", "docs"])

    held = 0
    for b in batches:
        for lang, source, text in zip(*[b.column(c).to_pylist() for c in ("lang", "source", "text")]):
            g = (lang, source)
            if g not in n:
                n[g], docs[g] = Counter(), Counter()
            held -= len(n[g])
            here: set[bytes] = set()
            for found in _terms(text):
                n[g].update(found)
                here.update(found)
            docs[g].update(here)
            held += len(n[g])
            if held > HELD:
                yield rows()
                held = 0
    if n:
        yield rows()


class ConsedTrees:
    """Segment trees over the same positions, one a row of counts; equal subtrees are one node, wherever they stand.

    Level 0 holds the distinct counts (``values``; -1 fills up to a power of two), ``children[k]`` the two nodes of
    level k under each node of level k + 1.
    """

    def __init__(self, counts: np.ndarray) -> None:
        width = 1 << max(0, (counts.shape[1] - 1).bit_length())
        filled = np.full((counts.shape[0], width), -1, np.int64)
        filled[:, : counts.shape[1]] = counts
        self.values, ids = np.unique(filled, return_inverse=True)
        ids = ids.reshape(filled.shape)
        self.children: list[np.ndarray] = []
        size = len(self.values)
        while ids.shape[1] > 1:
            pair, inverse = np.unique(ids[:, ::2].astype(np.int64) * size + ids[:, 1::2], return_inverse=True)
            self.children.append(np.stack((pair // size, pair % size), axis=1))
            ids = inverse.reshape(ids.shape[0], -1)
            size = len(pair)
        self.roots = ids[:, 0].astype(np.int64)

    def nodes(self, level: int) -> int:
        return len(self.children[level - 1]) if level else len(self.values)


class Traversal:
    """One row's tree walked together with the trees of ``others``: every pair of nodes met is kept once a level."""

    def __init__(self, trees: ConsedTrees, row: int, others: np.ndarray) -> None:
        self.trees, self.others = trees, others
        slot = np.arange(len(others))
        a, b = np.full(len(others), trees.roots[row]), trees.roots[others]
        self.left: list[np.ndarray] = []
        self.right: list[np.ndarray] = []
        for level in range(len(trees.children), 0, -1):
            child, n = trees.children[level - 1], trees.nodes(level - 1)
            both = [(slot * n + child[a, side]) * n + child[b, side] for side in (0, 1)]
            pair, at = np.unique(np.concatenate(both), return_inverse=True)
            self.left.insert(0, at[: len(slot)])
            self.right.insert(0, at[len(slot) :])
            slot, a, b = pair // (n * n), pair // n % n, pair % n
        self.slot, self.a, self.b = slot, a, b  # the pairs of leaves

    def fold(self, leaf: np.ndarray, join) -> list[np.ndarray]:
        """Each pair's price from the prices of its two children, level by level; the last level is the roots."""
        out = [leaf]
        for left, right in zip(self.left, self.right):
            out.append(join(out[-1][left], out[-1][right]))
        return out

    def places(self, best: list[np.ndarray], root: int) -> tuple[np.ndarray, np.ndarray]:
        """(position, price) of the leaves under one pair of roots that have a price above 0; other branches are not entered."""
        at, node = np.zeros(1, np.int64), np.array([root])
        for level in range(len(self.left), 0, -1):
            open_ = best[level][node] > 0
            at, node = at[open_], node[open_]
            at = np.concatenate((2 * at, 2 * at + 1))
            node = np.concatenate((self.left[level - 1][node], self.right[level - 1][node]))
        hit = best[0][node] > 0
        return at[hit], best[0][node][hit]


def shares(values: np.ndarray, total: int, terms: int) -> np.ndarray:
    """1 + floor(UNIT * (count + SMOOTH) / (total + SMOOTH * terms)) in whole numbers of any size; 0 for the filling -1."""
    top = (values.astype(object) + SMOOTH) * UNIT
    return np.where(values < 0, 0, 1 + top // (total + SMOOTH * terms)).astype(np.int64)


def _audit(top: int):
    """Pairs of sources and leading terms of one block of a language's terms, for one slice of its sources."""
    names = ["lang", "kind", "gid", "other", "term", "value"]

    def run(cells, groups):
        import pyarrow as pa

        types = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64())
        meta = groups.to_pydict()
        if not meta["gid"]:
            return pa.table({c: pa.array([], t) for c, t in zip(names, types)})
        order = np.argsort(meta["gid"])
        totals = [int(meta["total"][i]) for i in order] + [int(meta["lang_total"][0])]
        lang, part, n_terms, n = meta["lang"][0], int(meta["slice"][0]), int(meta["terms"][0]), len(order)
        word = cells.column("term").combine_chunks().dictionary_encode()
        words = word.dictionary.to_pylist()
        counts = np.zeros((n + 1, max(1, len(words))), np.int64)
        if words:
            counts[np.asarray(cells.column("gid")), np.asarray(word.indices)] = np.asarray(cells.column("n"))
            counts[n] = counts[:n].sum(axis=0)
            rank = sorted(range(len(words)), key=lambda i: (-counts[n, i], words[i].encode()))
            counts, words = counts[:, rank], [words[i] for i in rank]
        else:
            counts[:] = -1
        trees = ConsedTrees(counts)
        price = np.stack([shares(trees.values, t, n_terms) if words else np.zeros(1, np.int64) for t in totals])
        out = []
        for a in range(part * SLICE, min(n, (part + 1) * SLICE)):
            others = np.concatenate((np.arange(a + 1, n), [n]))  # the last is the language itself
            walk = Traversal(trees, a, others)
            gap = price[a][walk.a] - price[others[walk.slot], walk.b]
            sums = walk.fold(np.abs(gap), np.add)[-1]
            out += [(lang, "pair", a, int(b), None, int(s)) for b, s in zip(others[:-1], sums)]
            lead = np.where((walk.slot == len(others) - 1) & (trees.values[walk.a] > 0), np.maximum(gap, 0), 0)
            place, value = walk.places(walk.fold(lead, np.maximum), len(others) - 1)
            found = sorted((-int(v), words[p].encode(), words[p]) for p, v in zip(place, value))[:top]
            out += [(lang, "term", a, None, w, -v) for v, _, w in found]
        columns = zip(*out) if out else [[]] * 6
        return pa.table({c: pa.array(list(x), t) for c, x, t in zip(names, columns, types)})

    return run


def source_divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """How far the sources of a language (columns text, lang, source; NULL reads as '') lie apart: (lang, source, part, item, value, rank).

    Terms are runs of letters A-Z (lowered) and of characters beyond ASCII; a language keeps those that at least
    ``min_docs`` of its rows hold. Each source's share of a kept term is smoothed and scaled to whole numbers
    (``shares``). Part ``pair`` lists every other source of the language with the sum of all differences of shares,
    part ``term`` the ``top`` kept terms of the source whose share exceeds the language's by most. Ranks count from 1
    by descending value, then by item.

    A source without kept terms takes part with counts of 0; a language without kept terms has pairs of value 0 and
    no terms; a language with one source has no pairs; rows with equal ids are separate documents; an empty table
    gives no rows. Other columns are not read, whatever their names.

    Counts combine inside tasks, so a source with a third of all rows costs one row a task and term. Terms are dealt
    to blocks of about BLOCK by hash, and a task sees one block of all sources of its language: it builds a segment
    tree a source over the block, most frequent terms first, in which equal subtrees are one node, and walks the
    trees of two sources together, pricing each pair of nodes once. Sums over blocks give the pairs. Pairs of sources
    are the result itself, so sources squared is what a language costs.
    """
    read = docs.select(
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")],
        F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"),
    )
    counted = read.mapInArrow(_count, "lang string, source string, term binary, n bigint, docs bigint")
    cells = store(counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "terms")
    kept = cells.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs)
    held = store(cells.where("term IS NOT NULL").drop("docs").join(kept.select("lang", "term"), ["lang", "term"]), "kept-terms")

    totals = held.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = cells.where("term IS NULL").select("lang", "source").join(totals, ["lang", "source"], "left").fillna(0, ["total"])
    groups = groups.withColumn("gid", (F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1).cast("bigint"))
    groups = store(groups, "sources")
    terms = held.select("lang", "term").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("terms"))
    langs = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources"), F.sum("total").alias("lang_total"))
    langs = langs.join(terms, "lang", "left").fillna(0, ["terms"])
    blocks = F.greatest(F.lit(1), F.ceil(F.col("terms") / BLOCK)).cast("bigint")
    langs = store(langs.withColumn("blocks", blocks).withColumn("slices", F.ceil(F.col("sources") / SLICE).cast("bigint")), "languages")

    slices = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("slices") - 1)).alias("slice")
    left = held.join(groups.select("lang", "source", "gid"), ["lang", "source"]).join(langs.select("lang", "blocks", "slices"), "lang")
    left = left.select("lang", F.pmod(F.xxhash64("term"), "blocks").alias("block"), slices, "gid", F.col("term").cast("string").alias("term"), "n")
    right = langs.select("lang", "terms", "lang_total", "slices", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block"))
    right = right.join(groups, "lang").select(F.col("lang").alias("lang"), "block", slices, F.col("gid").alias("gid"), "total", "lang_total", "terms")
    key = ["lang", "block", "slice"]
    schema = "lang string, kind string, gid bigint, other bigint, term string, value bigint"
    found = store(left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_audit(top), schema), "divergence")

    sums = found.where("kind = 'pair'").groupBy("lang", "gid", "other").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct("gid", "other"), F.struct(F.col("other").alias("gid"), F.col("gid").alias("other")))).alias("p")
    other = groups.select("lang", F.col("gid").alias("other"), F.col("source").alias("item"))
    pairs = sums.select("lang", "value", both).select("lang", "value", "p.*").join(other, ["lang", "other"])
    leads = found.where("kind = 'term'").select("lang", "value", "gid", F.col("term").alias("item"))
    w = W.partitionBy("lang", "gid").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "gid", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(w))
    leads = leads.select("lang", "gid", F.lit("term").alias("part"), "item", "value").withColumn("rank", F.row_number().over(w))
    out = pairs.unionByName(leads.where(F.col("rank") <= top)).join(groups.select("lang", "gid", "source"), ["lang", "gid"])
    return out.select("lang", "source", "part", "item", "value", "rank")
