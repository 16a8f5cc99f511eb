"""Exact set-similarity self-join by prefix filter, and the components it leads to.

Two sets with Jaccard >= t share an element among the first ``n - ceil(t * n) + 1`` of each, whatever order is used
for all sets. Ordering elements by rarity keeps the lists of sets that share a prefix element short. What shares one
is filtered by size and by position, and then checked on the whole sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.functions import text as TX
from siftwork.operators.common import skewed_join
from siftwork.operators.graph import components
from siftwork.session import cut_lineage, stored

COUNTERS = 1 << 18  # elements are counted in so many cells; the order only balances, results do not depend on it
CELLS = 1 << 12  # counters that are added up together
PIECE = 1 << 20  # elements that are sorted at once


def _flat(batch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """All elements of a list column one after the other, and where each row begins (n + 1 offsets)."""
    column = batch.column(name)
    offsets = np.asarray(column.offsets).astype(np.int64)
    return np.asarray(column.values)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _pieces(batches) -> Iterator:
    """Batches cut so that the sets of a piece stay near PIECE elements (a larger set comes alone)."""
    for b in batches:
        if not b.num_rows:
            continue
        ends = np.asarray(b.column("grams").offsets).astype(np.int64)
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + PIECE, "right")) - 1)
            yield b.slice(at, to - at)
            at = to


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    h = (h.view(np.uint64) ^ np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    return h * np.uint64(0xD6E8FEB86659FD93)


def _signatures(batches) -> Iterator:
    """(id, n, sig): equal sets have equal signatures of 128 bits (two order-free sums)."""
    import pyarrow as pa

    for b in _pieces(batches):
        g, at = _flat(b, "grams")
        sums = [np.add.reduceat(_mixed(g, k), at[:-1]) for k in (1, 2)]
        sig = np.ascontiguousarray(np.stack(sums, axis=1)).view("S16").ravel() if len(at) > 1 else []
        made = [b.column("id"), pa.array(np.diff(at)), pa.array([bytes(s).ljust(16, b"\0") for s in sig], pa.binary())]
        yield pa.RecordBatch.from_arrays(made, names=["id", "n", "sig"])


def _counts(batches) -> Iterator:
    """Elements per cell, one row for every CELLS counters."""
    import pyarrow as pa

    total = np.zeros(COUNTERS, np.int64)
    for b in _pieces(batches):
        g, _ = _flat(b, "grams")
        total += np.bincount(g & (COUNTERS - 1), minlength=COUNTERS)
    rows = total.reshape(-1, CELLS)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows))), pa.array([r.tobytes() for r in rows], pa.binary())], names=["part", "counts"])


def _add(table):
    import pyarrow as pa

    total = sum(np.frombuffer(c, np.int64) for c in table.column("counts").to_pylist())
    return pa.table({"part": table.column("part")[:1], "counts": pa.array([total.tobytes()], pa.binary())})


def _prefixes(counts, threshold: float):
    """(id, n, pos, gram) of the prefix of each set, rarest elements first."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        for b in _pieces(batches):
            g, at = _flat(b, "grams")
            n = np.diff(at)
            row = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((g, counts.value[g & (COUNTERS - 1)], row))
            pos = np.arange(len(g)) - at[row]
            least = np.ceil(threshold * n - 1e-9).astype(np.int64)
            keep = pos < (n - least + 1)[row]
            made = [b.column("id").take(pa.array(row[keep])), pa.array(n[row[keep]]), pa.array(pos[keep]), pa.array(g[order][keep])]
            yield pa.RecordBatch.from_arrays(made, names=["id", "n", "pos", "gram"])

    return run


def _repeated(batches) -> Iterator:
    """Rows of a sorted range whose element another row of it has; the range's first and last element may go on outside."""
    import pyarrow as pa

    held, first, carried = None, None, False
    for b in batches:
        if not b.num_rows:
            continue
        table = pa.Table.from_batches([b] if held is None else [held, b]).combine_chunks()
        g = np.asarray(table.column("gram"))
        first = g[0] if first is None else first
        keep = np.zeros(len(g), bool)
        same = g[1:] == g[:-1]
        keep[1:] |= same
        keep[:-1] |= same
        keep |= g == first
        keep[0] |= carried
        # the last row waits for what follows it
        carried = bool(keep[-1])
        yield from table.slice(0, len(g) - 1).filter(pa.array(keep[:-1])).to_batches()
        held = table.slice(len(g) - 1).combine_chunks().to_batches()[0]
    if held is not None:
        yield held


def element_counts(sets: DataFrame) -> np.ndarray:
    """Counters of all elements of ``grams``, added up by Spark; 2 MB whatever the input."""
    rows = sets.select("grams").mapInArrow(_counts, "part bigint, counts binary").groupBy("part").applyInArrow(_add, "part bigint, counts binary")
    total = np.zeros((COUNTERS // CELLS, CELLS), np.int64)
    for r in rows.collect():
        total[r.part] = np.frombuffer(r.counts, np.int64)
    return total.ravel()


def prefix_index(sets: DataFrame, threshold: float) -> DataFrame:
    """(id, n, pos, gram): the prefix elements that at least two of the ``sets`` (id, grams) share."""
    counts = sets.sparkSession.sparkContext.broadcast(element_counts(sets))
    kind = dict(sets.dtypes)["id"]
    schema = f"id {kind}, n bigint, pos bigint, gram bigint"
    index = stored(sets.select("id", "grams").mapInArrow(_prefixes(counts, threshold), schema), "prefixes")
    # sorted ranges of (element, set): an element that very many sets hold is several ranges
    ranges = index.repartitionByRange("gram", "id").sortWithinPartitions("gram", "id")
    return stored(ranges.mapInArrow(_repeated, schema), "prefix-index")


def _least_shared(threshold: float) -> Column:
    """Elements that sets of nx and ny must share to reach the threshold."""
    return F.ceil((F.col("nx") + F.col("ny")) * F.lit(threshold / (1 + threshold)) - F.lit(1e-9))


def _possible(threshold: float) -> Column:
    """Whether sets of nx and ny elements that first meet at positions px and py can still reach the threshold."""
    most = F.least(F.col("px"), F.col("py")) + 1 + F.least(F.col("nx") - F.col("px"), F.col("ny") - F.col("py")) - 1
    return most >= _least_shared(threshold)


def _verified(pairs: DataFrame, prefixes: DataFrame, sets_of: Callable[[DataFrame | None, str], DataFrame], threshold: float) -> DataFrame:
    """The (y, x) pairs whose whole sets reach the threshold; a set with very many partners is split by adaptive execution.

    Of two sets, all shared elements up to the end of the prefix that ends first lie in both ``prefixes`` (id, n, grams);
    the others lie in the rest of that set. Whole sets are cut only for pairs that can still reach the threshold.
    """
    rest = {c: F.ceil(F.col(f"n{c}") * F.lit(threshold) - F.lit(1e-9)) - 1 for c in "xy"}
    most = F.size(F.array_intersect("gx", "gy")) + F.greatest(rest["x"], rest["y"])

    def side(d: DataFrame, name: str) -> DataFrame:
        return d.select(*[F.col(c).alias(name if c == "id" else f"{c[0]}{name}") for c in d.columns])

    both = cut_lineage(pairs).join(side(prefixes, "x"), "x").join(side(prefixes, "y"), "y")
    likely = stored(both.where(most >= _least_shared(threshold)).select("y", "x").distinct(), "likely")
    ids = stored(likely.select(F.explode(F.array("y", "x")).alias("id")).distinct(), "checked")
    sets = stored(sets_of(ids, "left_semi").select("id", "grams"), "sets")
    both = likely.join(side(sets, "x"), "x").join(side(sets, "y"), "y")
    return cut_lineage(both.where(TX.jaccard("gy", "gx") >= threshold).select("y", "x"))


def similar_components(sets_of: Callable[[DataFrame | None, str], DataFrame], threshold: float = 0.8, pivots: int = 1) -> DataFrame:
    """(id, component) of every set: the smallest id among all sets that links of Jaccard >= threshold lead to.

    ``sets_of(ids, how)`` gives (id, grams) of the rows joined with ``ids`` by a left_semi or left_anti join (of all
    rows for None), grams being distinct hashes; ids are unique, and rows without elements are left out. Sets are cut anew from the rows where they are needed,
    because they are larger than what they are cut from.

    1. Equal sets become one vertex, so copies cost one aggregation.
    2. Sets that share a prefix element are compared with the first set of that element (with two ``pivots`` also
       with the last), and linked sets become one component: a family of n similar sets costs n checks.
    3. Sets of one prefix element that still lie in different components are compared pair by pair, which makes the
       result complete. Size and position rule out most pairs, and what prefixes share rules out most others, before any
       set is fetched.
    """
    everything = sets_of(None, "left_semi")
    kind = dict(everything.dtypes)["id"]
    sigs = stored(everything.mapInArrow(_signatures, f"id {kind}, n bigint, sig binary"), "signatures")
    firsts = sigs.groupBy("n", "sig").agg(F.min("id").alias("vertex")).withColumn("key", F.concat("sig", F.encode(F.col("n").cast("string"), "utf-8")))
    firsts = stored(firsts.select("key", "vertex"), "vertices")
    keyed = sigs.select("id", F.concat("sig", F.encode(F.col("n").cast("string"), "utf-8")).alias("key"))
    member_of = stored(skewed_join(keyed, firsts, "key").select("id", "vertex"), "members")
    copies = stored(member_of.where("id <> vertex").select("id"), "copies")
    index = prefix_index(sets_of(copies, "left_anti"), threshold)
    # the shared part of a set's own prefix; rows that repeat an id only make it longer
    prefixes = stored(index.groupBy("id", "n").agg(F.collect_set("gram").alias("grams")), "shared-prefixes")

    def side(d: DataFrame, name: str) -> DataFrame:
        return d.select("gram", F.col("id").alias(name), F.col("n").alias(f"n{name}"), F.col("pos").alias(f"p{name}"), *[F.col("comp").alias(f"c{name}")][: "comp" in d.columns])

    def labelled() -> DataFrame:
        comps = cut_lineage(components(links, "y", "x"))
        named = stored(index.join(comps, "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component"), "labelled")
        spread = named.groupBy("gram").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a < b").select("gram")
        return stored(skewed_join(named, spread, "gram"), "open")  # elements whose sets lie in several components

    links, open_ = None, index
    for i in range(pivots):
        if i and open_.isEmpty():
            break
        choose = F.min_by if i % 2 == 0 else F.max_by
        fields = ["id", "n", "pos", *["comp"][: "comp" in open_.columns]]
        pivot = open_.groupBy("gram").agg(choose(F.struct(*fields), "id").alias("p")).select("gram", "p.*")
        met = skewed_join(side(open_, "y"), side(pivot, "x"), "gram").where(F.col("x") != F.col("y")).where(_possible(threshold))
        met = met.where("cx != cy") if "comp" in fields else met
        found = _verified(met.select(F.greatest("x", "y").alias("y"), F.least("x", "y").alias("x")).distinct(), prefixes, sets_of, threshold)
        links = found if links is None else cut_lineage(links.unionByName(found))
        open_ = labelled()
    if links is None:
        links = index.select(F.col("id").alias("y"), F.col("id").alias("x")).limit(0)
        open_ = index.withColumn("comp", F.col("id"))
    rest = skewed_join(side(open_, "y"), side(open_, "x"), "gram").where("x < y AND cx != cy").where(_possible(threshold))
    found = _verified(rest.select("y", "x").distinct(), prefixes, sets_of, threshold)
    comps = components(links.unionByName(found), "y", "x").withColumnRenamed("id", "vertex")
    return member_of.join(comps, "vertex", "left").select("id", F.coalesce("component", "vertex").alias("component"))
