"""Near-duplicate documents: SuperMinHash signatures, banding, exact verification, connected components."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.llm.common import body, lower_bytes, mix, packs, shingle_hashes, small, store, word_hashes
from siftwork.llm.components import components

SLOTS = 192  # values of a signature
BANDS, ROWS = 38, 5  # a pair shares no band once in 5 billion times at a similarity of 0.85, in 3 million at 0.8
BLOCK_BYTES = 4 << 20  # sets that meet another block in one task
ELEMENTS = 100_000  # shingles that are permuted at once; bounds the table of permutations


def super_minhash(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """Signatures (len(sets) x slots, uint64) of sets of hashes.

    In round j every element draws a fraction and swaps slot j of its own permutation with a later one; the slot
    that comes up gets the smaller of its value and (j, fraction). Ranks of an element are thus correlated over
    slots, and a set whose slots all have values below j is done: larger sets end after a few rounds.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    out = np.full((len(sets), slots), np.iinfo(np.uint64).max, np.uint64)
    flat = out.reshape(-1)
    elements = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.tile(np.arange(slots, dtype=np.uint8), (len(elements), 1))
    for j in range(slots):
        if not len(elements):
            break
        draw = mix(elements + np.uint64((j + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
        k = j + (((draw & np.uint64(0xFFFFFFFF)) * np.uint64(slots - j)) >> np.uint64(32)).astype(np.int64)
        row = np.arange(len(elements))
        slot = order[row, k]
        order[row, k] = order[:, j]
        value = np.uint64(j << 56) | (mix(draw) >> np.uint64(8))
        np.minimum.at(flat, owner * slots + slot, value)
        active = out.max(axis=1) >= np.uint64((j + 1) << 56)
        stay = active[owner]
        if stay.mean() < 0.7:
            elements, owner, order = elements[stay], owner[stay], order[stay]
    return out


def shingle_sets(texts: list[str | None], n: int = 5) -> list[np.ndarray]:
    """Sorted distinct n-word shingle hashes of each text."""
    h, at = word_hashes([lower_bytes(t) for t in texts])
    return [np.unique(shingle_hashes(h[at[i] : at[i + 1]], n)) for i in range(len(texts))]


def _signed(a: np.ndarray) -> np.ndarray:
    return a.astype(np.uint64).view(np.int64)


def set_key(s: np.ndarray) -> int:
    """64-bit key of a set of hashes, independent of order."""
    with np.errstate(over="ignore"):
        return int(_signed(mix(np.array([np.sum(mix(s ^ np.uint64(0xA5A5A5A5)), dtype=np.uint64) + np.uint64(len(s))])))[0])


def band_keys(signatures: np.ndarray) -> np.ndarray:
    h = np.zeros((len(signatures), BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)
    for r in range(ROWS):
        h = mix(h ^ signatures[:, r : BANDS * ROWS : ROWS])
    return h


def sketch(docs: DataFrame, n: int = 5) -> DataFrame:
    """(doc_id, t, n_shingles, v, bits, bands): t is the hash of the row's text, v is the key of the shingle set, NULL for an empty one."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        for b in packs(batches):
            sets = shingle_sets(b.column("text").to_pylist(), n)
            sizes = np.array([len(s) for s in sets])
            group = (np.cumsum(sizes) - sizes) // ELEMENTS
            sig = np.concatenate([super_minhash([sets[i] for i in np.flatnonzero(group == g)]) for g in np.unique(group)])
            full = sizes > 0
            low = np.packbits((sig & np.uint64(1)).astype(np.uint8), axis=1).view(np.int64)
            keys = pa.array([set_key(s) if len(s) else None for s in sets], pa.int64())
            lists = [pa.array([x.tolist() if f else None for x, f in zip(m, full)], pa.list_(pa.int64())) for m in (low, _signed(band_keys(sig)))]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("t"), pa.array(sizes, pa.int64()), keys, *lists],
                names=["doc_id", "t", "n_shingles", "v", "bits", "bands"],
            )

    schema = "doc_id bigint, t bigint, n_shingles bigint, v bigint, bits array<bigint>, bands array<bigint>"
    keyed = docs.select(F.col("doc_id").cast("bigint"), F.xxhash64(body()).alias("t"), F.col("text").cast("string"))
    return keyed.mapInArrow(run, schema)


def _full_sets(docs: DataFrame, n: int) -> DataFrame:
    """(v, words): sorted shingle hashes as bytes, for each row of ``docs``."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        for b in packs(batches):
            sets = shingle_sets(b.column("text").to_pylist(), n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([set_key(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
                names=["v", "words"],
            )

    return docs.select("text").mapInArrow(run, "v bigint, words binary")


def _alone(sets: DataFrame) -> DataFrame:
    """(v, alone): how many shingles of a set no other set has."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        for b in batches:
            v = np.asarray(b.column("v"))
            for i, raw in enumerate(b.column("words").to_pylist()):
                h = np.frombuffer(raw, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.full(len(h), v[i]))], names=["h", "v"])

    rows = sets.mapInArrow(run, "h bigint, v bigint")
    single = rows.groupBy("h").agg(F.count("*").alias("n"), F.min("v").alias("v")).where("n = 1")
    return single.groupBy("v").agg(F.count("*").alias("alone"))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets have 100 * intersection >= percent * union."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            a, b = batch.column("x").to_pylist(), batch.column("y").to_pylist()
            ok = []
            for p, q in zip(a, b):
                p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                ok.append(100 * both >= percent * (len(p) + len(q) - both))
            yield batch.filter(pa.array(ok, pa.bool_())).select(["a", "b"])

    x = sets.select(F.col("v").alias("a"), F.col("words").alias("x"))
    y = sets.select(F.col("v").alias("b"), F.col("words").alias("y"))
    pairs = small(store(pairs.select("a", "b"), "pairs"))
    return x.join(pairs, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def _links_in_block(v: list, comp: list, left: list, right: list, raw: list, percent: int) -> list[tuple[int, int]]:
    """A link for every two components that a left and a right set tie together; more only where they meet anew."""
    root = {c: c for c in comp}

    def find(c):
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    words = [np.frombuffer(r, np.uint64) for r in raw]
    sizes = np.array([len(w) for w in words])
    ids = np.unique(np.concatenate(words), return_inverse=True)[1]
    cut = np.concatenate(([0], np.cumsum(sizes)))
    others = np.concatenate([ids[cut[k] : cut[k + 1]] for k in right])
    begin = np.concatenate(([0], np.cumsum(sizes[right])))[:-1]
    own = np.zeros(int(ids.max()) + 1, np.int32)
    out = []
    for i in left:
        mine = ids[cut[i] : cut[i + 1]]
        own[mine] = 1
        both = np.add.reduceat(own[others], begin)
        own[mine] = 0
        for k in np.flatnonzero(100 * both >= percent * (sizes[i] + sizes[right] - both)).tolist():
            x, y = find(comp[i]), find(comp[right[k]])
            if x != y:
                root[x] = y
                out.append((v[i], v[right[k]]))
    return out


def _family_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that are still missing between different components of one family.

    A family is what buckets connect. Families of one component are done. The others are cut into blocks of about
    BLOCK_BYTES of sets; a task gets two blocks and checks one against the other, so its memory is bounded at any
    size of a family, and only links that join components leave it.
    """
    first = store(members.groupBy("key").agg(F.min("v").alias("a")), "families")
    ties = members.join(first, "key").select("a", F.col("v").alias("b")).where("a <> b")
    family = small(store(components(ties), "families")).select(F.col("node").alias("v"), F.col("root").alias("family"))
    each = store(members.select("v", "comp", "n").distinct().join(family, "v"), "family-members")
    mixed = each.groupBy("family").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.sum("n").alias("all")).where("lo < hi")
    blocks = F.ceil(F.col("all") * 8 / BLOCK_BYTES).cast("int")
    some = each.join(small(store(mixed.select("family", blocks.alias("blocks")), "open-families")), "family")
    some = some.withColumn("own", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int"))
    pairs = some.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = pairs.select("family", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "own", "comp", "v")
    rows = sets.join(small(store(placed, "placed")), "v").repartition("family", "i", "j").sortWithinPartitions("family", "i", "j", "v")

    def run(batches) -> Iterator:
        import pyarrow as pa

        def groups():
            key, held = None, []
            for b in batches:
                for row in zip(*[b.column(c).to_pylist() for c in ("family", "i", "j", "own", "comp", "v", "words")]):
                    if row[:3] != key:
                        if held:
                            yield key, held
                        key, held = row[:3], []
                    held.append(row[3:])
            if held:
                yield key, held

        for (_, i, j), held in groups():
            own, comp, v, raw = map(list, zip(*held))
            left, right = [k for k, o in enumerate(own) if o == i], [k for k, o in enumerate(own) if o == j]
            if left and right and len(set(comp)) > 1:
                found = _links_in_block(v, comp, left, right, raw, percent)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*found)], names=["a", "b"])

    return rows.select("family", "i", "j", "own", "comp", "v", "words").mapInArrow(run, "a bigint, b bigint")


def most_bits(percent: int) -> int:
    """How many of SLOTS one-bit values may differ: seven deviations above the mean at the threshold."""
    p = (1 - percent / 100) / 2
    return int(SLOTS * p + 7 * (SLOTS * p * (1 - p)) ** 0.5) + 1


def _may_link(a: str, b: str, percent: int) -> Column:
    """Whether two sets can still reach the threshold: sizes, shingles of their own, one-bit signatures."""
    n = F.col(f"{a}.n") + F.col(f"{b}.n")
    most = F.least(F.col(f"{a}.shared"), F.col(f"{b}.shared"))
    differ = sum((F.bit_count(F.col(f"{a}.b{i}").bitwiseXOR(F.col(f"{b}.b{i}"))) for i in range(SLOTS // 64)), F.lit(0))
    return (100 * most >= percent * (n - most)) & (differ <= most_bits(percent))


def near_duplicates(docs: DataFrame, percent: int = 85, n: int = 5, pivot_rounds: int = 2) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text).

    Two documents are linked when 100 * intersection >= percent * union of their distinct n-word shingles (A-Z
    lowered; a shorter text is one shingle; NULL, empty or blank text has none and is linked with nothing).
    ``component_id`` is the smallest doc_id that can be reached. Rows with equal ids are compared by their own
    texts. Rows without an id can link others, get the smallest id of their component or NULL, and are kept only
    where the component has no id. Other columns are not read; an empty table gives no rows.

    1. Equal sets become one vertex, so exact copies cost one row each.
    2. Bands give buckets. A set with more shingles of its own (in no other bucketed set) than the threshold
       allows has no link at all and leaves before any pair is made.
    3. Pivot rounds: each vertex proposes one pivot outside its component, the one with which it shares most
       buckets; verified links are contracted. A family of n near copies costs about n checks a round.
    4. Families (sets that buckets connect) of more than one component are checked in full, two bounded blocks of
       sets at a time; a task returns only links that join components.
    Every link is confirmed on whole sets. No bucket or group is gathered in one task.
    """
    return near_duplicate_rows(docs, percent, n, pivot_rounds).drop("t")


def near_duplicate_rows(docs: DataFrame, percent: int = 85, n: int = 5, pivot_rounds: int = 2) -> DataFrame:
    """``near_duplicates`` with t, the hash of the row's text: (doc_id, t) tells rows of one id, or of none, apart."""
    sk = store(sketch(docs, n), "sketch")
    # equal sets have equal sketches, so any row's will do
    per_set = sk.where("v IS NOT NULL").withColumn("_d", F.coalesce("doc_id", F.lit(-1))).groupBy("v")
    fields = [F.min("doc_id").alias("id"), F.min("_d").alias("_d"), F.first("n_shingles").alias("n")]
    vertices = per_set.agg(*fields, F.first("bits").alias("bits"), F.first("bands").alias("bands"))
    bits = [F.get("bits", F.lit(i)).alias(f"b{i}") for i in range(SLOTS // 64)]
    vertices = store(vertices.select("v", "id", "_d", "n", *bits, "bands"), "vertices")
    rows = vertices.select("v", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).where("lo < hi").select("key")
    buckets = store(rows.join(store(shared, "shared-keys"), "key"), "buckets")
    candidates = small(store(vertices.drop("bands", "id").join(buckets.select("v"), "v", "left_semi"), "candidates"))

    texts = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-1)).alias("_d"), F.col("text").cast("string"))
    sets = _full_sets(texts.join(candidates.select("_d"), "_d", "left_semi"), n)
    sets = store(sets.join(candidates.select("v"), "v", "left_semi").dropDuplicates(["v"]), "sets")
    own = _alone(sets).join(candidates, "v", "right").withColumn("shared", F.col("n") - F.coalesce("alone", F.lit(0)))
    open_rows = own.where(100 * F.col("shared") >= percent * F.col("n")).select("v", "n", "shared", "b0", "b1", "b2")
    members = store(buckets.join(small(store(open_rows, "open")), "v"), "open-buckets")

    labels = None
    fields = ["v", "comp", "n", "shared", "b0", "b1", "b2"]

    def labelled() -> DataFrame:
        if labels is None:
            return members.withColumn("comp", F.col("v"))
        found = members.join(small(labels).select(F.col("node").alias("v"), "root"), "v", "left")
        return found.withColumn("comp", F.coalesce("root", "v")).drop("root")

    def contract(pairs: DataFrame) -> tuple[DataFrame | None, bool]:
        links = store(_verified(pairs, sets, percent), "links")
        if links.isEmpty():
            return labels, False
        known = links if labels is None else links.unionByName(labels.select(F.col("node").alias("a"), F.col("root").alias("b")))
        return store(components(known), "labels"), True

    for r in range(pivot_rounds):
        at = labelled()
        order = F.col("v") if r == 0 else F.xxhash64(F.lit(r), "v")
        pivot = at.groupBy("key").agg(F.min_by(F.struct(*fields), order).alias("p")).select("key", "p.*")
        pivot = store(pivot, "pivots")
        near = at.alias("x").join(pivot.alias("p"), "key").where((F.col("x.comp") != F.col("p.comp")) & _may_link("x", "p", percent))
        proposed = near.select(F.col("x.v").alias("a"), F.col("p.v").alias("b")).repartition("a")
        best = proposed.groupBy("a", "b").agg(F.count("*").alias("c"))
        labels, more = contract(best.groupBy("a").agg(F.max_by("b", F.struct("c", "b")).alias("b")))
        if not more:
            break
    links = store(_family_links(labelled(), sets, percent), "links")
    if not links.isEmpty():
        known = [] if labels is None else [labels.select(F.col("node").alias("a"), F.col("root").alias("b"))]
        labels = store(components(reduce(DataFrame.unionByName, known, links)), "labels")

    ids = vertices.select("v", "id")
    if labels is not None:
        named = ids.join(small(labels).withColumnRenamed("node", "v"), "v", "left").withColumn("root", F.coalesce("root", "v"))
        # only components of several sets need their smallest id
        tied = labels.join(ids, F.col("node") == F.col("v")).groupBy("root").agg(F.min("id").alias("least"))
        ids = named.join(small(store(tied, "component-ids")), "root", "left").select("v", F.coalesce("least", "id").alias("id"))
    out = sk.select("doc_id", "t", "n_shingles", "v").join(ids, "v", "left")
    component = F.when(F.col("v").isNull(), F.col("doc_id")).otherwise(F.col("id"))
    return out.select("doc_id", "t", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))
