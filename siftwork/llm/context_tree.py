"""Language-model scores by context-tree weighting over bytes, next to a smoothed unigram base."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.llm.common import body, lower_bytes, packs, store, word_hashes

DEPTH = 5  # bytes of the longest context
CUTS = (3, 1)  # bytes of context that the roots of the lower and of the middle forests have
BLOCK = 1 << 15  # rows of whole forests that are weighed at once
FREQUENT = 1 << 20  # at most so many words have their counts broadcast
COMMON = 1 << 20  # at most so many bytes below contexts have their probabilities broadcast
PIECE = 1 << 20  # bytes of text that a task works on at once
CACHE = 1 << 20  # values that a task counts before it passes them on


def _contexts(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For each byte, and for the end (a zero byte) of each text, that byte below its ``depth`` bytes of context.

    Texts begin in a context of zero bytes. Also the text each entry belongs to.
    """
    pad = b"\0" * depth
    data = np.frombuffer(b"".join(pad + t + b"\0" for t in texts), np.uint8).astype(np.uint64)
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    start = np.cumsum(sizes + depth) - sizes
    owner = np.repeat(np.arange(len(texts)), sizes)
    at = np.repeat(start - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(owner))
    grams = np.zeros(len(data), np.uint64)
    for back in range(depth + 1):
        grams[back:] |= data[: len(data) - back] << np.uint64(8 * back)
    return grams[at], owner


def _sum_by_key(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    k, inverse = np.unique(keys, return_inverse=True)
    return k, np.bincount(inverse, counts, len(k)).astype(np.int64)


def _counted(column: str, values) -> object:
    """A task's own counts of the uint64 values of its texts, merged as it goes."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        keys, counts = np.empty(0, np.uint64), np.empty(0, np.int64)

        def out():
            for a in range(0, len(keys), 1 << 18):
                part = slice(a, a + (1 << 18))
                yield pa.RecordBatch.from_arrays([pa.array(keys[part].view(np.int64)), pa.array(counts[part])], names=[column, "n"])

        for b in packs(batches, PIECE):
            k, c = np.unique(values([lower_bytes(t) for t in b.column("text").to_pylist()]), return_counts=True)
            keys, counts = _sum_by_key(np.concatenate((keys, k)), np.concatenate((counts, c)))
            if len(keys) > CACHE:
                yield from out()
                keys, counts = keys[:0], counts[:0]
        yield from out()

    return run


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after moving the argument up by eight."""
    x = x.astype(float)
    shift = np.ones_like(x)
    for i in range(8):
        shift *= x + i
    shift = np.log(shift)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov block probability of so many zeros and ones."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - np.log(np.pi) - log_gamma(zeros + ones + 1.0)


def build_tree(nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The weighted tree from nodes (sorted keys, zeros, ones) of each depth.

    A byte is eight binary decisions; a node is a context and the bits of the byte decided so far. Bottom-up, a node's
    weighted probability is half its own estimate and half the product of its children's (contexts that were
    left out count as one more child). Top-down this gives, for each node, the mixture of the estimates of all its
    suffix contexts with itself as the last one: (node keys, probability of a one), by depth.
    """

    def parents(d: int) -> np.ndarray:
        return np.searchsorted(nodes[d - 1][0], nodes[d][0] & np.uint64((1 << (8 * d)) - 1))

    own = [log_kt(z, o) for _, z, o in nodes]
    weighted = list(own)
    stay = [np.ones(len(k)) for k, _, _ in nodes]
    for d in range(len(nodes) - 2, -1, -1):
        up, n = parents(d + 1), len(nodes[d][0])
        rest = [nodes[d][i] - np.bincount(up, nodes[d + 1][i], n) for i in (1, 2)]
        below = np.bincount(up, weighted[d + 1], n) + log_kt(np.maximum(rest[0], 0), np.maximum(rest[1], 0))
        weighted[d] = np.logaddexp(own[d], below) - np.log(2)
        stay[d] = np.exp(own[d] - np.log(2) - weighted[d])
    out, sofar, left = [], None, None
    for d, (key, zeros, ones) in enumerate(nodes):
        p = (ones + 0.5) / (zeros + ones + 1.0)
        if d:
            up = parents(d)
            sofar, left = sofar[up], left[up]
        else:
            sofar, left = np.zeros(len(key)), np.ones(len(key))
        out.append((key, (sofar + left * p).astype(np.float32)))
        sofar, left = sofar + left * stay[d] * p, left * (1 - stay[d])
    return out


def log10_bytes(tree: list[tuple[np.ndarray, np.ndarray]], grams: np.ndarray) -> np.ndarray:
    """log10 probability of each byte below its context: bit by bit, from the deepest context that knows the bits so far."""
    context, byte = grams >> np.uint64(8), grams & np.uint64(255)
    total = np.zeros(len(grams))
    for i in range(8):
        prefix = np.uint64(1 << i) | (byte >> np.uint64(8 - i))
        one = np.full(len(grams), 0.5)
        open_ = np.arange(len(grams))
        for d in range(len(tree) - 1, -1, -1):
            keys, p = tree[d]
            if not len(open_) or not len(keys):
                continue
            key = ((context[open_] & np.uint64((1 << (8 * d)) - 1)) << np.uint64(8)) | prefix[open_]
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = keys[at] == key
            one[open_[hit]] = p[at[hit]].astype(float)
            open_ = open_[~hit]
        up = (byte >> np.uint64(7 - i)) & np.uint64(1) == 1
        total += np.log10(np.maximum(np.where(up, one, 1 - one), 1e-9))
    return total


def _as_arrays(df: DataFrame, *columns: str) -> tuple[np.ndarray, ...]:
    """Columns of a bounded table, in the (unsigned) order of the first one."""
    t = df.select(*columns).toArrow()
    key = t.column(0).to_numpy().view(np.uint64)
    order = np.argsort(key)
    return key[order], *[t.column(c).to_numpy()[order] for c in columns[1:]]


def fit_tree(train: DataFrame, depth: int = DEPTH) -> list[tuple[np.ndarray, np.ndarray]]:
    """The weighted tree of all texts of ``train`` in one process: for small tables. ``score_texts`` works in parts."""
    counted = train.select("text").mapInArrow(_counted("g", lambda t: _contexts(t, depth)[0]), "g bigint, n bigint")
    grams, n = _as_arrays(counted.groupBy("g").agg(F.sum("n").alias("n")), "g", "n")
    grams, levels = grams.view(np.int64), []
    for d in range(depth + 1):
        key, _, zeros, ones = _nodes(grams & ((1 << (8 * d + 8)) - 1), n)
        levels.append((key.view(np.uint64), zeros, ones))
    return build_tree(levels)


def _nodes(grams: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nodes of bytes below contexts: sorted keys, the node of each bit (8 rows of grams), zeros and ones."""
    context, byte = grams & ~255, grams & 255
    each = np.concatenate([context | (1 << i) | (byte >> (8 - i)) for i in range(8)])
    bit = np.concatenate([(byte >> (7 - i)) & 1 for i in range(8)])
    key, at = np.unique(each, return_inverse=True)
    seen, ones = np.bincount(at, np.tile(n, 8), len(key)), np.bincount(at, np.tile(n, 8) * bit, len(key))
    return key, at, seen - ones, ones


def weigh(key: np.ndarray, zeros: np.ndarray, ones: np.ndarray, weighted: np.ndarray, depth: int, cut: int) -> list[tuple]:
    """Levels of the forest between nodes of ``depth`` and their suffixes of ``cut`` bytes, deepest first.

    Each is (sorted keys, zeros, ones, log weighted probability, share that stays, node of each child).
    """
    levels = [(key, zeros, ones, weighted, None, None)]
    for d in range(depth - 1, cut - 1, -1):
        below, z, o, w, _, _ = levels[-1]
        k, up = np.unique(below & ((1 << (8 * d + 8)) - 1), return_inverse=True)
        z, o, w = (np.bincount(up, v, len(k)) for v in (z, o, w))
        own = log_kt(z, o)
        w = np.logaddexp(own, w) - np.log(2)
        levels.append((k, z, o, w, np.exp(own - np.log(2) - w), up))
    return levels


def descend(levels: list[tuple], sofar: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The mixture above each deepest node and the weight that is left, from those of the roots.

    A node that no training text has is not mixed in: it gets what its parent has, and no weight.
    """
    for (_, z, o, _, stay, up), child in zip(levels[:0:-1], levels[-2::-1]):
        p, seen = (o + 0.5) / (z + o + 1.0), child[1] + child[2] > 0
        whole, down = sofar + left * p, sofar + left * stay * p
        sofar, left = np.where(seen, down[up], whole[up]), np.where(seen, (left * (1 - stay))[up], 0.0)
    return sofar, left


def _runs(batches, columns: list[str], keys: list[str], limit: int = BLOCK) -> Iterator[dict[str, np.ndarray]]:
    """Rows sorted by ``keys`` in blocks of about ``limit`` rows; rows of one key stay together."""
    held, n, wanted = [], 0, limit
    for b in batches:
        held.append([b.column(c).to_numpy(zero_copy_only=False) for c in columns])
        n += b.num_rows
        if n < wanted:
            continue
        whole = dict(zip(columns, (np.concatenate(c) for c in zip(*held))))
        new = np.flatnonzero(np.any([np.diff(whole[k]) != 0 for k in keys], axis=0))
        at = int(new[-1]) + 1 if len(new) else 0
        if at:
            yield {c: v[:at] for c, v in whole.items()}
        held, n = [[whole[c][at:] for c in columns]], n - at
        wanted = max(limit, 2 * n)
    if n:
        yield dict(zip(columns, (np.concatenate(c) for c in zip(*held))))


def _rows(**columns) -> Iterator:
    import pyarrow as pa

    n = len(next(iter(columns.values())))
    for a in range(0, n, 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(v[a : a + (1 << 16)]) for v in columns.values()], names=list(columns))


def gram_logs(grams: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(g, m, log10 probability) of the bytes below contexts in ``grams`` (g, n, m), from their counts n in training.

    Every node is kept. Nodes whose contexts end in the same three bytes form a forest of their own, and so do, for
    the same bits, those of two and three bytes that end in the same one; each is weighed by one task, bottom-up and
    then top-down. Above them are at most 65,280 nodes, which are weighed here. A forest's size is bounded by its
    alphabet (2^24 bytes below contexts), not by the corpus. Rows with m = 0 are left out of the result.
    """
    low, high = (min(c, depth) for c in CUTS)
    mask = (1 << (8 * low)) - 1
    rooted = grams.withColumn("root", F.shiftright("g", 8).bitwiseAND(F.lit(mask)))
    kinds = "key bigint, zeros double, ones double, weighted double"

    def forest(g: np.ndarray, n: np.ndarray) -> tuple[list[tuple], np.ndarray]:
        key, at, zeros, ones = _nodes(g, n)
        return weigh(key, zeros, ones, log_kt(zeros, ones), depth, low), at

    def lower_up(batches) -> Iterator:
        for x in _runs(batches, ["root", "g", "n"], ["root"]):
            yield from _rows(**dict(zip(("key", "zeros", "ones", "weighted"), forest(x["g"], x["n"])[0][-1])))

    def middle(x: dict) -> list[tuple]:
        order = np.argsort(x["key"])
        return weigh(*(x[c][order] for c in ("key", "zeros", "ones", "weighted")), low, high)

    def middle_up(batches) -> Iterator:
        for x in _runs(batches, fields, ["top"]):
            yield from _rows(**dict(zip(("key", "zeros", "ones", "weighted"), middle(x)[-1])))

    fields = ["top", "key", "zeros", "ones", "weighted"]
    dealt = rooted.select("root", "g", "n").repartition("root").sortWithinPartitions("root")
    nodes = store(dealt.mapInArrow(lower_up, kinds), "nodes")
    nodes = nodes.withColumn("top", F.col("key").bitwiseAND(F.lit((1 << (8 * high + 8)) - 1)))
    nodes = nodes.repartition("top").sortWithinPartitions("top").select(*fields)
    tops = nodes.mapInArrow(middle_up, kinds).toArrow()
    order = np.argsort(tops.column("key").to_numpy())
    levels = weigh(*(tops.column(c).to_numpy()[order] for c in fields[1:]), high, 0)
    seen = levels[-1][1] + levels[-1][2] > 0
    above = (levels[0][0], *descend(levels, np.where(seen, 0.0, 0.5), np.where(seen, 1.0, 0.0)))

    def middle_down(batches) -> Iterator:
        for x in _runs(batches, fields, ["top"]):
            levels = middle(x)
            at = np.searchsorted(above[0], levels[-1][0])
            sofar, left = descend(levels, above[1][at], above[2][at])
            key = levels[0][0]
            yield from _rows(root=key >> 8, prefix=key & 255, sofar=sofar, left=left)

    def lower_down(batches) -> Iterator:
        for x in _runs(batches, ["root", "g", "n", "m", "prefix", "sofar", "left"], ["root"]):
            state, row = x["prefix"] > 0, x["prefix"] == 0
            g = x["g"][row]
            levels, at = forest(g, x["n"][row])
            order = np.argsort(x["root"][state] << 8 | x["prefix"][state])
            sofar, left = descend(levels, x["sofar"][state][order], x["left"][state][order])
            _, zeros, ones, *_ = levels[0]
            one = (sofar + left * (ones + 0.5) / (zeros + ones + 1.0))[at].reshape(8, -1)
            bits = np.stack([(g >> (7 - i)) & 1 for i in range(8)]) == 1
            logs = np.log10(np.maximum(np.where(bits, one, 1 - one), 1e-9)).sum(axis=0)
            use = x["m"][row] > 0
            yield from _rows(g=g[use], m=x["m"][row][use], log=logs[use])

    none, zero = F.lit(0).cast("bigint"), F.lit(0.0)
    states = nodes.mapInArrow(middle_down, "root bigint, prefix bigint, sofar double, left double")
    states = states.select("root", none.alias("g"), none.alias("n"), none.alias("m"), "prefix", "sofar", "left")
    both = rooted.select("root", "g", "n", "m", none.alias("prefix"), zero.alias("sofar"), zero.alias("left")).unionByName(states)
    both = both.repartition("root").sortWithinPartitions("root")
    return store(both.mapInArrow(lower_down, "g bigint, m bigint, log double"), "probabilities")


def _least(counted: DataFrame, column: str, rows: int) -> int:
    """A count that at most ``rows`` rows reach, from the sizes of classes of counts (eight for each factor of two)."""
    classes = counted.groupBy(F.floor(8 * F.log2(column)).alias("c")).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi"))
    least, left = 1, rows
    for _, n, lo, hi in sorted(classes.collect(), reverse=True):
        left -= n
        if left < 0:
            return hi + 1
        least = lo
    return least


def _word_values(texts: list[bytes]) -> np.ndarray:
    return word_hashes(texts)[0]


def score_texts(docs: DataFrame, train: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) for every row of ``docs``.

    A-Z is lowered in both models. ``score`` is the tree's log10 probability of a text's bytes and its end.
    ``base_score`` adds log10((c + 0.5) / (N + 0.5 (V + 1))) over the words and the end, from counts of ``train``.
    NULL and empty texts have the end only; rows with equal ids are scored apart; other columns are not read; an
    empty table gives no rows, and without training rows every bit has probability one half.

    Word counts of at most FREQUENT words (those with that share of all tokens) and the log probabilities of the COMMON
    most frequent bytes below contexts are broadcast; all others are joined.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    narrow_grams = _counted("g", lambda t: _contexts(t, depth)[0])
    zero = F.lit(0).cast("bigint")
    trained = train.select("text").mapInArrow(narrow_grams, "g bigint, n bigint").select("g", "n", zero.alias("m"))
    asked = docs.select("text").mapInArrow(narrow_grams, "g bigint, n bigint").select("g", zero.alias("n"), F.col("n").alias("m"))
    grams = trained.unionByName(asked).groupBy("g").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    logs = gram_logs(store(grams, "contexts"), depth)
    often = _least(logs, "m", COMMON)
    tree = spark.sparkContext.broadcast(_as_arrays(logs.where(F.col("m") >= often), "g", "log"))
    words = store(train.select("text").mapInArrow(_counted("w", _word_values), "w bigint, n bigint").groupBy("w").agg(F.sum("n").alias("n")), "words")
    ends = train.count()
    n_words, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    tokens, vocabulary = n_words + ends, distinct + (ends > 0)
    least = max(1, -(-n_words // FREQUENT))
    common = spark.sparkContext.broadcast(_as_arrays(words.where(F.col("n") >= least), "w", "n"))
    scale = float(np.log10(tokens + 0.5 * (vocabulary + 1)))

    def known(h: np.ndarray) -> np.ndarray:
        keys, counts = common.value
        if not len(keys):
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return np.where(keys[at] == h, counts[at], 0)

    def evaluated(grams: np.ndarray, missing: float) -> np.ndarray:
        keys, value = tree.value
        if not len(keys):
            return np.full(len(grams), missing)
        unique, inverse = np.unique(grams, return_inverse=True)
        at = np.minimum(np.searchsorted(keys, unique), len(keys) - 1)
        return np.where(keys[at] == unique, value[at], missing)[inverse]

    def score(batches) -> Iterator:
        for b in packs(batches, PIECE):
            texts = [lower_bytes(t) for t in b.column("text").to_pylist()]
            grams, owner = _contexts(texts, depth)
            total = np.bincount(owner, evaluated(grams, 0.0), len(texts))
            h, start = word_hashes(texts)
            c = known(h)
            doc = np.repeat(np.arange(len(texts)), np.diff(start))
            frequent = c > 0
            base = np.bincount(doc[frequent], np.log10(c[frequent] + 0.5), len(texts)) + np.log10(ends + 0.5)
            sure = np.bincount(doc[frequent], minlength=len(texts)) + int(ends > 0)
            n = np.diff(start) + 1
            arrays = [b.column("doc_id"), b.column("t"), pa.array(n), pa.array(sure.astype(np.int64)), pa.array(base - n * scale), pa.array(total), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "t", "n_tokens", "sure", "base", "score", "n_bytes"])

    def counted(b, doc: np.ndarray, value: np.ndarray, name: str):
        """How often each text of a piece has each value."""
        order = np.lexsort((value, doc))
        value, doc = value[order], doc[order]
        head = np.ones(len(value), bool)
        head[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
        at = np.flatnonzero(head)
        ids, ts = np.asarray(b.column("doc_id")), np.asarray(b.column("t"))
        arrays = [pa.array(ids[doc[at]]), pa.array(ts[doc[at]]), pa.array(value[at].view(np.int64)), pa.array(np.diff(np.append(at, len(value))))]
        return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "t", name, "tf"])

    def rare(batches) -> Iterator:
        for b in packs(batches, PIECE):
            h, start = word_hashes([lower_bytes(t) for t in b.column("text").to_pylist()])
            doc = np.repeat(np.arange(b.num_rows), np.diff(start))
            use = known(h) == 0
            yield counted(b, doc[use], h[use], "w")

    def rare_grams(batches) -> Iterator:
        for b in packs(batches, PIECE):
            grams, owner = _contexts([lower_bytes(t) for t in b.column("text").to_pylist()], depth)
            use = evaluated(grams, 1.0) > 0
            yield counted(b, owner[use], grams[use], "g")

    missing = F.lit(-(1 << 63)).cast("bigint")
    narrow = docs.select(
        F.coalesce(F.col("doc_id").cast("bigint"), missing).alias("doc_id"), F.xxhash64(body()).alias("t"), F.col("text").cast("string")
    )
    scored = store(narrow.mapInArrow(score, "doc_id bigint, t bigint, n_tokens bigint, sure bigint, base double, score double, n_bytes bigint"), "scored")
    if often > 1:
        some = narrow.mapInArrow(rare_grams, "doc_id bigint, t bigint, g bigint, tf bigint")
        some = some.join(logs.where(F.col("m") < often), "g").groupBy("doc_id", "t").agg(F.sum(F.col("tf") * F.col("log")).alias("deep"))
        deep = store(some, "rare-contexts")
    else:
        deep = None
    tree.destroy()
    left = narrow.mapInArrow(rare, "doc_id bigint, t bigint, w bigint, tf bigint")
    n = F.coalesce("n", F.lit(0))
    joined = left.join(words.where(F.col("n") < least), "w", "left")
    sums = joined.groupBy("doc_id", "t").agg(
        F.sum(F.col("tf") * F.log10(n + 0.5)).alias("more"), F.sum(F.when(n > 0, F.col("tf")).otherwise(0)).alias("found")
    )
    sums = store(sums, "rare-words")
    common.destroy()
    copies = scored.groupBy("doc_id", "t").agg(F.count("*").alias("copies"))
    extra = sums.join(copies, ["doc_id", "t"])
    out = scored.join(extra, ["doc_id", "t"], "left")
    if deep is not None:
        share = deep.join(copies.withColumnRenamed("copies", "of"), ["doc_id", "t"]).select("doc_id", "t", (F.col("deep") / F.col("of")).alias("deep"))
        out = out.join(share, ["doc_id", "t"], "left").withColumn("score", F.col("score") + F.coalesce("deep", F.lit(0.0)))
    more = F.coalesce(F.col("more") / F.col("copies"), F.lit(0.0))
    found = F.coalesce((F.col("found") / F.col("copies")).cast("bigint"), F.lit(0))
    return out.select(
        F.when(F.col("doc_id") != missing, F.col("doc_id")).alias("doc_id"),
        "n_tokens",
        (F.col("sure") + found).alias("n_known"),
        F.lit(tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"),
        "score",
        (-F.col("score") / F.lit(float(np.log10(2))) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )
