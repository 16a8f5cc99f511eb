"""Bigram statistics from packed chunks against plain counting."""

import math
import os
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from siftwork.operators import bigrams as B
from siftwork.operators import tokens as K
from siftwork.session import shared_dir


def expected(rows, k=0.5):
    pairs, words = Counter(), set()
    for _, tokens, _ in rows:
        if len(tokens) > 1:
            words |= set(tokens)
            pairs.update(zip(tokens, tokens[1:]))
    total, seen = Counter(), Counter()
    for (p, _), c in pairs.items():
        total[p] += c
        seen[p] += 1
    norm = {p: t + k * len(words) for p, t in total.items()}
    lp = {(p, q): math.log((c + k) / norm[p]) for (p, q), c in pairs.items()}
    h = {p: -(len(words) - seen[p]) * k / norm[p] * math.log(k / norm[p]) for p in total}
    for (p, q), x in lp.items():
        h[p] -= math.exp(x) * x
    by = defaultdict(list)
    for i, tokens, mask in rows:
        by[i] += [(lp[p, q], h[p], m) for p, q, m in zip(tokens, tokens[1:], mask[1:])]
    out = {}
    for i, r in by.items():
        r = [x for x in r if x[2]] or r
        if r:
            l, e = np.array([x[0] for x in r]), np.array([x[1] for x in r])
            out[i] = (-l.mean(), l.std(), -l.min(), math.exp(min(-l.mean(), 20)), l.mean(), e.mean(), e.max())
    return out


def test_statistics_over_chunks_equal_plain_counting(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(300):
        tokens = ["<s>", *(f"w{int(x)}" for x in rng.zipf(1.4, int(rng.integers(0, 40))) % 500)]
        rows.append((i // 2 if i % 5 == 0 else i, tokens, [int(x) for x in rng.integers(0, 2, len(tokens))] if i % 3 else [0] * len(tokens)))
    rows += [(None, ["a", "b"], [1, 1]), (None, ["b", "c", "a"], [0, 0, 0]), (900, [], []), (901, ["only"], [1])]
    d = spark.createDataFrame(rows, "sample_id bigint, tokens array<string>, mask array<int>").repartition(5)
    got = {r["sample_id"]: tuple(r[c] for c in K.MODEL_STATS) for r in K.token_stats(d).collect()}
    want = expected(rows)
    assert got.keys() == want.keys()
    assert all(np.allclose(got[i], want[i], atol=1e-9) for i in want)
    assert K.token_stats(d.limit(0)).count() == 0


def test_chunks_keep_every_row(monkeypatch):
    monkeypatch.setattr(B, "CHUNK", 10)
    sizes = [3, 4, 2, 25, 1, 9, 9, 2, 2]
    rows = pa.table({"id": list(range(len(sizes))), "words": [[i] * n for i, n in enumerate(sizes)], "mask": [[True] * n for n in sizes]})
    out = list(B._chunks(rows.to_batches(max_chunksize=4)))
    assert [i for b in out for i in b.column("id").to_pylist()] == list(range(len(sizes)))
    assert all(len(B._flat(b.column("words"))[0]) <= 10 or b.num_rows == 1 for b in out) and len(out) < len(sizes)


def test_bigrams_are_stored_packed(spark):
    def used():
        return sum(os.path.getsize(os.path.join(p, f)) for p, _, fs in os.walk(shared_dir(spark).removeprefix("file:")) for f in fs)

    rng = np.random.default_rng(4)
    rows = [(i, [f"word{int(x)}" for x in rng.integers(0, 3000, 300)], [1] * 300) for i in range(1000)]
    d = spark.createDataFrame(rows, "sample_id bigint, tokens array<string>, mask array<int>").coalesce(1)
    before = used()
    assert K.token_stats(d).count() == 1000
    assert used() - before < 16 * 299 * 1000


def test_bigrams_are_not_stored_and_chunks_follow_no_order_of_rows(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, [f"word{int(x)}" for x in rng.integers(0, 300, 30)], [1] * 30) for i in range(200)]
    d = spark.createDataFrame(rows, "sample_id bigint, tokens array<string>, mask array<int>")
    packed, real = [], type(d).mapInArrow
    monkeypatch.setattr(type(d), "mapInArrow", lambda self, f, schema: packed.append(self) or real(self, f, schema))
    before = sum(len(fs) for _, _, fs in os.walk(shared_dir(spark).removeprefix("file:")))
    for ascending in (True, False):
        assert K.token_stats(d.orderBy("sample_id", ascending=ascending).coalesce(1)).count() == 200
    assert sum(len(fs) for _, _, fs in os.walk(shared_dir(spark).removeprefix("file:"))) == before
    first, second = ([r["id"] for r in p.select("id").collect()] for p in packed)
    assert first == second
