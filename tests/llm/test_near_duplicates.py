import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F
from samples import sentence

from siftwork.llm import components as cc
from siftwork.llm import near_dedup as nd
from siftwork.llm.common import lower_bytes, shingle_hashes, word_hashes
from siftwork.llm.components import components


def shingles(t):
    w = lower_bytes(t).split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def expected(rows, percent=85):
    """Components by checking all pairs of rows; ids of a component's rows count, rows without one do not."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    out = []
    for i, (d, _) in enumerate(rows):
        c = least.get(find(i)) if sets[i] else d
        out.append((d, len(sets[i]), c, c == d))
    return sorted(out, key=repr)


def edited(text, k, seed):
    """k words replaced."""
    w, r = text.split(" "), random.Random(seed)
    for i in r.sample(range(len(w)), k):
        w[i] = f"new{seed}x{i}"
    return " ".join(w)


def run(make, rows, **options):
    return sorted([tuple(r) for r in nd.near_duplicates(make(rows), **options).collect()], key=repr)


def test_odd_rows(make, odd_rows):
    assert run(make, odd_rows) == expected(odd_rows)


@pytest.mark.parametrize("block", [4 << 20, 9_000])
def test_families_and_chains(make, monkeypatch, block):
    monkeypatch.setattr(nd, "BLOCK_BYTES", block)
    base = sentence(40, 150)
    rows = [(1000 - i, edited(base, i % 6, i)) for i in range(60)]  # hubs, spokes and rows just outside
    chain = sentence(41, 120)
    for i in range(12):  # each is linked with its neighbours only
        rows.append((i, chain))
        chain = edited(chain, 1, 500 + i)
    rows += [(2000 + i, sentence(100 + i, 40)) for i in range(30)]
    rows += [(3000 + i, sentence(77, 30) + " " + sentence(200 + i, 30)) for i in range(20)]  # half in common
    if block > 10_000:
        assert run(make, rows) == expected(rows)
    else:  # without pivots the blocks alone find every link
        assert run(make, rows, percent=80, pivot_rounds=0) == expected(rows, 80)


def test_many_exact_copies(make):
    rows = [(i, sentence(9, 50)) for i in range(3, 400)]
    got = run(make, rows)
    assert {c for _, _, c, _ in got} == {3} and sum(k for *_, k in got) == 1


def test_no_links_and_empty(make):
    assert run(make, []) == []
    assert run(make, [(5, None), (6, "")]) == [(5, 0, 5, True), (6, 0, 6, True)]
    rows = [(i, sentence(i, 30)) for i in range(6)]
    assert run(make, rows) == expected(rows)


def test_signature_estimates_similarity():
    r = np.random.default_rng(1)
    pool = r.integers(0, 2**63, 3000, dtype=np.uint64)
    errors = []
    for share in (0.2, 0.5, 0.8, 0.9):
        n = int(1000 * share)
        a, b = pool[:1000], np.concatenate((pool[:n], pool[2000 : 2000 + 1000 - n]))
        true = n / (2000 - n)
        sig = nd.super_minhash([a, b])
        errors.append(abs((sig[0] == sig[1]).mean() - true))
    assert max(errors) < 0.12


def test_signatures_do_not_depend_on_company():
    r = np.random.default_rng(2)
    sets = [r.integers(0, 2**63, n, dtype=np.uint64) for n in (1, 2, 7, 50, 700)]
    together = nd.super_minhash(sets)
    for i, s in enumerate(sets):
        assert (nd.super_minhash([s])[0] == together[i]).all()
        assert (together[i] >> np.uint64(56)).max() < nd.SLOTS


@pytest.mark.parametrize("piece", [16, 1 << 21])
def test_word_hashes_in_pieces(monkeypatch, piece):
    from siftwork.llm import common

    texts = [b"", b"  a bb\tccc\n", b"x" * 100 + b" y", "é ü".encode(), b"\x0b\x0c", b"a bb"]
    want = common.word_hashes(texts)
    monkeypatch.setattr(common, "PIECE", piece)
    h, at = word_hashes(texts)
    assert (h == want[0]).all() and (at == want[1]).all()
    assert np.diff(at).tolist() == [len(t.split()) for t in texts]
    assert h[0] == h[at[5]] and len(set(h.tolist())) == 7
    assert len(shingle_hashes(h[:3], 5)) == 1


@pytest.mark.parametrize("local", [1_000_000, 20])
def test_components(spark, monkeypatch, local):
    monkeypatch.setattr(cc, "LOCAL_EDGES", local)
    edges = [(1, 2), (2, 3), (3, 4), (9, 8), (8, 7), (5, 5)] + [(100, i) for i in range(101, 160)] + [(i, i + 1) for i in range(200, 240)]
    out = components(spark.createDataFrame(edges, "a bigint, b bigint"))
    got = {r.node: r.root for r in out.collect()}
    assert got[4] == 1 and got[9] == 7 and got[159] == 100 and got[240] == 200 and 5 not in got
    assert out.count() == out.select("node").distinct().count()
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
    assert out.where(F.col("root") > F.col("node")).count() == 0
