import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from siftwork.llm import source_divergence as sv

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def expected(rows, min_docs, top):
    """(lang, source, part, item, value, rank) straight from the definition; rows are (lang, source, text)."""
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        found = TERM.findall(low(text or ""))
        count[lang, source].update(found)
        docs[lang].update(set(found))
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        whole = sum((count[lang, s] for s in sources), Counter())

        def shares(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p, q = {s: shares(count[lang, s]) for s in sources}, shares(whole)
        for s in sources:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            leads = [(q[t] - p[s][t], t) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for part, listed in (("pair", pairs), ("term", leads)):
                listed = sorted(listed, key=lambda x: (x[0], x[1].encode()))
                out += [(lang, s, part, i, -v, r) for r, (v, i) in enumerate(listed, 1) if part == "pair" or r <= top]
    return sorted(out)


def rows_of(seed=0, n=260):
    r = np.random.default_rng(seed)
    words = [f"w{chr(97 + i % 26)}{'é' * (i % 3)}{chr(65 + i // 26)}" for i in range(120)]
    out = []
    for i in range(n):
        lang = ["de", "en", None, "xx"][min(3, int(r.exponential(0.8)))]
        source = None if r.random() < 0.1 else f"s{int(r.exponential(2))}"
        k = int(r.integers(0, 40))
        out.append((lang, source, " 7,".join(words[int(w) % 120] for w in r.zipf(1.4, k))))
    out += [("de", "s0", out[0][2])] * 20  # copies
    out += [("fr", "only", "bonjour"), ("it", "a", None), ("it", "b", ""), ("it", "c", "1 2 3"), (None, None, None)]
    return out


def run(spark, rows, min_docs=6, top=5):
    data = [(s, t, 1, "x", lang) for lang, s, t in rows]
    df = spark.createDataFrame(data, "source string, text string, rank bigint, term string, lang string").repartition(3)
    return sorted(tuple(r) for r in sv.source_divergence(df, min_docs, top).collect())


@pytest.mark.parametrize("block,cut", [(1024, 128), (9, 2)])
def test_matches_the_definition(spark, monkeypatch, block, cut):
    monkeypatch.setattr(sv, "BLOCK", block)
    monkeypatch.setattr(sv, "SLICE", cut)
    monkeypatch.setattr(sv, "HELD", 1024 if block > 9 else 7)
    rows = rows_of()
    assert run(spark, rows) == expected(rows, 6, 5)


def test_no_kept_terms_and_no_rows(spark):
    rows = rows_of(1, 30)
    assert run(spark, rows, min_docs=1000) == expected(rows, 1000, 5)
    assert run(spark, []) == []


def test_long_text_is_cut_between_terms(monkeypatch):
    monkeypatch.setattr(sv, "PIECE", 5)
    text = "Alpha beta--gammaé delta x " * 7
    assert [t.decode() for part in sv._terms(text.encode()) for t in part] == TERM.findall(low(text))


def test_equal_subtrees_are_one_node_and_pairs_are_priced_once():
    r = np.random.default_rng(2)
    counts = r.integers(0, 3, (6, 37))
    counts[3] = counts[1]
    counts[4] = 0
    trees = sv.ConsedTrees(counts)
    assert trees.roots[3] == trees.roots[1]
    assert trees.nodes(len(trees.children)) == 5  # six rows, two of them equal
    price = np.stack([sv.shares(trees.values, int(c.sum()), 37) for c in counts])
    walk = sv.Traversal(trees, 1, np.array([3, 4, 5]))
    assert len(walk.a) <= 3 * 16  # at most (0..2, filling) squared a pair of rows, whatever the width
    gap = price[1][walk.a] - price[np.array([3, 4, 5])[walk.slot], walk.b]
    sums = walk.fold(np.abs(gap), np.add)[-1]
    own = [sv.shares(c, int(c.sum()), 37) for c in counts]
    assert sums.tolist() == [int(np.abs(own[1] - own[b]).sum()) for b in (3, 4, 5)]
    place, value = walk.places(walk.fold(np.maximum(np.where(walk.slot == 2, gap, 0), 0), np.maximum), 2)
    true = {i: int(d) for i, d in enumerate(own[1] - own[5]) if d > 0}
    assert dict(zip(place.tolist(), value.tolist())) == true


def test_shares_are_exact_beyond_64_bits():
    big = 10**14
    out = sv.shares(np.array([-1, 0, big]), 3 * big, 7)
    assert out.tolist() == [0, 1 + 5 * 10**9 // (3 * big + 35), 1 + 10**9 * (big + 5) // (3 * big + 35)]
