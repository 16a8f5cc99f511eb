import math
from collections import Counter
from zlib import crc32

import numpy as np
from samples import sentence

from siftwork.llm import context_tree as ct
from siftwork.llm.common import id_remainder, lower_bytes
from siftwork.llm.quality import fit_rules, labelled_rows, score_quality


def base_score(rows, train):
    count = Counter()
    for _, t in train:
        count.update([*lower_bytes(t).split(), None])
    n, v = sum(count.values()), len(count)
    out = []
    for i, t in rows:
        tokens = [*lower_bytes(t).split(), None]
        s = sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)
        out.append((str(i), len(tokens), sum(count[w] > 0 for w in tokens), n, round(s, 6)))
    return sorted(out)


def test_base_against_counting(make, odd_rows, monkeypatch):
    rows = odd_rows + [(100 + i, sentence(i, 20)) for i in range(40)]
    docs = make(rows)
    train = [(i, t) for i, t in rows if crc32(("" if i is None else str(i)).encode()) % 5 != 1]
    for frequent in (1 << 20, 16):
        monkeypatch.setattr(ct, "FREQUENT", frequent)
        out = ct.score_texts(docs, docs.where(id_remainder(5) != 1)).collect()
        got = sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out)
        assert got == base_score(rows, train)
        assert all(r.score < 0 for r in out)


def test_no_rows(make):
    assert ct.score_texts(make([]), make([])).count() == 0
    r = ct.score_texts(make([(1, "ab")]), make([])).first()
    assert abs(r.score - 3 * 8 * math.log10(0.5)) < 1e-9 and r.n_known == 0 and r.base_score == 0


def tree_of(texts, depth, least=1):
    """Nodes by plain counting."""
    levels = [Counter() for _ in range(depth + 1)]
    for t in texts:
        padded = b"\0" * depth + t + b"\0"
        for at in range(depth, len(padded)):
            for d in range(depth + 1):
                context, prefix = int.from_bytes(padded[at - d : at]), 1
                for i in range(7, -1, -1):
                    bit = padded[at] >> i & 1
                    levels[d][context << 8 | prefix, bit] += 1
                    prefix = prefix << 1 | bit
    out = []
    for c in levels:
        keys = sorted({k for k, _ in c})
        keys = [k for k in keys if c[k, 0] + c[k, 1] >= least]
        out.append((np.array(keys, np.uint64), np.array([c[k, 0] for k in keys]), np.array([c[k, 1] for k in keys])))
    return out


def test_model_is_a_distribution_and_equals_weighting(make):
    texts = [b"abracadabra", b"abrakadabra", b"banana band"]
    docs = make([(i, t.decode()) for i, t in enumerate(texts)])
    tree = ct.fit_tree(docs, depth=2)
    for (k, p), (k2, p2) in zip(tree, ct.build_tree(tree_of(texts, 2))):
        assert (k == k2).all() and np.allclose(p, p2, atol=1e-6)
    for context in (b"ab", b"zz", b"na"):
        grams = np.array([int.from_bytes(context + bytes([b])) for b in range(256)], np.uint64)
        assert abs((10 ** ct.log10_bytes(tree, grams)).sum() - 1) < 1e-6
    pruned = ct.build_tree(tree_of(texts, 2, least=3))
    grams = np.array([int.from_bytes(b"br" + bytes([b])) for b in range(256)], np.uint64)
    assert abs((10 ** ct.log10_bytes(pruned, grams)).sum() - 1) < 1e-6

    # depth 0 of a one-symbol alphabet: the block probability is Krichevsky and Trofimov's
    assert abs(ct.log_kt(np.array([0.0]), np.array([2.0]))[0] - math.log(3 / 8)) < 1e-9
    assert abs(ct.log_kt(np.array([1.0]), np.array([1.0]))[0] - math.log(1 / 8)) < 1e-9


def test_no_context_is_left_out(make, monkeypatch):
    """More than 2^18 bytes: rare contexts count all the same, whether their values are broadcast or joined."""
    rng = np.random.default_rng(5)
    texts = [bytes(rng.choice(list(b"abcdefgh  "), 40_000)).decode() for _ in range(9)]
    rows = list(enumerate(texts)) + [(50, "bad zebra"), (51, None), (52, texts[0][:300]), (52, texts[0][:300])]
    train = make(list(enumerate(texts)))
    grams, n = np.unique(ct._contexts([lower_bytes(t) for t in texts], 5)[0], return_counts=True)
    levels = []
    for d in range(6):
        g, byte = grams & np.uint64((1 << (8 * d + 8)) - 1), grams & np.uint64(255)
        node = np.concatenate([g & ~np.uint64(255) | np.uint64(1 << i) | byte >> np.uint64(8 - i) for i in range(8)])
        bit = np.concatenate([byte >> np.uint64(7 - i) & np.uint64(1) for i in range(8)]).astype(float)
        key, at = np.unique(node, return_inverse=True)
        ones, both = np.bincount(at, np.tile(n, 8) * bit), np.bincount(at, np.tile(n, 8))
        levels.append((key, both - ones, ones))
    tree = ct.build_tree(levels)
    want = sorted(ct.log10_bytes(tree, ct._contexts([lower_bytes(t)], 5)[0]).sum() for _, t in rows)
    for common in (1 << 20, 100):
        monkeypatch.setattr(ct, "COMMON", common, raising=False)
        got = sorted(r.score for r in ct.score_texts(make(rows), train).collect())
        assert np.allclose(got, want, rtol=1e-5), (got, want)


def test_deeper_trees_code_better(make):
    docs = make([(i, sentence(i, 200)) for i in range(60)])
    test = make([(100 + i, sentence(500 + i, 100)) for i in range(10)])
    bits = [sum(r.bits_per_byte for r in ct.score_texts(test, docs, depth=d).collect()) for d in (0, 1, 3, 5)]
    assert bits[0] > bits[1] > bits[2] > bits[3]


def test_quality_rules(spark, make):
    good = [(i, sentence(i, 60) + ".\n" + sentence(1000 + i, 50)) for i in range(300)]
    shouting = [(300 + i, " ".join(w.upper() + "!!" for w in sentence(i, 60).split(" "))) for i in range(60)]
    tables = [(360 + i, " | ".join(sentence(i, 70).split(" "))) for i in range(60)]
    rows = good + shouting + tables + [(900, None), (901, ""), (None, "x")]
    docs = make(rows)
    labels = spark.createDataFrame([(i, int(i < 300)) for i, _ in good + shouting + tables], "doc_id bigint, quality int")
    model = fit_rules(labelled_rows(docs, labels))
    assert 0 < len(model.rules) < 200
    out = score_quality(docs, model).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    held = [r for r in out if r.doc_id is not None and r.doc_id < 420 and crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum(r.predicted == (r.doc_id < 300) for r in held) >= 0.97 * len(held)
    assert {r.doc_id: r.score for r in out} == {r.doc_id: r.score for r in score_quality(docs.repartition(3), model).collect()}
    assert score_quality(make([]), model).count() == 0


def test_quality_without_both_classes(spark, make):
    docs = make([(i, sentence(i, 9)) for i in range(9)])
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert {r.score for r in score_quality(docs, fit_rules(labelled_rows(docs, none))).collect()} == {0.5}
    ones = spark.createDataFrame([(i, 1) for i in range(9)], "doc_id bigint, quality int")
    assert all(r.score > 0.8 for r in score_quality(docs, fit_rules(labelled_rows(docs, ones))).collect())
