import math
import re
from collections import Counter

import numpy as np
import xxhash
from samples import sentence

from siftwork.llm.decontamination import RADIUS, decontaminate, find_items, near_prints


def words(t):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", (t or "").lower()) if w]


def grams(w, k):
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def expected(docs, items, threshold=0.8):
    items = sorted({(i, tuple(words(t))) for i, t in items if words(t)}, key=repr)
    df = Counter(g for _, w in items for g in grams(w, min(5, len(w))))
    weight = lambda g: 1 + math.log((len(items) + 1) / (df.get(g, 0) + 1))
    out = {}
    for d, t in docs:
        w = words(t)
        for i, q in items:
            s = grams(q, min(5, len(q)))
            for at in range(max(1, len(w) - len(q) + 1)):
                x = grams(w[at : at + len(q)], min(5, len(q)))
                if x & s:
                    score = sum(map(weight, x & s)) / sum(map(weight, x | s))
                    if round(score, 9) >= threshold:
                        out[d, i] = max(out.get((d, i), 0), round(score, 9))
    return out


def test_against_all_windows(spark, make, odd_rows):
    items = [(1, sentence(50, 30)), (2, sentence(51, 12) + "\n" + sentence(52, 12)), (3, sentence(53, 60)), (4, "two words"), (5, None), (6, " "), (6, sentence(55, 20)), (7, sentence(50, 30))]
    changed = sentence(53, 60).split(" ")
    changed[30] = "other"
    moved = sentence(53, 60).split(" ")
    moved.insert(20, "more")
    docs = odd_rows + [
        (30, sentence(1, 50) + "\n" + sentence(50, 30) + " " + sentence(2, 20)),
        (31, sentence(51, 12) + " " + sentence(52, 12).upper()),
        (32, sentence(5, 9) + " " + " ".join(changed) + " " + sentence(6, 9)),
        (33, " ".join(moved) + " " + sentence(7, 30)),
        (34, sentence(50, 15) + " " + sentence(8, 60)),  # half an item
        (35, "here are two words inside"),
        (36, " ".join([sentence(55, 20)] * 40)),
        (37, sentence(50, 29)),
    ]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found = find_items(make(docs), bench)
    got = {(r.doc_id, r.item_id): r.similarity for r in found.collect()}
    assert got == expected(docs, items)
    assert found.count() == len(got)
    kept = decontaminate(make(docs), bench)
    bad = {d for d, _ in got}
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((d for d, _ in docs if d not in bad), key=str)
    assert kept.columns == make(docs).columns


def test_anchor_may_stand_anywhere_in_the_window(spark, make):
    """Halves that are swapped, and edits beside the rare shingles: the item's offset does not tell the start."""
    q = sentence(60, 100).split(" ")
    cut = sentence(61, 40).split(" ")
    items = [(1, " ".join(q)), (2, " ".join(cut)), (3, sentence(62, 20) + " " + sentence(63, 20))]
    docs = [
        (1, sentence(1, 60) + " " + " ".join(q[50:] + q[:50]) + " " + sentence(2, 60)),
        (2, sentence(3, 60) + " " + " ".join(cut[:20] + ["new"] + cut[20:]) + " " + sentence(4, 60)),
        (3, " ".join(q[70:] + q[:70])),
        (4, sentence(63, 20) + " " + sentence(62, 20) + " " + sentence(63, 20)),
        (5, " ".join(q[:30])),
    ]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = expected(docs, items)
    assert (1, 1) in want
    assert {(r.doc_id, r.item_id): r.similarity for r in find_items(make(docs), bench).collect()} == want


def test_empty_tables(spark, make):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert find_items(make([(1, sentence(1, 50))]), none).count() == 0
    assert decontaminate(make([(1, sentence(1, 50))]), none).count() == 1
    some = spark.createDataFrame([(1, sentence(50, 30))], "item_id bigint, text string")
    assert find_items(make([]), some).count() == 0


def test_blocks_find_every_print_within_the_radius(spark):
    r = np.random.default_rng(8)
    items = [(i, int(x)) for i, x in enumerate(r.integers(-(1 << 63), 1 << 63, 30))]
    windows = []
    for w in range(600):
        i, f = items[w % 30]
        flipped = r.choice(64, int(r.integers(0, 40)), replace=False)
        g = (f & (1 << 64) - 1) ^ sum(1 << int(b) for b in flipped)
        windows.append((w, i, g - (1 << 64) if g >> 63 else g, len(flipped)))
    left = spark.createDataFrame([x[:3] for x in windows], "window bigint, item bigint, f bigint")
    got = {x.window: x.distance for x in near_prints(left, spark.createDataFrame(items, "item bigint, print bigint")).collect()}
    assert got == {w: d for w, _, _, d in windows if d <= RADIUS} and 0 < len(got) < 600


def simhash(shingles, weight):
    total = np.zeros(64, np.int64)
    for g in shingles:
        h = xxhash.xxh64_intdigest(" ".join(g).encode(), seed=42)
        total += math.floor(weight(g) * (1 << 20) + 0.5) * np.array([1 if h >> b & 1 else -1 for b in range(64)])
    return sum(1 << b for b in range(64) if total[b] >= 0)


def test_distances_and_the_share_that_blocks_find(spark, make):
    """Edited items at similarities from 0.8 up: the distance is the prints' own, and blocks find them."""
    r = np.random.default_rng(9)
    items, docs = [(i, sentence(500 + i, 60)) for i in range(40)], []
    for i, t in items:
        w = t.split(" ")
        w[int(r.integers(3, 57))] = "edited"
        docs.append((i, sentence(900 + i, 25) + " " + " ".join(w) + " " + sentence(1200 + i, 25)))
    out = find_items(make(docs), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert {(x.doc_id, x.item_id): x.similarity for x in out} == expected(docs, items)
    df = Counter(g for _, t in items for g in grams(words(t), 5))
    weight = lambda g: 1 + math.log((len(items) + 1) / (df.get(g, 0) + 1))
    texts, by = dict(docs), dict(items)
    for x in out:
        w = words(texts[x.doc_id])[x.start : x.start + x.n_words]
        d = bin(simhash(grams(w, 5), weight) ^ simhash(grams(words(by[x.item_id]), 5), weight)).count("1")
        assert x.distance == (d if d <= RADIUS else None)
    assert len(out) >= 36 and sum(x.distance is not None for x in out) >= 0.9 * len(out)
