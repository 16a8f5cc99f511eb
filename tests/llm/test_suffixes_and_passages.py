import numpy as np
import pytest
from samples import sentence

from siftwork.llm import passages as ps
from siftwork.llm import suffix_dedup as sd


def expected(rows, length=50):
    order = lambda i: (i is None, i or 0)
    first = {}
    raw = [(i, (t or "").encode()) for i, t in rows]
    for i, b in raw:
        for p in range(len(b) - length + 1):
            k = b[p : p + length]
            first[k] = min(first.get(k, order(i)), order(i))
    out = []
    for i, b in raw:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < order(i):
                gone[p : p + length] = True
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((i, len(b), int(gone.sum()), spans, kept))
    return sorted(out, key=repr)


def repeated_rows(odd_rows):
    line = sentence(60, 12)
    rows = odd_rows + [(100 + i, sentence(i, 30) + "\n" + line + "\n" + sentence(300 + i, 25)) for i in range(25)]
    rows += [(200, line[:50]), (201, line[:49]), (202, "ab" * 400), (203, "ab" * 30), (204, "é" * 60), (205, "xé" + "é" * 60)]
    return rows


@pytest.mark.parametrize("split", [1 << 21, 120])
def test_remove_repeats(make, odd_rows, monkeypatch, split):
    monkeypatch.setattr(sd, "SPLIT", split)
    monkeypatch.setattr(sd, "BATCH", 300)
    monkeypatch.setattr(sd, "BUCKET_BYTES", 20_000)
    rows = repeated_rows(odd_rows) if split > 1000 else [r for r in repeated_rows(odd_rows) if len(r[1] or "") < 5000]
    out = sd.remove_repeats(make(rows))
    got = sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in out.collect()], key=repr)
    assert got == expected(rows)
    assert sd.remove_repeats(make([])).count() == 0


def test_family_keeps_few_levels():
    r = np.random.default_rng(0)
    family, seen = sd.SuffixFamily(), {}
    for batch in range(40):
        keys = r.integers(0, 5000, 100).astype(np.uint64)
        docs = np.sort(r.integers(batch * 3, batch * 3 + 4, 100))
        docs = np.maximum(docs, max(seen.values(), default=0)) if batch else docs
        hit = family.add(keys, docs)
        for k, d in zip(keys.tolist(), docs.tolist()):
            seen[k] = min(seen.get(k, d), d)
        assert hit.tolist() == [seen[k] < d for k, d in zip(keys.tolist(), docs.tolist())]
    sizes = [len(k) for k, _ in family.levels]
    assert len(sizes) <= 8 and all(a > 2 * b for a, b in zip(sizes, sizes[1:]))


@pytest.mark.parametrize("n", [1, 2, 4])
def test_planes_round_trip(n):
    a = np.array([0, 5, -3, 1 << 50], np.int64)[:n]
    out = sd._from_planes(sd._planes(a, a[::-1].copy()), 2)
    assert (out == np.stack((a, a[::-1]))).all()
    out[0] = 7  # a copy, whatever the number of values


def test_more_buckets_than_strips(make, monkeypatch):
    monkeypatch.setattr(sd, "BUCKET_BYTES", 200)
    rows = [(i, sentence(i % 17, 30)) for i in range(20)] + [(None, sentence(3, 30)), (None, sentence(99, 30)), (4, sentence(4, 30)), (4, sentence(98, 30))]
    out = sd.remove_repeats(make(rows))
    got = sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in out.collect()], key=repr)
    assert got == expected(rows)


def brute_chain(x, y, k, gap):
    order = np.lexsort((-y, x))
    score = {}
    for i in order:
        best = 0.0
        for j in score:
            if y[j] < y[i]:
                g = score[j] - gap / 2 * (x[i] + y[i] - x[j] - y[j]) + k * gap - max(0, k - min(x[i] - x[j], y[i] - y[j]))
                best = max(best, g)
        score[i] = k + best
    return max(score.values())


def test_chains_are_ordered_and_complete():
    r = np.random.default_rng(4)
    for n in (1, 2, 30, 80):
        x, y = r.integers(0, 200, n), r.integers(0, 200, n)
        found = ps.chains(x, y)
        assert sorted(np.concatenate(found).tolist()) == list(range(n))
        for c in found:
            assert (np.diff(y[c]) > 0).all() and (np.diff(x[c]) >= 0).all()
    x = np.arange(0, 100, 10)
    assert len(ps.chains(x, x + 7)) == 1


def test_edit_distance():
    a = np.frombuffer(b"kitten", np.uint8)
    assert ps.edit_distance(a, np.frombuffer(b"sitting", np.uint8)) == 3
    assert ps.edit_distance(a, a[:0]) == 6


def changed(text, every):
    return " ".join(w + "'" if i % every == every - 1 else w for i, w in enumerate(text.split(" ")))


def test_passages(make, odd_rows):
    p = sentence(70, 90)
    rows = odd_rows + [
        (30, sentence(31, 60) + " " + p + " " + sentence(32, 60)),
        (31, sentence(33, 10) + " " + p.upper() + " " + sentence(34, 80)),
        (32, changed(p, 30) + " " + sentence(35, 20)),
        (33, sentence(36, 200)),
        (34, " ".join(p.split(" ")[:40]) + " " + sentence(37, 60)),  # 40 words are too few
        (35, p),
        (36, p),
    ]
    out = ps.repeated_passages(make(rows)).collect()
    by = {(r.doc_id, r.other_id): r for r in out}
    assert set(by) == {(2, 1), (7, 1), (9, 8), (31, 30), (32, 30), (32, 31), (35, 30), (35, 32), (36, 35)}
    assert (by[31, 30].start, by[31, 30].end, by[31, 30].other_start) == (10, 100, 60)
    assert by[31, 30].identity == 1.0 and by[36, 35].n_words == 90
    assert 0.9 < by[32, 30].identity < 1 and by[32, 30].n_words >= 85
    assert all(r.other_id < r.doc_id for r in out)
    assert ps.repeated_passages(make([])).count() == 0


def test_holders_whose_first_holders_are_too_short_find_each_other(make):
    words = sentence(70, 78).split(" ")
    rows = [(1, " ".join(words[:49]) + " " + sentence(71, 30)), (2, sentence(72, 30) + " " + " ".join(words[29:]))]
    rows += [(i, sentence(70 + i, 25) + " " + " ".join(words) + " " + sentence(80 + i, 25)) for i in (3, 4, 5)]
    by = {(r.doc_id, r.other_id): r for r in ps.repeated_passages(make(rows)).collect()}
    assert set(by) == {(4, 3), (5, 4)} and by[4, 3].n_words == by[5, 4].n_words == 78


def test_recall_of_edited_passages(make):
    """Share of planted pairs found, by words between edits (identity about 0.95, 0.93, 0.9)."""
    found = {}
    for n, every in ((60, 20), (80, 15), (100, 10)):
        rows = []
        for i in range(40):
            p = sentence(1000 * every + i, n)
            rows += [(2 * i, sentence(5000 + i, 20) + " " + p), (2 * i + 1, changed(p, every) + " " + sentence(7000 + i, 20))]
        out = {(r.doc_id, r.other_id) for r in ps.repeated_passages(make(rows), identity=0.8).collect()}
        found[n, every] = sum((2 * i + 1, 2 * i) in out for i in range(40)) / 40
    assert min(found.values()) >= 0.9, found


def test_spans_merge_where_they_meet():
    r = np.random.default_rng(5)
    for _ in range(50):
        lo = r.integers(0, 400, int(r.integers(1, 12)))
        spans = np.stack((lo, lo + r.integers(0, 30, len(lo))), axis=1)
        cover = np.zeros(600, bool)
        for a, b in spans:
            cover[a : b + 20] = True
        edge = np.diff(cover.astype(int), prepend=0, append=0)
        start, end = sd.merged(spans, 20)
        assert start.tolist() == np.flatnonzero(edge == 1).tolist() and end.tolist() == np.flatnonzero(edge == -1).tolist()


def linked(rows, pairs):
    """Smallest id that the pairs lead to, for each id."""
    label = {i: i for i, _ in rows}
    for _ in rows:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    return label


def test_equal_passages_between_short_holders_are_linked(make):
    """Pieces of 49 words, before and between the holders of a whole passage, hold every seed of it; its holders still meet."""
    rows = []
    for n, base in ((50, 0), (58, 100), (90, 200)):
        words = sentence(900 + n, n).split(" ")
        pieces = [words[i : i + 49] for i in {*range(0, n - 49, 8), n - 49}]
        for k in range(3):
            rows += [(base + 10 * k + i, f"{sentence(base + 300 + 10 * k + i, 25)} {' '.join(p)} {sentence(base + 600 + 10 * k + i, 25)}") for i, p in enumerate(pieces)]
            rows.append((base + 10 * k + 9, f"{sentence(base + 400 + k, 20)} {' '.join(words)} {sentence(base + 500 + k, 20)}"))
    label = linked(rows, {(r.doc_id, r.other_id) for r in ps.repeated_passages(make(rows)).collect()})
    for base in (0, 100, 200):
        assert len({label[base + 10 * k + 9] for k in range(3)}) == 1, base


def test_runs_of_seeds_are_the_same_wherever_they_stand():
    p = ps.word_hashes([sentence(9, 50).encode()])[0]
    texts = [sentence(40 + i, 20 + 7 * i) for i in range(3)]
    whole = [(t + " " + sentence(9, 50) + " " + t).encode() for t in texts]
    h, doc, pos = ps.seeds_of(*ps.word_hashes(whole), ps.DENSE_K, ps.DENSE_WINDOW)
    key, i, j = ps.runs_of(h.view(np.int64), doc, pos, 50 - ps.DENSE_K - 2 * (ps.DENSE_WINDOW - 1))
    inside = [{int(k) for k, a, b in zip(key, i, j) if doc[a] == n and 20 + 7 * n <= pos[a] and pos[b] + ps.DENSE_K <= 70 + 7 * n} for n in range(3)]
    assert len(p) == 50 and inside[0] & inside[1] & inside[2]


@pytest.mark.parametrize("n, every", [(60, 10), (60, 7), (80, 7), (80, 5), (100, 5)])
def test_recall_of_densely_edited_passages(n, every):
    """Words replaced, left out or put in at random places, up to one in five: identity 0.8 and more."""
    r = np.random.default_rng(n * every)
    found = 0
    for _ in range(60):
        p, other = r.integers(0, 1 << 60, (2, n)).astype(np.uint64)
        q = list(p)
        for i in sorted(r.choice(n, n // every, replace=False).tolist(), reverse=True):
            q[i : i + 1] = ([other[i]], [], [q[i], other[i]])[r.integers(0, 3)]
        texts = [np.concatenate((r.integers(0, 1 << 60, 40).astype(np.uint64), m, r.integers(0, 1 << 60, 40).astype(np.uint64))) for m in (p, np.array(q))]
        h, doc, pos = ps.seeds_of(np.concatenate(texts), np.cumsum([0, *map(len, texts)]), ps.DENSE_K, ps.DENSE_WINDOW)
        x, y = np.array([(a, b) for a, s in zip(pos[doc == 0], h[doc == 0]) for b in pos[doc == 1][h[doc == 1] == s]]).reshape(-1, 2).T
        found += any(len(c) > 1 and ps.passage(*texts, x[c], y[c], 50, 0.8, ps.DENSE_K) is not None for c in (ps.chains(x, y, ps.DENSE_K) if len(x) else []))
    assert found >= 54, found


def plain_edits(a, b):
    row = list(range(len(b) + 1))
    for i, v in enumerate(a, 1):
        new = [i]
        for j, w in enumerate(b, 1):
            new.append(min(row[j - 1] + (v != w), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def test_pairs_are_aligned_side_by_side_as_one_by_one():
    r = np.random.default_rng(5)
    texts = [(r.integers(0, 4, r.integers(0, 40)), r.integers(0, 4, r.integers(0, 40))) for _ in range(120)]
    texts = [(a.astype(np.uint64), b.astype(np.uint64)) for a, b in texts] + [(np.arange(300, dtype=np.uint64), np.arange(7, dtype=np.uint64))]
    assert ps.edit_distances(texts).tolist() == [plain_edits(a.tolist(), b.tolist()) for a, b in texts]
    assert ps._extend_gapped(texts) == [ps._extend_gapped([t])[0] for t in texts]
    for (a, b), (i, j, edits) in zip(texts, ps._extend_gapped(texts)):
        assert i <= len(a) and j <= len(b) and edits == plain_edits(a[:i].tolist(), b[:j].tolist()) and i + j >= 5 * edits

    chained = []
    for n in range(60):
        a = r.integers(0, 1000, 90).astype(np.uint64)
        b = np.concatenate((a[:20], r.integers(0, 1000, n % 7).astype(np.uint64), a[20 + n % 5 :]))
        x = np.array([2, 8, 40, 46])
        chained.append((a, b, x, x + np.array([0, 0, n % 7 - n % 5, n % 7 - n % 5])))
    got = ps.passages(chained, 50, 0.8)
    assert got == [ps.passage(*c, 50, 0.8) for c in chained] and all(got)
    assert ps.passages([], 50, 0.8) == []
