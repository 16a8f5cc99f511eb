import hashlib
import re
from collections import defaultdict

from samples import sentence
from pyspark.sql import functions as F

from siftwork.llm.line_dedup import line_dedup
from siftwork.llm.mixing import mix_sources

SPACE = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def expected_lines(rows, min_chars=10):
    order = lambda i: (i is None, i or 0)
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(order(i))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if not (len(holders[key(x)]) > 1 and order(i) > min(holders[key(x)]))]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=repr)


def test_line_dedup_against_brute_force(make, odd_rows):
    rows = odd_rows + [(20 + i, f"own {i} {sentence(i, 9)}\n  A Shared line HERE \nshort\n" + "x" * i) for i in range(30)]
    out = line_dedup(make(rows))
    assert set(out.columns) >= {"kept_text", "n_lines", "n_dropped", "source", "size"}
    got = sorted([(r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in out.collect()], key=repr)
    assert got == expected_lines(rows)


def test_line_dedup_other_threshold(make):
    rows = [(1, "aaaaaaaaaaaa"), (2, "aaaaaaaaaaaa"), (3, "bbbbbbbbbbbb"), (4, "bbbbbbbbbbbb"), (5, "bbbbbbbbbbbb")]
    got = {r.doc_id: r.n_dropped for r in line_dedup(make(rows), min_docs=3).collect()}
    assert got == {1: 0, 2: 0, 3: 0, 4: 1, 5: 1}


def test_line_dedup_empty(make):
    assert line_dedup(make([])).count() == 0


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def filled(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    """Targets by pouring and re-sharing until none is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, full = share * sum(sizes.values()), set()
    while True:
        level = (total - sum(cap * sizes[s] for s in full)) / max(1, sum(w[s] for s in names if s not in full))
        more = {s for s in names if s not in full and w[s] * level >= cap * sizes[s]}
        if not more:
            return {s: cap * sizes[s] if s in full else w[s] * level for s in names}
        full |= more


def test_mixing_hits_targets(make, odd_rows):
    rows = odd_rows + [(100 + i, sentence(i, 5 + i % 40)) for i in range(300)]
    source = lambda i: None if i is None else "hot" if i % 3 == 0 else f"s{i % 7}"
    docs = make(rows, source=source)
    out = mix_sources(docs).collect()
    assert len(out) == len(rows)
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for i, t in rows:
        sizes[source(i)] += words(t)
    for r in out:
        assert 0 <= r.taken <= 2 * r["size"]
        assert r.source_size == sizes[r.source]
        taken[r.source] += r.taken
        target[r.source] = r.target
    want = filled(dict(sizes))
    for s in sizes:
        assert abs(target[s] - want[s]) < 1e-6
        assert abs(taken[s] - want[s]) <= 1
    again = {(r.doc_id, r.text): r.taken for r in mix_sources(docs.repartition(7)).collect()}
    assert again == {(r.doc_id, r.text): r.taken for r in out}


def test_mixing_draw_is_unequal_and_without_order(make):
    """Extra copies come from all over a source, not from its first rows."""
    docs = make([(i, sentence(i, 20)) for i in range(400)], source=lambda i: "a" if i < 200 else "b")
    extra = [r.doc_id for r in mix_sources(docs, weights=(1, 3), share=1.0).collect() if r.source == "a" and r.taken > 0]
    assert 50 < len(extra) < 200 and min(extra) < 20 and max(extra) > 180


def test_mixing_empty_tables(make):
    assert mix_sources(make([])).count() == 0
    only = mix_sources(make([(1, None), (2, "")])).collect()
    assert [r.taken for r in only] == [0, 0]


def test_sha_of_kept_text(make):
    out = line_dedup(make([(1, "ä b")])).select(F.sha2("kept_text", 256).alias("s")).first().s
    assert out == hashlib.sha256("ä b".encode()).hexdigest()
