import hashlib

import numpy as np
from samples import sentence

from siftwork.llm import edit_fingerprints as ef


def test_rows_and_neighbours(make, odd_rows):
    rows = odd_rows + [(100 + i, sentence(i, 10 + i)) for i in range(60)]
    out = ef.edit_fingerprints(make(rows).repartition(5)).collect()
    assert len(out) == len(rows)
    plain = [(i, t) for i, t in rows if i not in (None, 9, 10)]
    by_id = {r.doc_id: r for r in out}
    for (i, t), (_, n) in zip(plain, plain[1:]):
        if i >= 11:
            want = ef.edited(t, n)
            assert by_id[i].n_chars == len(t)
            assert by_id[i].edited_sha256 == hashlib.sha256(want.encode()).hexdigest()
    prints = {}
    for r in out:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    for i, t in plain:
        prints.setdefault(t or "", set()).add(by_id[i].fingerprint)
    assert all(len(p) == 1 for p in prints.values())
    assert ef.edit_fingerprints(make([])).count() == 0


def test_last_row_is_followed_by_the_first(make):
    out = {r.doc_id: r for r in ef.edit_fingerprints(make([(3, "abcdef"), (1, "uvwxyz"), (2, None)])).collect()}
    assert out[3].edited_sha256 == hashlib.sha256(b"abcuvw").hexdigest()
    assert out[1].edited_sha256 == hashlib.sha256(b"uvw").hexdigest()
    assert out[2].n_chars == 0
    one = ef.edit_fingerprints(make([(7, "abcd")])).collect()
    assert one[0].edited_sha256 == hashlib.sha256(b"abab").hexdigest()


def test_likeness_falls_with_edits():
    base = sentence(1, 400)
    r = np.random.default_rng(5)
    texts = [base]
    for k in (1, 5, 20, 80, 300):
        t = list(base)
        for at in r.choice(len(t), k, replace=False):
            t[at] = "#"
        texts.append("".join(t))
    texts += ["+" + base, sentence(2, 400), ""]
    b, u = ef.embed(texts)
    like = [float(ef.likeness(b[:1], u[:1], b[i : i + 1], u[i : i + 1])[0]) for i in range(len(texts))]
    assert like[0] == 1.0 and like[1] > 0.9 and like[2] > 0.7
    assert like[1] >= like[2] > like[3] > like[4] > like[5] - 0.05
    assert like[6] > 0.6 and like[7] < 0.35 and like[8] == 0.0
    alone = ef.embed([base])
    assert (alone[0][0] == b[0]).all()


def test_similar_documents(make):
    base = sentence(9, 200)
    rows = [(i, base[: 40 * i] + "~" + base[40 * i :]) for i in range(12)] + [(50 + i, sentence(20 + i, 100)) for i in range(20)]
    out = ef.similar_documents(make(rows), least=0.5).collect()
    assert {r.b for r in out} == set(range(1, 12)) and all(r.a < r.b < 12 for r in out)
