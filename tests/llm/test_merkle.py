from hashlib import sha256

import pytest
from samples import sentence

from siftwork.llm import merkle as mk


def h(*nodes):
    return sha256("".join(nodes).encode()).hexdigest()


def tree(leaves):
    """(root, [siblings of each leaf]) straight from the definition."""
    level, at, found = leaves, list(range(len(leaves))), [[] for _ in leaves]
    while len(level) > 1:
        for i, a in enumerate(at):
            other = a ^ 1
            found[i].append((level[other], a % 2) if other < len(level) else None)
        at = [a // 2 for a in at]
        level = [h(*level[i : i + 2]) for i in range(0, len(level), 2)]
    return level[0], found


def expected(rows):
    """{(lang, position): (leaf, subroot, root, proof, fold)} for (lang, doc_id, leaf) rows."""
    langs = sorted({r[0] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    parts = {g: sorted([r for r in rows if r[0] == g], key=lambda r: (r[1] is not None, r[1] or 0, r[2])) for g in langs}
    trees = {g: tree([r[2] for r in p]) for g, p in parts.items()}
    root, over = tree([trees[g][0] for g in langs])
    out = []
    for g, up in zip(langs, over):
        for row, low in zip(parts[g], trees[g][1]):
            steps = low + up
            proof = h(*[s[0] for s in steps if s])
            out.append((g, row[1], row[2], trees[g][0], root, proof, root, True))
    return sorted(out, key=repr)


def leaves(spark, rows):
    schema = "lang string, doc_id bigint, leaf string, root string, _n bigint, _at string"
    return spark.createDataFrame([(*r, "clash", 7, "clash") for r in rows], schema)


def digests(sizes):
    return [(g, i if i % 11 else None, h(str(g), str(i // 2))) for g, n in sizes.items() for i in range(n)]


@pytest.mark.parametrize("height", [1, 2, 12])
@pytest.mark.parametrize("sizes", [{None: 1}, {"a": 1, "b": 1, None: 1}, {"a": 37, "": 16, "é": 5, None: 2, "zz": 1}])
def test_matches_the_definition(spark, monkeypatch, height, sizes):
    monkeypatch.setattr(mk, "HEIGHT", height)
    rows = digests(sizes)
    out = mk.check_proofs(mk.merkle_manifest(leaves(spark, rows).repartition(3)))
    assert out.columns == ["lang", "doc_id", "leaf", "_n", "_at", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    got = sorted([(r.lang, r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in out.collect()], key=repr)
    assert got == expected(rows)


def test_changed_leaf_is_found_and_empty_table(spark, monkeypatch):
    monkeypatch.setattr(mk, "HEIGHT", 2)
    manifest = mk.merkle_manifest(leaves(spark, digests({"a": 9, "b": 3})))
    bad = manifest.selectExpr("*", "CASE WHEN doc_id = 4 AND lang = 'a' THEN sha2(leaf, 256) ELSE leaf END AS shown")
    out = mk.check_proofs(bad, "shown").collect()
    assert [(r.lang, r.doc_id) for r in out if not r.verified] == [("a", 4)]
    assert mk.check_proofs(mk.merkle_manifest(leaves(spark, []))).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 7, 8, 21])
def test_appending_keeps_few_subtrees_and_extends_witnesses(n):
    nodes = [sha256(str(i).encode()).digest() for i in range(n)]
    log = mk.OpenSubtrees()
    for i, d in enumerate(nodes):
        log.append(d)
        assert len(log.open) == bin(i + 1).count("1")
    root, found = log.close((n - 1).bit_length())
    assert root.hex() == tree([d.hex() for d in nodes])[0]
    assert all(mk.fold(d, w) == root for d, w in zip(nodes, found))
    assert n == 1 or mk.fold(nodes[0], found[1]) != root


def test_encoding(spark, make):
    out = make([(1, "éa"), (None, None), (3, ""), (4, sentence(1, 3000))]).select(mk.encoded("doc_id", "source", "lang", "n_chars", "text").alias("e")).collect()
    assert [r.e for r in out][:3] == ["1:11:s-1:23:éa", "-1:s---", "1:31:s-1:00:"]
    assert out[3].e.endswith(sentence(1, 3000))
