"""Nearest rows against all pairs, with several blocks on both sides, and the recall of the bucketed form."""

import numpy as np
import pytest

from siftwork.operators import neighbours as N


def unit(m):
    return m / (np.sqrt((m * m).sum(axis=1, keepdims=True)) + 1e-8)


@pytest.fixture(scope="module")
def tables(spark):
    r = np.random.default_rng(3)
    centres = r.normal(size=(12, 8))
    pool = centres[r.integers(0, 12, 700)] + 0.4 * r.normal(size=(700, 8))
    pool[100:300] = pool[100]  # copies: ties are decided by the id
    items = np.concatenate((centres[r.integers(0, 12, 60)] + 0.4 * r.normal(size=(60, 8)), pool[[100]], np.zeros((1, 8))))
    frames = [
        spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], f"{name} bigint, joint array<double>").repartition(4)
        for name, m in (("sample_id", pool), ("item_id", items))
    ]
    return pool, items, *frames


def expected(pool, items, k):
    sims = np.round(unit(pool) @ unit(items).T, 9)
    out = []
    for j in range(len(items)):
        order = np.lexsort((np.arange(len(pool)), -sims[:, j]))[:k]
        out += [(j, int(i), r + 1) for r, i in enumerate(order)]
    return sorted(out)


@pytest.mark.parametrize("blocks", [None, (400, 56)])
def test_nearest_rows(tables, monkeypatch, blocks):
    pool, items, p, q = tables
    if blocks:  # 14 blocks of the pool, 9 of the items
        monkeypatch.setattr(N, "POOL_VALUES", blocks[0])
        monkeypatch.setattr(N, "ITEM_VALUES", blocks[1])
        monkeypatch.setattr(N, "CHUNK", 17)
    out = N.nearest_rows(p, q, 20)
    assert sorted((r.item_id, r.sample_id, r.rank) for r in out.collect()) == expected(pool, items, 20)
    near = {r.sample_id: r.cosine for r in N.rows_near_items(p, q, 0.9).collect()}
    best = np.round((unit(pool) @ unit(items).T).max(axis=1), 9)
    assert near.keys() == set(np.flatnonzero(best >= 0.9).tolist()) and all(abs(best[i] - c) < 1e-8 for i, c in near.items())


def test_no_items_or_no_pool(tables):
    _, _, p, q = tables
    assert N.nearest_rows(p, q.limit(0)).count() == 0 and N.nearest_rows(p.limit(0), q).count() == 0
    assert N.rows_near_items(p, q.limit(0), 0.5).count() == 0


def test_nothing_is_collected_while_the_query_is_built(tables, monkeypatch):
    _, _, p, q = tables
    monkeypatch.setattr(type(p), "collect", lambda self: pytest.fail("collected"))
    N.nearest_rows(p, q, 5)
    N.rows_near_items(p, q, 0.5)


def test_recall_of_the_bucketed_form(tables):
    pool, items, p, q = tables
    want = {(i, s) for i, s, _ in expected(pool, items[:60], 10)}
    sims = np.round(unit(pool) @ unit(items).T, 9)
    got = [(r.item_id, r.sample_id, r.cosine) for r in N.probable_rows(p, q, 10).collect()]
    assert all(abs(sims[s, i] - c) < 1e-8 for i, s, c in got)
    assert len(want & {(i, s) for i, s, _ in got}) >= 0.95 * len(want)


def test_assignment_by_blocks_is_the_same(tables, monkeypatch):
    from siftwork.operators import clusters as C

    _, _, p, q = tables
    centres = q.selectExpr("CAST(item_id AS INT) AS cluster_id", "joint AS centre").unionByName(q.limit(3).selectExpr("CAST(item_id + 100 AS INT) AS cluster_id", "joint AS centre"))
    whole = {r.sample_id: (r.cluster_id, r.distance) for r in C.assign(p, centres).collect()}
    for name, value in (("POOL_VALUES", 900), ("ITEM_VALUES", 70), ("CHUNK", 13)):
        monkeypatch.setattr(N, name, value)
    monkeypatch.setattr(C, "TASK_VALUES", 8)
    assert {r.sample_id: (r.cluster_id, r.distance) for r in C.assign(p, centres).collect()} == whole and len(whole) == 700


def test_distances_under_the_own_covariance(tables):
    from siftwork.operators import ood as O

    pool, _, p, _ = tables
    mean, cov = O.mean_and_covariance(p, "joint")
    assert np.allclose(cov, np.cov(pool.T)) and np.allclose(mean, pool.mean(axis=0))
    got = {r.sample_id: r.d2 for r in O.distances(p, mean, O.whitening(cov), "joint").collect()}
    inverse = np.linalg.inv(np.cov(pool.T) + 1e-3 * np.eye(8))
    want = np.einsum("nd,de,ne->n", pool - mean, inverse, pool - mean)
    assert all(abs(got[i] - d) < 1e-6 * max(1, d) for i, d in enumerate(want))
