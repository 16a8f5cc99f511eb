"""Ranking metrics against plain definitions."""

import numpy as np
import pandas as pd
import pytest

from siftwork.operators import metrics as M


def tau_b(x, y):
    s = tx = ty = 0
    n = len(x)
    for i in range(n):
        for j in range(i + 1, n):
            s += np.sign(x[i] - x[j]) * np.sign(y[i] - y[j])
            tx += x[i] == x[j]
            ty += y[i] == y[j]
    n0 = n * (n - 1) / 2
    return s / np.sqrt((n0 - tx) * (n0 - ty))


@pytest.mark.parametrize("rows_per_task", [5, 1000])
def test_kendall_with_heavy_ties(spark, rows_per_task):
    rng = np.random.default_rng(2)
    frames = []
    for g, levels in (("few", 4), ("many", 1000)):
        n = 150
        pred = rng.integers(0, 60, n).astype(float)
        pred[rng.random(n) < 0.3] = 17.0
        frames.append(pd.DataFrame({"g": g, "sample_id": range(n), "pred": pred, "truth": rng.integers(0, levels, n).astype(float)}))
    pdf = pd.concat(frames)
    got = M.kendall_tau(spark.createDataFrame(pdf), ["g"], rows_per_task=rows_per_task).toPandas().set_index("g")["kendall_tau"]
    for g, d in pdf.groupby("g"):
        assert got[g] == pytest.approx(tau_b(d.pred.to_numpy(), d.truth.to_numpy()), abs=1e-12)


def test_perfect_and_reversed_order(spark):
    rows = [("up", i, float(i), float(i)) for i in range(30)] + [("down", i, float(-i), float(i)) for i in range(30)]
    df = spark.createDataFrame(rows, "g string, sample_id int, pred double, truth double")
    m = M.ranking_metrics(df, ["g"], k=10).toPandas().set_index("g")
    assert m.loc["up", ["spearman", "kendall_tau", "ndcg_at_k", "topk_hit_rate", "pairwise_acc"]].tolist() == pytest.approx([1, 1, 1, 1, 1])
    assert m.loc["down", "spearman"] == pytest.approx(-1) and m.loc["down", "topk_hit_rate"] == 0


def test_groups_without_two_labels_are_null(spark):
    df = spark.createDataFrame([("a", 1, 0.1, 0.2), ("b", 1, 0.1, None), ("b", 2, 0.1, None)], "g string, sample_id int, pred double, truth double")
    m = M.ranking_metrics(df, ["g"])
    assert m.count() == 2 and m.where("spearman is null and kendall_tau is null and ndcg_at_k is null").count() == 2


def test_overlap_counts(spark):
    rows = [("a", i) for i in range(10)] + [("b", i) for i in range(5, 15)] + [("c", 99)]
    o = M.overlap(spark.createDataFrame(rows, "config string, sample_id int")).toPandas().set_index(["left", "right"])["jaccard"]
    assert o["a", "a"] == 1 and o["a", "b"] == pytest.approx(5 / 15) and o["a", "c"] == 0


def test_exact_bootstrap_counts_every_resample(spark):
    import itertools

    import numpy as np

    from siftwork.operators import paired as P

    groups = {"a": [0.5, -1.0, 2.0, 0.25, 3.0], "b": [1.5], "c": [2.0, 2.0, -1.0], "d": [float(i * i % 7) for i in range(9)]}
    df = spark.createDataFrame([(k, v) for k, d in groups.items() for v in d], "k string, diff double")
    got = {r.k: (r.lo, r.hi, r.n_resamples) for r in P.exact_bootstrap(df, "k").collect()}
    for k in "abc":
        m = [np.mean(x) for x in itertools.product(groups[k], repeat=len(groups[k]))]
        assert got[k][2] == len(m) and np.allclose(got[k][:2], np.percentile(m, [2.5, 97.5]))
    assert got["d"][2] == 9**9 and got["d"][0] < np.mean(groups["d"]) < got["d"][1]
