"""Budget allocation against a step-by-step greedy, and its invariants."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from siftwork.operators import quota as Q


def greedy(value, size, budget, alpha, floor):
    """The rules, one step at a time; ties go to the smaller cluster id."""
    v = value - min(value.min(), 0.0)
    term = np.ones_like(v) if alpha == 0 or (v <= 1e-12).all() else np.maximum(v, 0) ** alpha
    w = term * size.astype(float) ** (1 - alpha)
    up = sorted(range(len(w)), key=lambda i: (w[i], i))
    down = sorted(range(len(w)), key=lambda i: (-w[i], i))
    low = np.minimum(floor, size).astype(int)
    over = low.sum() - budget
    for i in up:
        cut = min(low[i], max(over, 0))
        low[i] -= cut
        over -= cut
    share = max(budget - low.sum(), 0) * w / max(w.sum(), 1e-12)
    b = np.array([min(low[i] + int(round(share[i])), size[i]) for i in range(len(w))])
    rest = budget - b.sum()
    for i in down if rest > 0 else up:
        if rest > 0:
            step = min(size[i] - b[i], rest)
        elif rest < 0:
            step = -min(b[i] - low[i], -rest)
        else:
            break
        b[i] += step
        rest -= step
    return b


def test_matches_greedy_in_one_job(spark):
    rng = np.random.default_rng(0)
    rows, want = [], {}
    for case in range(300):
        k = rng.integers(1, 9)
        size = rng.integers(1, 40, k)
        value = np.round(rng.normal(size=k), 2)
        if case % 7 == 0:
            value[:] = value[0]
        alpha = float(rng.choice([0.0, 0.3, 0.6, 1.0]))
        floor = int(rng.choice([0, 3, 10]))
        budget = int(rng.integers(0, size.sum() + 6))
        want[case] = greedy(value, size, budget, alpha, floor)
        rows += [(case, alpha, i, int(size[i]), float(value[i]), budget, floor) for i in range(k)]
    df = spark.createDataFrame(rows, "case int, alpha double, cluster_id int, size bigint, value double, budget bigint, low int")
    got = Q.allocate(df, ["case"], alpha="alpha", min_cluster=F.col("low")).toPandas()
    for case, g in got.groupby("case"):
        b = g.sort_values("cluster_id")["b"].to_numpy()
        assert (b == want[case]).all(), case
        assert b.sum() == min(g["budget"].iloc[0], g["size"].sum())
        assert (b <= g.sort_values("cluster_id")["size"]).all() and (b >= 0).all()


def test_proportional_leftover_spends_the_budget(spark):
    rows = [(i, 10 + i, 0.1 * i, 37) for i in range(8)]
    df = spark.createDataFrame(rows, "cluster_id int, size bigint, value double, budget bigint")
    got = Q.allocate(df, leftover="proportional").toPandas()
    assert got["b"].sum() == 37 and (got["b"] <= got["size"]).all()


@pytest.mark.parametrize("budget", [1, 25, 120, 500])
def test_selection_is_a_subset_without_repeats(spark, budget):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"sample_id": range(120), "cluster_id": rng.integers(0, 6, 120), "q": rng.normal(size=120)})
    got = Q.select_by_quota(spark.createDataFrame(pdf), budget).toPandas()
    assert len(got) == min(budget, 120) and got["sample_id"].is_unique
    for _, g in got.groupby("cluster_id"):
        best = pdf[pdf.cluster_id == g.cluster_id.iloc[0]].nlargest(len(g), "q")
        assert set(best.sample_id) == set(g.sample_id)


def test_cluster_value_is_the_top_share_mean(spark):
    df = spark.createDataFrame([(i, 0, float(i)) for i in range(20)], "sample_id int, cluster_id int, q double")
    v = Q.cluster_values(Q.rank_in_clusters(df)).head()
    assert v["size"] == 20 and v["value"] == pytest.approx(18.5)
