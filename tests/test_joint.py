"""The jointly trained model: gradients against differences, against the chained fit, ablations, calibration."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwork.operators import joint as J
from siftwork.operators import model as Q
from siftwork.operators.sampling import rank_pairs

WEIGHTS = dict(zip(("rank", "reg", "proxy", "unc"), Q.WEIGHTS))


@pytest.fixture(scope="module")
def triples(spark):
    r = np.random.default_rng(0)
    a, b = r.normal(size=5), r.normal(size=5)
    conf = {"c0": [0.0, 1.0, 0.3], "c1": [1.0, 0.0, -0.2]}
    task = {"t0": [0.5, 0.1], "t1": [-0.5, 0.2]}
    rows = []
    for i in range(150):
        x = r.normal(size=5)
        for c, zp in conf.items():
            for t, zt in task.items():
                u = x @ (a if c == "c0" else b) / 4 + zt[0] * x[0] + 0.1 * r.normal()
                rows.append((i, c, t, x.tolist(), zp, zt, float(0.7 * u + 0.2 * r.normal()), float(u) if i % 3 else None))
    schema = "sample_id bigint, config string, task string, z_x array<double>, z_p array<double>, z_t array<double>, u_lo double, u_hi double"
    return spark.createDataFrame(rows, schema).repartition(4).cache()


@pytest.fixture(scope="module")
def cond(triples):
    return J.Conditions.of(triples.select("config", "task", "z_p", "z_t").distinct())


@pytest.fixture(scope="module")
def rows(triples, cond):
    return J.training_rows(triples, cond, 64)


def test_gradients_against_differences():
    r = np.random.default_rng(1)
    f, lo, hi = r.normal(size=(30, 4)), r.normal(size=30), r.normal(size=30) * 2
    lo[::7], hi[::4] = np.nan, np.nan
    w, v = r.normal(size=4), r.normal(size=4)
    share = {"reg": 0.3, "proxy": 0.5, "unc": 0.2}
    _, gw, gv = J.row_terms(f, lo, hi, w, v, share)
    g, sign = r.normal(size=(30, 4)), np.sign(r.normal(size=30))
    _, gp = J.pair_terms(f, g, sign, w, 0.7)
    for i in range(4):
        e = np.eye(4)[i] * 1e-6
        assert abs((J.row_terms(f, lo, hi, w + e, v, share)[0] - J.row_terms(f, lo, hi, w - e, v, share)[0]) / 2e-6 - gw[i]) < 1e-4
        assert abs((J.row_terms(f, lo, hi, w, v + e, share)[0] - J.row_terms(f, lo, hi, w, v - e, share)[0]) / 2e-6 - gv[i]) < 1e-4
        assert abs((J.pair_terms(f, g, sign, w + e, 0.7)[0] - J.pair_terms(f, g, sign, w - e, 0.7)[0]) / 2e-6 - gp[i]) < 1e-4


def test_descent_finds_the_least():
    r = np.random.default_rng(2)
    m = r.normal(size=(40, 6))
    a, b = m.T @ m + np.eye(6), r.normal(size=6)
    x, losses = J.descend(lambda x: (0.5 * x @ a @ x - b @ x, a @ x - b), np.zeros(6), 60, tol=1e-12)
    assert np.allclose(x, np.linalg.solve(a, b), atol=1e-4) and losses == sorted(losses, reverse=True)


def four_terms(scored):
    """The loss from (mu, sigma) columns, apart from the operator's own code."""
    d = scored.withColumn("bucket", F.concat("config", "task"))
    values = Q.loss_values(d.where("u_hi is not null"), []).head()
    proxy = d.agg(F.avg(Q.huber(F.col("mu") - F.col("u_lo")))).head()[0]
    p = rank_pairs(d.where("u_hi is not null"), "u_hi", ["config", "task"], 64).where("left_u <> right_u")
    m = d.select("config", "task", "sample_id", "mu")
    p = p.join(m.withColumnsRenamed({"sample_id": "left_id", "mu": "left_mu"}), ["config", "task", "left_id"])
    p = p.join(m.withColumnsRenamed({"sample_id": "right_id", "mu": "right_mu"}), ["config", "task", "right_id"])
    rank = Q.pairwise_loss(p, []).head()["rank"]
    return WEIGHTS["rank"] * rank + WEIGHTS["reg"] * values["reg"] + WEIGHTS["proxy"] * proxy + WEIGHTS["unc"] * values["unc"]


def test_joint_fit_beats_the_chained_one_and_reports_its_loss(spark, triples, cond, rows, tmp_path):
    first = J.fit(rows, cond, (0, 0, 1, 0), steps=15)
    assert list(first.losses) == sorted(first.losses, reverse=True)
    both = J.fit(rows, cond, start=first, ridge=0.0, steps=30)
    scored = both.score(triples)
    assert abs(four_terms(scored) - both.losses[-1]) < 1e-6
    chained = Q.fit_joint(triples, Q.fit_proxy(triples), ["config", "task"])
    assert both.losses[-1] < four_terms(chained.score(triples))
    both.save(spark, str(tmp_path / "m"))
    again = J.load(spark, str(tmp_path / "m")).score(triples)
    gap = scored.select("sample_id", "config", "task", F.col("mu").alias("a")).join(again, ["sample_id", "config", "task"])
    assert gap.agg(F.max(F.abs(F.col("a") - F.col("mu")))).head()[0] == 0


def test_leaving_inputs_out(triples, cond, rows):
    def error(parts):
        s = J.fit(rows, cond, (0, 1, 0, 0), steps=15, parts=parts).score(triples)
        return s.agg(F.avg(F.pow(F.col("mu") - F.col("u_hi"), 2))).head()[0]

    full = error((True, True, True))
    assert full < error((True, False, True)) and full < error((True, True, False)) and full < error((False, True, True))


def test_calibration_on_disjoint_rows(triples):
    shifted = triples.where("u_hi is not null").withColumn("mu", F.col("u_hi") * 0.5 + 0.3 * F.element_at("z_x", 1))
    features = [F.lit(1.0), F.col("mu"), *[F.element_at("z_x", i) for i in (1, 2)]]
    fitted, held = shifted.where("sample_id % 2 = 0"), shifted.where("sample_id % 2 = 1")
    c = J.solve_ridge(J.normal_equations(fitted, features), 0.1)
    x = np.array([[1.0, r.mu, r.z_x[0], r.z_x[1]] for r in fitted.collect()])
    y = np.array([r.u_hi - r.mu for r in fitted.collect()])
    assert np.allclose(c, np.linalg.solve(x.T @ x + 0.1 * np.eye(4), x.T @ y))
    mse = F.avg(F.pow(F.col("u_hi") - F.col("mu"), 2))
    assert J.calibrated(held, features, c).agg(mse).head()[0] < 0.1 * held.agg(mse).head()[0]


def laid_out(x, p, t, rank):
    """All inputs of each row, apart from the operator's own code."""
    made = [[a * b for a in x[i][:rank] for b in o[i][:rank]] for o in (p, t) for i in range(len(x))]
    n = len(x)
    return np.array([[1.0, *x[i], *p[i], *t[i], *made[i], *made[n + i]] for i in range(n)])


def test_cells_give_the_sums_of_the_laid_out_inputs():
    r = np.random.default_rng(3)
    cond = J.Conditions((("c", "a"), ("c", "b"), ("d", "a")), r.normal(size=(3, 3)), r.normal(size=(3, 2)))
    x, row, cell = r.normal(size=(6, 5)), np.array([0, 0, 1, 2, 3, 3, 5, 5]), np.array([0, 2, 1, 1, 0, 0, 2, 1])  # one cell twice
    f = laid_out(x[row], cond.p[cell], cond.t[cell], 4)
    w, g = r.normal(size=f.shape[1]), r.normal(size=len(row))
    a, a0 = cond.coefficients(w, 5, 4)
    assert np.allclose((x @ a)[row, cell] + a0[cell], f @ w)
    sums = J._cell_sums(g, x, row, cell, 3)
    assert np.allclose(cond.folded(sums[:3], sums[3:].reshape(3, 5), 4), g @ f)
    squares = J._cell_sums(np.ones(8), x * x, row, cell, 3)
    assert np.allclose(cond.squared().folded(squares[:3], squares[3:].reshape(3, 5), 4), (f * f).sum(axis=0))


def test_training_rows_are_stored_in_blocks(rows):
    kinds = {r.pair: (r.n, r.blocks) for r in rows.groupBy("pair").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("blocks")).collect()}
    assert kinds[False][0] == 150 and kinds[False][1] < 150 / 2 and kinds[True][0] > kinds[True][1]


def test_scores_of_odd_rows(spark):
    """Rows of other widths, with NULL inputs or without a part: as many inputs as coefficients, or NULL."""
    r = np.random.default_rng(4)
    w, v = r.normal(size=15), r.normal(size=15)
    rows = [
        (1, [1.0, 2.0], [0.5, -1.0], [2.0, 0.25]),  # 1 + 2 + 2 + 2 + 4 + 4
        (2, [1.0, 2.0], [0.5, None], [2.0, 0.25]),
        (3, None, [0.5, -1.0], [2.0, 0.25]),
        (4, [1.0, 2.0, 3.0], [0.5, -1.0], [2.0, 0.25]),
        (5, [3.0] * 7, None, [0.0] * 0),
        (6, [3.0, 4.0], None, [1.0] * 4),  # 1 + 2 + 4 + 8
        (7, [1.0, 2.0], [0.5, -1.0], [2.0, 0.25]),
        (8, [float("nan"), 2.0], [0.5, -1.0], [2.0, 0.25]),
    ]
    df = spark.createDataFrame(rows, "id int, z_x array<double>, z_p array<double>, z_t array<double>")
    got = {r.id: (r.mu, r.sigma) for r in J.JointScorer(w, v, 4).score(df).collect()}
    for i in (1, 6):
        _, x, p, t = rows[i - 1]
        f = laid_out([x], [p or []], [t], 4)[0]
        assert np.allclose(got[i], (f @ w, np.logaddexp(0, f @ v) + Q.SIGMA_FLOOR))
    assert all(got[i] == (None, None) for i in (2, 3, 4, 5))
    assert got[7] == got[1] and np.isnan(got[8][0])


def test_the_variants_share_the_proxy_fit(spark, monkeypatch):
    from siftwork.plans import models as P

    fits = []
    monkeypatch.setattr(P, "cut_lineage", lambda df: df)
    monkeypatch.setattr(P, "task_table", lambda spark, sf: (None, None))
    monkeypatch.setattr(J.Conditions, "of", staticmethod(lambda table: None))
    monkeypatch.setattr(J, "training_rows", lambda triples, cond: None)
    monkeypatch.setattr(J, "fit", lambda *a, **kw: fits.append((a, kw)) or J.JointScorer(np.zeros(1), np.zeros(1), 4))
    kinds = "config string, task string, sample_id bigint, mu double, sigma double"
    monkeypatch.setattr(P.Training, "scored", lambda self, m: spark.createDataFrame([("c", "t", i, float(i), 1.0) for i in range(20)], kinds))
    assert P.k20(spark, None).head()["union"] == 2
    assert len(fits) == 4 and "start" in fits[3][1]
