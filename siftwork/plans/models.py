"""Clustering, utility model, calibration and out-of-distribution queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from siftwork.functions import vectors as V
from siftwork.operators import clusters as CL
from siftwork.operators import configs as C
from siftwork.operators import joint as J
from siftwork.operators import metrics as M
from siftwork.operators import model as Q
from siftwork.operators import ood as O
from siftwork.operators import utility as U
from siftwork.operators.common import attach
from siftwork.operators.sampling import rank_pairs
from siftwork.plans import sqltext as T
from siftwork.plans import views as X
from siftwork.plans.catalog import query
from siftwork.plans.configurations import CAP, ENCODED, MASK, REC
from siftwork.plans.reports import rounded
from siftwork.plans.utilities import ULO, u_lo
from siftwork.session import cut_lineage, scratch_path
from siftwork.sources import registry as REG

r = T.r
SEEN = "('L-r8-qv', 'L-r16-qkvo', 'L-r8-mlp', 'IA3-attnmlp', 'AD-b64')"


@query("n01_clusters")
def n01(spark, sf):
    """Sizes of the fitted clusters: every row is assigned once."""
    p = X.pool_vectors(spark, sf).select("sample_id", "joint")
    c = CL.cluster(p, max_iter=10)
    g = c.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
    return g.agg(F.count(F.lit(1)).alias("clusters"), F.sum("n").alias("rows"), F.min("n").alias("smallest"))


@query("n07_cluster_centres")
def n07(spark, sf):
    p = X.pool_vectors(spark, sf).select("sample_id", "joint")
    m = CL.fit(p, k=20, max_iter=10)
    return CL.centres(spark, m).select("cluster_id", F.size("centre").alias("width"), F.round(V.norm("centre"), 6).alias("norm"))


@query("n01_assignment", "WITH " + T.POOL + f""", ce AS (SELECT cluster_id AS c, list(v ORDER BY i) AS m FROM (SELECT cluster_id, i, avg(joint[i]) AS v FROM pool, range(1, 65) AS d(i) GROUP BY ALL) GROUP BY 1),
dd AS (SELECT sample_id, c, round(list_dot_product(joint, joint) - 2 * list_dot_product(joint, m) + list_dot_product(m, m), 9) AS d2 FROM pool, ce)
SELECT sample_id, c::INT AS cluster_id, {r('sqrt(d2)')} AS distance FROM dd QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY d2, c) = 1""")
def n01_assign(spark, sf):
    p = X.pool_vectors(spark, sf)
    centres = V.vector_mean(p, "joint", ["cluster_id"], "centre")
    return rounded(CL.assign(p, centres), "distance")


@query("n02_penalised_score", "WITH " + ULO + f" SELECT sample_id, config, {r('u_lo - 0.2 * abs(u_lo) / 2')} AS q FROM ulo")
def n02(spark, sf):
    from siftwork.operators.quota import penalised

    d = u_lo(spark, sf).withColumn("mu", F.col("u_lo")).withColumn("sigma", F.abs("u_lo") / 2)
    return rounded(penalised(d, 0.2).select("sample_id", "config", "q"), "q")


def triples(spark, sf):
    """(sample, seen config) with inputs, proxy utility, and the label where there is one."""
    cfg = C.encode(REG.with_model(REG.specs(spark, group="seen"))).select(F.col("name").alias("config"), C.capacity_vector().alias("z_p"))
    u = u_lo(spark, sf).join(F.broadcast(cfg), "config")
    x = X.pool_vectors(spark, sf).select("sample_id", F.col("joint").alias("z_x"))
    return cut_lineage(u.join(x, "sample_id").join(X.truth(spark, sf), "sample_id", "left"))


# two tasks: rows like the good ones, and rows like the plain ones
TASKS = (("good", 1), ("plain", 0))
PLAIN = "truth AS (SELECT doc_id AS sample_id, (1 - quality - 0.5 * toxic)::DOUBLE AS u_hi FROM labels)"


def task_table(spark, sf):
    """Training triples (sample, seen config, task, z_x, u_lo, u_hi) and the conditions z_p, z_t of each (config, task)."""
    sig = cut_lineage(X.signatures(spark, sf))
    cfg = cut_lineage(C.encode(REG.with_model(REG.specs(spark, group="seen"))).select(F.col("name").alias("config"), "z_p", "site_alpha", "family"))
    x = X.pool_vectors(spark, sf).select("sample_id", F.col("joint").alias("z_x"))
    truth = X.table(spark, sf, "labels")
    parts, conditions = [], []
    for task, quality in TASKS:
        members = X.sketch(spark, sf, quality=quality)
        s = cut_lineage(U.site_similarities(sig, U.task_signatures(sig, members.select("sample_id"))))
        label = (F.abs(F.col("quality") - (1 - quality)) - 0.5 * F.col("toxic")).cast("double").alias("u_hi")
        u = U.utilities(s, cfg.select("config", "site_alpha")).join(truth.select(F.col("doc_id").alias("sample_id"), label), "sample_id", "left")
        parts.append(u.withColumn("task", F.lit(task)))
        conditions.append(attach(cfg.select("config", "family", "z_p"), V.vector_mean(members, "joint", name="z_t")).withColumn("task", F.lit(task)))
    triples = parts[0].unionByName(parts[1]).join(x, "sample_id")
    return cut_lineage(triples.select("sample_id", "config", "task", "z_x", "u_lo", "u_hi")), cut_lineage(conditions[0].unionByName(conditions[1]))


def with_conditions(triples, conditions):
    return triples.join(F.broadcast(conditions.select("config", "task", "z_p", "z_t")), ["config", "task"])


def _task_sql(select: str, *ctes: str) -> str:
    """One select over both tasks; every task brings its own sketch."""

    def one(task, quality):
        base = (ULO + ", " + (T.TRUTH if quality else PLAIN)).replace("quality = 1)", f"quality = {quality})")
        return f"(WITH {', '.join((base, *ctes))} {select.replace('$task', task)})"

    return " UNION ALL ".join(one(*t) for t in TASKS)


@query("q01_training_set", _task_sql(f"SELECT config, '$task' AS task, count(*) AS n, count(u_hi) AS n_labelled, {r('avg(u_lo)')} AS mean_u_lo FROM ulo LEFT JOIN truth USING (sample_id) WHERE config IN {SEEN} GROUP BY 1"))
def q01(spark, sf):
    t, _ = task_table(spark, sf)
    return rounded(t.groupBy("config", "task").agg(F.count(F.lit(1)).alias("n"), F.count("u_hi").alias("n_labelled"), F.avg("u_lo").alias("mean_u_lo")), "mean_u_lo")


def _quality(scored, label):
    err = F.col(label) - F.col("mu")
    return scored.where(F.col(label).isNotNull()).groupBy("config", "task").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sqrt(F.avg(err * err)), 4).alias("rmse"), F.round(F.min("sigma"), 4).alias("min_sigma")
    )


PROXY_ONLY, LABELS_ONLY = (0.0, 0.0, 1.0, 0.0), (1.0, 0.3, 0.0, 0.2)
STEPS = 12


class Training:
    """The stored training rows of one data set, and fits on them."""

    def __init__(self, triples, conditions):
        self.triples, self.conditions = triples, conditions
        self.cond = J.Conditions.of(conditions)
        self.rows = J.training_rows(triples, self.cond)

    def proxy(self, **kw):
        return J.fit(self.rows, self.cond, PROXY_ONLY, steps=STEPS, **kw)

    def joint(self, first=None, **kw):
        return J.fit(self.rows, self.cond, start=first or self.proxy(), steps=STEPS, **kw)

    def scored(self, model):
        return model.score(with_conditions(self.triples, self.conditions))


@query("q02_proxy_fit")
def q02(spark, sf):
    """First phase: the proxy term alone, over all triples of both tasks."""
    t = Training(*task_table(spark, sf))
    return _quality(t.scored(t.proxy()), "u_lo")


@query("q03_joint_fit")
def q03(spark, sf):
    """Second phase: all four terms at once, from the first phase's coefficients."""
    t = Training(*task_table(spark, sf))
    return _quality(t.scored(t.joint()), "u_hi")


PAIRS = ULO + ", " + T.TRUTH + f""", lb AS (SELECT config, sample_id, u_lo, u_hi FROM ulo JOIN truth USING (sample_id) WHERE config IN {SEEN}),
sl AS (SELECT *, row_number() OVER (PARTITION BY config ORDER BY md5('0:' || config || ':' || sample_id), sample_id) AS rn FROM lb),
pr AS (SELECT a.config, a.u_hi AS lu, b.u_hi AS ru, a.u_lo AS lm, b.u_lo AS rm FROM sl a JOIN sl b ON a.config = b.config AND b.rn = a.rn + 1 WHERE a.rn % 2 = 1 AND a.rn <= 127)"""


@query("q04_pairwise_loss", "WITH " + PAIRS + f" SELECT config, {r('avg(ln(1 + exp(-(sign(lu - ru) * (lm - rm)))))')} AS rank FROM pr GROUP BY 1")
def q04(spark, sf):
    t = triples(spark, sf)
    p = rank_pairs(t, "u_hi", ["config"], 64)
    m = t.select("config", "sample_id", "u_lo")
    d = p.join(m.withColumnsRenamed({"sample_id": "left_id", "u_lo": "left_mu"}), ["config", "left_id"])
    d = d.join(m.withColumnsRenamed({"sample_id": "right_id", "u_lo": "right_mu"}), ["config", "right_id"])
    return rounded(Q.pairwise_loss(d, ["config"]), "rank")


LOSS = ULO + ", " + T.TRUTH + f""", l AS (SELECT config, u_lo * 2 AS mu, 0.1 + abs(u_lo) AS sg, u_lo, u_hi FROM ulo JOIN truth USING (sample_id) WHERE config IN {SEEN}),
lv AS (SELECT config, avg(CASE WHEN abs(mu - u_hi) <= 1 THEN 0.5 * (mu - u_hi) ** 2 ELSE abs(mu - u_hi) - 0.5 END) AS reg, avg(CASE WHEN abs(mu - u_lo) <= 1 THEN 0.5 * (mu - u_lo) ** 2 ELSE abs(mu - u_lo) - 0.5 END) AS proxy,
  avg(0.5 * (u_hi - mu) ** 2 / (sg * sg) + 0.5 * ln(sg * sg)) AS unc FROM l GROUP BY 1)"""


def _losses(spark, sf):
    t = triples(spark, sf).where("u_hi is not null").withColumn("mu", F.col("u_lo") * 2).withColumn("sigma", 0.1 + F.abs("u_lo"))
    return Q.loss_values(t, ["config"])


@query("q05_regression_losses", "WITH " + LOSS + f" SELECT config, {r('reg')} AS reg, {r('proxy')} AS proxy FROM lv")
def q05(spark, sf):
    return rounded(_losses(spark, sf).select("config", "reg", "proxy"), "reg", "proxy")


@query("q06_likelihood_loss", "WITH " + LOSS + f" SELECT config, {r('unc')} AS unc, {r('0.3 * reg + 0.5 * proxy + 0.2 * unc')} AS total FROM lv")
def q06(spark, sf):
    return rounded(Q.combined_loss(_losses(spark, sf)).select("config", "unc", "total"), "unc", "total")


@query("q07_batch_scoring")
def q07(spark, sf):
    """All targets in one projection: rows, and bounds of mu and sigma per configuration and task."""
    t = Training(*task_table(spark, sf))
    s = t.joint().score(with_conditions(t.triples.drop("u_lo", "u_hi"), t.conditions))
    return s.groupBy("config", "task").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("mu"), 4).alias("mean_mu"), (F.min("sigma") > 0).alias("sigma_positive")
    )


# a model with given coefficients: cosines and sines of the input's number
WIDTH = 1 + 64 + 128 + 64 + 2 * 4 * 4
RECIPE = ENCODED.replace("c2 AS (SELECT *,", "c2 AS (SELECT *, 16 AS batch_size, 0.0 AS dropout, 0 AS sch, 0 AS opt,", 1)
STORED = (
    MASK,
    CAP,
    REC.replace("(opt = 0)::INT, (opt = 1)::INT]", "0, 0]"),  # the registry's way to start has no slot
    "zp AS (SELECT config, list(v ORDER BY slot) AS z_p FROM (SELECT config, slot, v FROM mask UNION ALL SELECT config, slot + 96, v FROM cap UNION ALL SELECT config, slot + 112, v FROM rec) GROUP BY config)",
    "zt AS (SELECT list(m ORDER BY i) AS z_t FROM (SELECT i, avg(joint[i]) AS m FROM sketch, range(1, 65) AS d(i) GROUP BY i))",
    f"""fx AS (SELECT u.sample_id, u.config, u.u_lo, truth.u_hi, p.joint AS z_x, [1.0::DOUBLE] || p.joint || zp.z_p || zt.z_t
  || flatten(list_transform(p.joint[1:4], lambda a: list_transform(zp.z_p[1:4], lambda b: a * b)))
  || flatten(list_transform(p.joint[1:4], lambda a: list_transform(zt.z_t[1:4], lambda b: a * b))) AS f
  FROM ulo u JOIN pool p USING (sample_id) JOIN zp ON zp.config = u.config CROSS JOIN zt LEFT JOIN truth ON truth.sample_id = u.sample_id WHERE u.config IN {SEEN}),
st AS (SELECT *, list_dot_product(f, list_transform(range(0, {WIDTH}), lambda i: cos(i) / 8)) AS mu, list_dot_product(f, list_transform(range(0, {WIDTH}), lambda i: sin(i) / 8)) AS z FROM fx)""",
)


def stored_model() -> J.JointScorer:
    i = np.arange(WIDTH)
    return J.JointScorer(np.cos(i) / 8, np.sin(i) / 8, 4)


def _stored_sql(select: str) -> str:
    return _task_sql(select, *STORED).replace(ENCODED, RECIPE)


@query("q07_stored_scoring", _stored_sql(f"SELECT sample_id, config, '$task' AS task, {r('mu')} AS mu, {r('greatest(z, 0) + ln(1 + exp(-abs(z))) + 0.001')} AS sigma FROM st"))
def q07_stored(spark, sf):
    """A model read from its coefficient table scores every sample for every configuration and task."""
    t, c = task_table(spark, sf)
    path = scratch_path(spark, "coefficients")
    stored_model().save(spark, path)
    return rounded(J.load(spark, path).score(with_conditions(t, c)).select("sample_id", "config", "task", "mu", "sigma"), "mu", "sigma")


def _family(conditions):
    """Conditions whose z_p only tells the family."""
    one = [F.when(F.col("family") == f, 1.0).otherwise(0.0) for f in ("lora", "ia3", "adapter", "prefix", "ptuning", "bitfit")]
    return conditions.withColumn("z_p", F.array(*one))


@query("q08_condition_ablations")
def q08(spark, sf):
    """Error of the joint model on the labels: whole, without each condition, family only, proxy only, labels only."""
    triples_, conditions = task_table(spark, sf)
    full, family = Training(triples_, conditions), Training(triples_, _family(conditions))
    fits = {
        "full": (full, {}),
        "no_config": (full, {"parts": (True, False, True)}),
        "no_task": (full, {"parts": (True, True, False)}),
        "family_only": (family, {}),
        "proxy_only": (full, {"weights": PROXY_ONLY}),
        "labels_only": (full, {"weights": LABELS_ONLY}),
    }
    out = None
    for name, (t, kw) in fits.items():
        q = _quality(t.scored(J.fit(t.rows, t.cond, steps=STEPS, **kw)), "u_hi").agg(F.sum("n").alias("n"), F.round(F.avg("rmse"), 4).alias("rmse"))
        q = q.withColumn("variant", F.lit(name))
        out = q if out is None else out.unionByName(q)
    return out


@query("k20_variant_selection")
def k20(spark, sf):
    """Top tenth per configuration and task under the proxy-only, the labels-only, the condition-free and the joint model, and their overlap."""
    from siftwork.functions.ranks import ranked

    t = Training(*task_table(spark, sf))
    first = t.proxy()
    models = {
        "proxy_only": first,
        "labels_only": J.fit(t.rows, t.cond, LABELS_ONLY, steps=STEPS),
        "no_condition": J.fit(t.rows, t.cond, steps=STEPS, parts=(True, False, False)),
        "joint": t.joint(first),
    }
    parts = None
    for name, m in models.items():
        d = t.scored(m).select("config", "task", "sample_id", "mu", F.lit(name).alias("variant"))
        parts = d if parts is None else parts.unionByName(d)
    by = ["variant", "config", "task"]
    top = ranked(cut_lineage(parts), by, ["-mu", "sample_id"], size_name="n").where(F.col("rn") <= F.bround(F.col("n") * 0.1))
    g = top.groupBy("config", "task", "sample_id").agg(F.count(F.lit(1)).alias("c"))
    return g.groupBy("config", "task").agg(F.count(F.lit(1)).alias("union"), F.sum((F.col("c") == len(models)).cast("int")).alias("in_all"))


@query("q09_model_choice")
def q09(spark, sf):
    """Held-out ranking quality on a configuration that no fit has seen, by ridge."""
    t, c = task_table(spark, sf)
    held = with_conditions(t.where("config = 'AD-b64' AND u_hi IS NOT NULL"), c)
    seen = Training(t.where("config <> 'AD-b64'"), c.where("config <> 'AD-b64'"))
    out = None
    for ridge in (1e-4, 1e-1):
        d = J.fit(seen.rows, seen.cond, steps=STEPS, ridge=ridge).score(held)
        d = d.select("config", "task", "sample_id", F.col("mu").alias("pred"), F.col("u_hi").alias("truth"))
        q = M.ndcg(d, ["config", "task"]).agg(F.round(F.avg("ndcg_at_k"), 4).alias("ndcg")).withColumn("reg", F.lit(ridge))
        out = q if out is None else out.unionByName(q)
    return out


@query("q10_model_round_trip")
def q10(spark, sf):
    """A stored and reloaded model scores like the original."""
    t = Training(*task_table(spark, sf))
    s = t.joint()
    path = scratch_path(spark, "scorer")
    s.save(spark, path)
    a = t.scored(s).select("config", "task", "sample_id", F.col("mu").alias("a"), F.col("sigma").alias("c"))
    b = t.scored(J.load(spark, path)).select("config", "task", "sample_id", F.col("mu").alias("b"), F.col("sigma").alias("d"))
    gap = F.greatest(F.abs(F.col("a") - F.col("b")), F.abs(F.col("c") - F.col("d")))
    return a.join(b, ["config", "task", "sample_id"]).agg(F.count(F.lit(1)).alias("n"), F.round(F.max(gap), 9).alias("largest_gap"))


RIDGE, LEADING = 0.1, 6
CAL = "cl AS (SELECT sample_id, [1.0::DOUBLE, mu] || z_x[1:6] AS g, u_hi - mu AS y FROM st WHERE config = 'AD-b64' AND u_hi IS NOT NULL)"
EQ = """eq AS (SELECT i::BIGINT AS i, j::BIGINT AS j, sum(g[i + 1] * CASE WHEN j < 0 THEN y ELSE g[j + 1] END) AS s FROM cl, range(0, 8) AS a(i), range(-1, 8) AS b(j) WHERE sample_id % 2 = 0 GROUP BY ALL)"""


def _calibration_rows(spark, sf):
    """Scored labelled rows of a new configuration, and the inputs of the residual head."""
    t, c = task_table(spark, sf)
    d = stored_model().score(with_conditions(t.where("config = 'AD-b64' AND u_hi IS NOT NULL"), c))
    return cut_lineage(d.select("task", "sample_id", "z_x", "mu", "u_hi")), [F.lit(1.0), F.col("mu"), *[F.get("z_x", i) for i in range(LEADING)]]


@query("q11_normal_equations", _task_sql(f"SELECT '$task' AS task, i, j, {r('s', 4)} AS s FROM eq", *STORED, CAL, EQ).replace(ENCODED, RECIPE))
def q11_equations(spark, sf):
    d, features = _calibration_rows(spark, sf)
    out = None
    for task, _ in TASKS:
        e = J.normal_equations(d.where((F.col("task") == task) & (F.col("sample_id") % 2 == 0)), features)
        e = e.select(F.lit(task).alias("task"), F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j"), F.round("s", 4).alias("s"))
        out = e if out is None else out.unionByName(e)
    return out


SOLVED = f"""m0 AS (SELECT list(row ORDER BY i) AS m FROM (SELECT i, list(s + CASE WHEN i = j THEN {RIDGE} ELSE 0 END ORDER BY CASE WHEN j < 0 THEN 99 ELSE j END) AS row FROM eq GROUP BY i)),
el AS (SELECT 1 AS k, m FROM m0 UNION ALL SELECT k + 1, list_transform(m, lambda row, i: CASE WHEN i = k THEN list_transform(row, lambda x: x / row[k]) ELSE list_transform(row, lambda x, j: x - row[k] * m[k][j] / m[k][k]) END) FROM el WHERE k <= 8),
co AS (SELECT list_transform(m, lambda row: row[9]) AS c FROM el WHERE k = 9),
er AS (SELECT y, y - list_dot_product(g, c) AS z FROM cl CROSS JOIN co WHERE sample_id % 2 = 1)"""


@query("q11_calibration", _task_sql(f"SELECT '$task' AS task, {r('avg(y * y)', 5)} AS before, {r('avg(z * z)', 5)} AS after FROM er", *STORED, CAL, EQ, SOLVED).replace(ENCODED, RECIPE).replace("(WITH ", "(WITH RECURSIVE "))
def q11(spark, sf):
    """Squared error on the held-out half of a new configuration before and after the residual head, fitted on the other half."""
    d, features = _calibration_rows(spark, sf)
    out = None
    for task, _ in TASKS:
        some = d.where(F.col("task") == task)
        c = J.solve_ridge(J.normal_equations(some.where("sample_id % 2 = 0"), features), RIDGE)
        held = some.where("sample_id % 2 = 1")
        after = J.calibrated(held.withColumn("first", F.col("mu")), features, c)
        mse = [F.round(F.avg(F.pow(F.col("u_hi") - F.col(m), 2)), 5).alias(n) for m, n in (("first", "before"), ("mu", "after"))]
        q = after.agg(*mse).withColumn("task", F.lit(task))
        out = q if out is None else out.unionByName(q)
    return out


@query("q12_calibration_error", f"WITH d AS (SELECT event_type, value / 500 AS sigma, value / 400 - 0.1 AS err, (SELECT max(value / 500) FROM events) AS top FROM events), b AS (SELECT event_type, least(floor(sigma / top * 10), 9) AS b, count(*) AS n, avg(sigma) AS s, sqrt(avg(err * err)) AS rm FROM d GROUP BY ALL) SELECT event_type, {r('sum(n * abs(s - rm)) / sum(n)')} AS ece FROM b GROUP BY 1")
def q12(spark, sf):
    e = X.table(spark, sf, "events")
    d = e.select("event_type", (F.col("value") / 500).alias("sigma"), (F.col("value") / 400 - 0.1).alias("err"))
    return rounded(Q.calibration_error(d, ["event_type"]), "ece")


# ------------------------------------------------------------------------ ood


@query("r01_mean_and_covariance", "WITH " + T.POOL + f" SELECT (i - 1)::BIGINT AS i, (j - 1)::BIGINT AS j, {r('covar_samp(joint[i], joint[j])')} AS cov FROM pool, range(1, 65) AS a(i), range(1, 65) AS b(j) GROUP BY ALL")
def r01(spark, sf):
    p = X.pool_vectors(spark, sf)
    m = p.agg(F.count(F.lit(1)).alias("n")).head()["n"]
    mean = np.array(V.vector_mean(p, "joint").head()["mean"])
    d = O.covariance_rows(p, mean, "joint").select("i", F.posexplode("row").alias("j", "s"))
    return d.select(F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j"), F.round(F.col("s") / (m - 1), 6).alias("cov"))


def d2_rows(spark, sf):
    """Squared distances under the pool's own mean and covariance (with 1e-3 on the diagonal)."""
    p = X.pool_vectors(spark, sf)
    mean, cov = O.mean_and_covariance(p, "joint")
    return O.distances(p, mean, O.whitening(cov), "joint")


# the inverse by elimination on [covariance | identity]
D2 = T.POOL + """, mu AS (SELECT list(m ORDER BY i) AS m FROM (SELECT i, avg(joint[i]) AS m FROM pool, range(1, 65) AS d(i) GROUP BY i)),
cv AS (SELECT i, list(s + CASE WHEN i = j THEN 1e-3 ELSE 0 END ORDER BY j) || list_transform(range(1, 65), lambda k: CASE WHEN i = k THEN 1.0 ELSE 0.0 END::DOUBLE) AS row
  FROM (SELECT i, j, covar_samp(joint[i], joint[j]) AS s FROM pool, range(1, 65) AS a(i), range(1, 65) AS b(j) GROUP BY ALL) GROUP BY i),
gj AS (SELECT 1 AS k, list(row ORDER BY i) AS m FROM cv UNION ALL
  SELECT k + 1, list_transform(m, lambda row, i: CASE WHEN i = k THEN list_transform(row, lambda x: x / row[k]) ELSE list_transform(row, lambda x, j: x - row[k] * m[k][j] / m[k][k]) END) FROM gj WHERE k <= 64),
iv AS (SELECT list_transform(m, lambda row: row[65:128]) AS v FROM gj WHERE k = 65),
cx AS (SELECT sample_id, list_transform(range(1, 65), lambda i: joint[i] - m[i]) AS x FROM pool, mu),
dd AS (SELECT sample_id, list_dot_product(x, list_transform(v, lambda row: list_dot_product(row, x))) AS d2 FROM cx, iv)"""


@query("r02_mahalanobis", "WITH RECURSIVE " + D2 + f" SELECT sample_id, {r('d2', 5)} AS d2 FROM dd")
def r02(spark, sf):
    return d2_rows(spark, sf).select("sample_id", F.round("d2", 5).alias("d2"))


@query("r03_threshold", "WITH RECURSIVE " + D2 + f" SELECT {r('quantile_cont(d2, 0.95)', 5)} AS threshold FROM dd")
def r03(spark, sf):
    return O.threshold(d2_rows(spark, sf)).select(F.round("threshold", 5).alias("threshold"))


@query("r04_outlier_flags", "WITH RECURSIVE " + D2 + " SELECT sample_id, d2 > (SELECT quantile_cont(d2, 0.95) FROM dd) AS is_ood FROM dd")
def r04(spark, sf):
    d = cut_lineage(d2_rows(spark, sf))
    return d.select("sample_id", (F.col("d2") > O.threshold(d).scalar()).alias("is_ood"))


@query("r04_fitted_outliers")
def r04_fit(spark, sf):
    p = X.pool_vectors(spark, sf).select("sample_id", "joint")
    f = O.flag(p, O.fit(p, "joint"), "joint")
    return f.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("is_ood").cast("double")), 3).alias("share_flagged"))
