"""Utility and label queries over signatures, configurations and deltas."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwork.functions import vectors as V
from siftwork.operators import configs as C
from siftwork.operators import selectors as S
from siftwork.operators import utility as U
from siftwork.operators.common import resolve_budget
from siftwork.plans import sqltext as T
from siftwork.plans import views as X
from siftwork.plans.catalog import query
from siftwork.plans.configurations import REGISTRY
from siftwork.plans.selection import K
from siftwork.session import cut_lineage
from siftwork.sources import registry as R

r = T.r

BASE = T.SKETCH + ", " + T.SIGNATURES + ", " + T.TASK_SIGNATURES
SIMS = BASE + ", sims AS (SELECT sample_id, site, list_dot_product(g, t) AS s FROM signatures JOIN tsig USING (site))"
ULO = SIMS + ", " + REGISTRY + ", ulo AS (SELECT sample_id, w.config, sum(w.a * s) AS u_lo FROM sims JOIN weights w USING (site) GROUP BY ALL)"


def registry_weights(spark):
    d = C.with_site_weights(R.with_model(R.specs(spark)))
    return d.select(F.col("name").alias("config"), "site_alpha", "family", "rank", "bottleneck", "prefix_len")


def sims(spark, sf):
    sig = X.signatures(spark, sf)
    task = U.task_signatures(sig, X.sketch(spark, sf).select("sample_id"))
    return cut_lineage(U.site_similarities(sig, task))


def u_lo(spark, sf):
    return U.utilities(sims(spark, sf), registry_weights(spark))


@query("g01_task_vector", "WITH " + T.SKETCH + f" SELECT (i - 1)::BIGINT AS slot, {r('avg(joint[i])')} AS v FROM sketch, range(1, 65) AS d(i) GROUP BY i")
def g01(spark, sf):
    m = V.vector_mean(X.sketch(spark, sf), "joint")
    d = m.select(F.posexplode("mean").alias("slot", "v"))
    return d.select(F.col("slot").cast("bigint").alias("slot"), F.round("v", 6).alias("v"))


@query("g02_task_signatures", "WITH " + BASE + f" SELECT site::BIGINT AS site, {r('t[1]')} AS t0, {r('t[2]')} AS t1 FROM tsig")
def g02(spark, sf):
    t = U.task_signatures(X.signatures(spark, sf), X.sketch(spark, sf).select("sample_id"))
    return t.select(F.col("site").cast("bigint").alias("site"), F.round(F.col("t")[0], 6).alias("t0"), F.round(F.col("t")[1], 6).alias("t1"))


@query("g04_utilities", "WITH " + ULO + f" SELECT sample_id, config, {r('u_lo')} AS u_lo FROM ulo")
def g04(spark, sf):
    return u_lo(spark, sf).select("sample_id", "config", F.round("u_lo", 6).alias("u_lo"))


@query("g03_utilities_by_site", "WITH " + ULO + f" SELECT sample_id, config, {r('u_lo')} AS u_lo FROM ulo")
def g03(spark, sf):
    sig = cut_lineage(X.signatures(spark, sf))
    task = U.task_signatures(sig, X.sketch(spark, sf).select("sample_id"))
    w = cut_lineage(registry_weights(spark).select("config", "site_alpha"))  # a few rows with costly expressions
    w = w.select("config", F.posexplode("site_alpha").alias("site", "alpha"))
    return U.utilities_by_site(sig, task, w).select("sample_id", "config", F.round("u_lo", 6).alias("u_lo"))


@query("k11_grad_sim", "WITH " + SIMS + f", m AS (SELECT sample_id, avg(s) AS u FROM sims GROUP BY 1) SELECT sample_id, {r('u')} AS score FROM m ORDER BY m.u DESC, sample_id LIMIT ({K})")
def k11(spark, sf):
    k = resolve_budget(X.pool_vectors(spark, sf), 0.10)
    out = S.select("grad_sim", {"site_mean": U.mean_similarity(sims(spark, sf))}, k)
    return out.select("sample_id", F.round("score", 6).alias("score"))


@query(
    "k12_less",
    "WITH " + ULO + f" SELECT config, sample_id, {r('u_lo')} AS score FROM ulo QUALIFY row_number() OVER (PARTITION BY config ORDER BY ulo.u_lo DESC, sample_id) <= {K}",
)
def k12(spark, sf):
    k = resolve_budget(X.pool_vectors(spark, sf), 0.10)
    u = cut_lineage(u_lo(spark, sf)).withColumn("score", F.col("u_lo")).withColumn("_k", k)
    from siftwork.functions.ranks import ranked

    out = ranked(u, ["config"], ["-score", "sample_id"], upto="_k")
    return out.select("config", "sample_id", F.round("score", 6).alias("score"))


@query(
    "k13_lo_proxy_quota",
    "WITH "
    + ULO
    + """, j AS (SELECT u.config AS cfg, u.sample_id, u_lo, cluster_id FROM ulo u JOIN pool USING (sample_id)),
rk AS (SELECT *, row_number() OVER (PARTITION BY cfg, cluster_id ORDER BY u_lo DESC, sample_id) AS rn, count(*) OVER (PARTITION BY cfg, cluster_id) AS size FROM j),
vals AS (SELECT cfg, cluster_id, max(size) AS size, avg(u_lo) FILTER (WHERE rn <= greatest(1, ceil(size * 0.1::DOUBLE))) AS value FROM rk GROUP BY ALL),
alloc_in AS (SELECT *, """
    + K
    + " AS budget FROM vals), "
    + T.budgets_sql("alloc_in", keys="cfg")
    + " SELECT cfg AS config, sample_id FROM rk JOIN budgets USING (cfg, cluster_id) WHERE rn <= b",
)
def k13(spark, sf):
    from siftwork.operators.quota import select_by_quota

    k = resolve_budget(X.pool_vectors(spark, sf), 0.10)
    u = u_lo(spark, sf).join(X.pool_vectors(spark, sf).select("sample_id", "cluster_id"), "sample_id")
    u = cut_lineage(u.withColumn("q", F.col("u_lo")))
    return select_by_quota(u, k, ["config"]).select("config", "sample_id")


NORMED = T.DELTAS + """, nm AS (SELECT *, (rank() OVER w + (count(*) OVER (PARTITION BY peft_id, task_id, anchor_idx, horizon, delta_raw) - 1) / 2.0 - 1)
  / greatest(count(*) OVER (PARTITION BY peft_id, task_id, anchor_idx, horizon) - 1, 1) AS delta_norm FROM deltas
  WINDOW w AS (PARTITION BY peft_id, task_id, anchor_idx, horizon ORDER BY delta_raw))"""
LABELS = NORMED + """, ph AS (SELECT sample_id, peft_id, task_id, horizon, avg(delta_norm) AS m, stddev_samp(delta_norm) AS s, sum(delta_raw) AS raw, count(*) AS n FROM nm GROUP BY ALL),
hi AS (SELECT sample_id, peft_id, task_id, sum(CASE horizon WHEN 1 THEN 0.4 ELSE 0.6 END * m) AS u_hi, coalesce(avg(s), 0) AS sigma_est, sum(raw) / sum(n) AS delta_raw FROM ph GROUP BY ALL)"""


def hi_labels(spark, sf):
    d = cut_lineage(X.deltas(spark, sf))
    return U.aggregate_labels(U.rank_normalised(d))


@query("g05_ranknorm", "WITH " + NORMED + f" SELECT sample_id, peft_id, task_id, anchor_idx, horizon, {r('delta_norm')} AS delta_norm FROM nm")
def g05(spark, sf):
    d = cut_lineage(X.deltas(spark, sf))
    return U.rank_normalised(d).select("sample_id", "peft_id", "task_id", "anchor_idx", "horizon", F.round("delta_norm", 6).alias("delta_norm"))


@query("g06_labels", "WITH " + LABELS + f" SELECT sample_id, peft_id, task_id, {r('u_hi')} AS u_hi, {r('sigma_est')} AS sigma_est, {r('delta_raw', 6)} AS delta_raw FROM hi")
def g06(spark, sf):
    return hi_labels(spark, sf).select(
        "sample_id", "peft_id", "task_id", F.round("u_hi", 6).alias("u_hi"), F.round("sigma_est", 6).alias("sigma_est"), F.round("delta_raw", 6).alias("delta_raw")
    )


@query(
    "g17_ranked_utilities",
    "WITH " + ULO + f""", q AS (SELECT sample_id, config, round(u_lo, 9) AS u FROM ulo)
SELECT sample_id, config, {r('(rank() OVER (PARTITION BY config ORDER BY u) + (count(*) OVER (PARTITION BY config, u) - 1) / 2.0 - 1) / greatest(count(*) OVER (PARTITION BY config) - 1, 1)')} AS u_rank FROM q""",
)
def g17(spark, sf):
    u = cut_lineage(u_lo(spark, sf).withColumn("u", F.round("u_lo", 9)))
    return U.rank_normalised(u, "u", ["config"], "u_rank").select("sample_id", "config", F.round("u_rank", 6).alias("u_rank"))


PHI = "phi AS (SELECT site, i, j, sqrt(-2.0 * ln(('0x' || substr(k, 1, 8))::BIGINT / 4294967296.0::DOUBLE + 1e-12)) * cos(2.0 * pi() * (('0x' || substr(k, 9, 8))::BIGINT / 4294967296.0::DOUBLE)) / sqrt(8.0) AS v FROM (SELECT s.site, i, j, md5('0:' || s.site || ':' || i || ':' || j) AS k FROM range(0, 24) AS s(site), range(0, 8) AS a(i), range(0, 64) AS b(j)))"


@query(
    "c16_projection",
    "WITH "
    + T.POOL
    + ", "
    + PHI
    + f""", pr AS (SELECT sample_id, site, i, sum(v * joint[j + 1]) AS x FROM pool, phi GROUP BY ALL)
SELECT sample_id, site::BIGINT AS site, i::BIGINT AS slot, {r('x / greatest(sqrt(sum(x * x) OVER (PARTITION BY sample_id, site)), 1e-8)')} AS g FROM pr""",
)
def c16(spark, sf):
    p = X.dealt(X.pool_vectors(spark, sf))
    v = p.select("sample_id", F.col("joint").alias("v"), F.explode(F.sequence(F.lit(0), F.lit(X.N_SITES - 1))).alias("site"))
    g = U.project(v, cut_lineage(U.projection_rows(spark, list(range(X.N_SITES)), 8, 64))).select("sample_id", "site", F.posexplode("g").alias("slot", "x"))
    return g.select("sample_id", F.col("site").cast("bigint").alias("site"), F.col("slot").cast("bigint").alias("slot"), F.round("x", 6).alias("g"))


@query("c16_projection_wide")
def c16_wide(spark, sf):
    p = X.dealt(X.pool_vectors(spark, sf))
    v = p.select("sample_id", F.col("joint").alias("v"), F.explode(F.sequence(F.lit(0), F.lit(X.N_SITES - 1))).alias("site"))
    g = U.project_wide(v, d_proj=16)
    return g.groupBy("site").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(V.norm("g")), 6).alias("norm"))
