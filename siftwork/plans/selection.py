"""Selection queries: scores, quotas and the strategies."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwork.functions import vectors as V
from siftwork.functions.ranks import ranked
from siftwork.operators import quota as Q
from siftwork.operators import selectors as S
from siftwork.operators.common import resolve_budget
from siftwork.operators.sampling import balanced_sample, uniform_sample
from siftwork.plans import sqltext as T
from siftwork.plans import views as X
from siftwork.plans.catalog import query
from siftwork.session import cut_lineage

r = T.r


def sketch_query(spark, sf):
    """One row: the mean sketch embedding."""
    return V.vector_mean(X.sketch(spark, sf), "joint", name="q")


def cosine_scored(spark, sf):
    """(id, cluster, score), stored: ranking reads it three times, the wide vectors only once."""
    scored = S.cosine_scores(X.pool_vectors(spark, sf), sketch_query(spark, sf))
    return cut_lineage(scored.select("sample_id", "cluster_id", "score"))


COS = (
    T.SKETCH
    + ", "
    + T.QUERY_VECTOR
    + """, cosine AS (
  SELECT sample_id, cluster_id, list_dot_product(joint, q)
         / ((sqrt(list_dot_product(joint, joint)) + 1e-8) * (sqrt(list_dot_product(q, q)) + 1e-8)) AS score
  FROM pool, qv)"""
)
K = "greatest(1, round_even(0.10 * (SELECT count(*) FROM pool), 0))::BIGINT"

QUOTA = (
    COS
    + """, rk AS (
  SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY score DESC, sample_id) AS rn,
         count(*) OVER (PARTITION BY cluster_id) AS size FROM cosine),
vals AS (
  SELECT cluster_id, max(size) AS size, avg(score) FILTER (WHERE rn <= greatest(1, ceil(size * 0.1::DOUBLE))) AS value
  FROM rk GROUP BY 1),
alloc_in AS (SELECT *, """
    + K
    + """ AS budget FROM vals)"""
)


def cosine_quota(spark, sf, budget=0.10):
    scored = cosine_scored(spark, sf).withColumn("q", F.col("score"))
    return Q.select_by_quota(scored, resolve_budget(X.pool_vectors(spark, sf), budget))


@query(
    "k16_quota_selection",
    "WITH "
    + QUOTA
    + ", "
    + T.budgets_sql("alloc_in")
    + f""" SELECT sample_id, rk.cluster_id, rn::BIGINT AS rank_in_cluster, {r('score')} AS q
FROM rk JOIN budgets USING (cluster_id) WHERE rn <= b""",
)
def k16(spark, sf):
    return cosine_quota(spark, sf).select(
        "sample_id", "cluster_id", F.col("rank_in_cluster").cast("bigint").alias("rank_in_cluster"), F.round("q", 6).alias("q")
    )


@query("n04_budgets", "WITH " + QUOTA + ", " + T.budgets_sql("alloc_in") + f" SELECT cluster_id, size::BIGINT AS size, {r('value')} AS value, b FROM budgets")
def n04(spark, sf):
    scored = cosine_scored(spark, sf).withColumn("q", F.col("score"))
    v = Q.cluster_values(Q.rank_in_clusters(scored)).withColumn(
        "budget", resolve_budget(X.pool_vectors(spark, sf), 0.10)
    )
    return Q.allocate(v).select("cluster_id", "size", F.round("value", 6).alias("value"), "b")


@query(
    "n06_budgets_with_floor",
    "WITH " + QUOTA + ", " + T.budgets_sql("alloc_in", floor="greatest(2, floor(0.1 * budget / (SELECT count(*) FROM vals))::BIGINT)") + " SELECT cluster_id, b FROM budgets",
)
def n06(spark, sf):
    scored = cosine_scored(spark, sf).withColumn("q", F.col("score"))
    v = Q.cluster_values(Q.rank_in_clusters(scored)).withColumn(
        "budget", resolve_budget(X.pool_vectors(spark, sf), 0.10)
    )
    from pyspark.sql.window import Window as W

    n = F.count(F.lit(1)).over(W.partitionBy(F.lit(0)))  # cluster-sized frame
    least = F.greatest(F.lit(2), F.floor(0.1 * F.col("budget") / F.col("n_clusters")))
    return Q.allocate(v.withColumn("n_clusters", n), min_cluster=least).select("cluster_id", "b")


@query(
    "n08_budgets_proportional_leftover",
    "WITH "
    + QUOTA
    + """, a1 AS (SELECT *, greatest(value - least(min(value) OVER (), 0), 0) AS sh FROM alloc_in),
a2 AS (SELECT *, CASE WHEN max(sh) OVER () <= 1e-12 THEN 1 ELSE power(sh, 0.6) END * power(size, 0.4) AS w FROM a1),
a3 AS (SELECT *, budget * w / greatest(sum(w) OVER (), 1e-12) AS share FROM a2),
a4 AS (SELECT *, least(floor(share), size) AS b0 FROM a3),
a5 AS (SELECT *, least(size - b0, 1) AS one, budget - sum(b0) OVER () AS rem FROM a4),
a6 AS (SELECT *, b0 + least(one, greatest(0, rem - coalesce(sum(one) OVER (ORDER BY share - floor(share) DESC, w DESC, cluster_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS b1 FROM a5),
a7 AS (SELECT *, budget - sum(b1) OVER () AS rem1 FROM a6)
SELECT cluster_id, (b1 + least(size - b1, greatest(0, rem1 - coalesce(sum(size - b1) OVER (ORDER BY w DESC, cluster_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))))::BIGINT AS b FROM a7""",
)
def n08(spark, sf):
    scored = cosine_scored(spark, sf).withColumn("q", F.col("score"))
    v = Q.cluster_values(Q.rank_in_clusters(scored)).withColumn(
        "budget", resolve_budget(X.pool_vectors(spark, sf), 0.10)
    )
    return Q.allocate(v, leftover="proportional").select("cluster_id", "b")


@query(
    "n05_scale_quota_selection",
    "WITH "
    + T.SCALE
    + """, rk AS (
  SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY q DESC, sample_id) AS rn,
         count(*) OVER (PARTITION BY cluster_id) AS size FROM scale_rows),
vals AS (SELECT cluster_id, max(size) AS size, avg(q) FILTER (WHERE rn <= greatest(1, ceil(size * 0.1::DOUBLE))) AS value FROM rk GROUP BY 1),
alloc_in AS (SELECT *, greatest(1, round_even(0.1 * (SELECT count(*) FROM scale_rows), 0))::BIGINT AS budget FROM vals), """
    + T.budgets_sql("alloc_in")
    + """ SELECT sample_id, rk.cluster_id, rn::BIGINT AS rank_in_cluster FROM rk JOIN budgets USING (cluster_id) WHERE rn <= b""",
)
def n05(spark, sf):
    rows = X.scale_rows(spark, sf)
    return Q.select_by_quota(rows, resolve_budget(rows, 0.10)).select(
        "sample_id", "cluster_id", F.col("rank_in_cluster").cast("bigint").alias("rank_in_cluster")
    )


@query(
    "g07_cluster_values",
    "WITH "
    + T.SCALE
    + f""", rk AS (
  SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY q DESC, sample_id) AS rn, count(*) OVER (PARTITION BY cluster_id) AS size FROM scale_rows)
SELECT cluster_id, max(size)::BIGINT AS size, {r('avg(q) FILTER (WHERE rn <= greatest(1, ceil(size * 0.1::DOUBLE)))', 4)} AS value FROM rk GROUP BY 1""",
)
def g07(spark, sf):
    v = Q.cluster_values(Q.rank_in_clusters(X.scale_rows(spark, sf)))
    return v.select("cluster_id", "size", F.round("value", 4).alias("value"))


@query(
    "h03_rank_in_cluster",
    "WITH " + T.SCALE + " SELECT sample_id, cluster_id, row_number() OVER (PARTITION BY cluster_id ORDER BY q DESC, sample_id)::BIGINT AS rn FROM scale_rows",
)
def h03(spark, sf):
    return ranked(X.scale_rows(spark, sf), ["cluster_id"], ["-q", "sample_id"]).select("sample_id", "cluster_id", F.col("rn").cast("bigint").alias("rn"))


@query(
    "h04_round_robin",
    "WITH "
    + T.SCALE
    + """, w AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY q DESC, sample_id) AS rn FROM scale_rows)
SELECT sample_id, cluster_id, rn::BIGINT AS round FROM w ORDER BY rn, cluster_id, sample_id LIMIT 1000""",
)
def h04(spark, sf):
    return S.round_robin(X.scale_rows(spark, sf), "cluster_id", ["-q", "sample_id"], 1000).select(
        "sample_id", "cluster_id", F.col("round").cast("bigint").alias("round")
    )


@query(
    "i01_global_top_k",
    "WITH "
    + T.SCALE
    + f" SELECT sample_id, {r('q', 2)} AS q FROM scale_rows ORDER BY scale_rows.q DESC, sample_id LIMIT (SELECT round_even(0.1 * count(*), 0)::BIGINT FROM scale_rows)",
)
def i01(spark, sf):
    rows = X.scale_rows(spark, sf)
    return S.top_by(rows, "q", resolve_budget(rows, 0.10)).select("sample_id", F.round("q", 2).alias("q"))


@query(
    "i03_top_fraction_per_group",
    "WITH "
    + T.SCALE
    + """, w AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY q DESC, sample_id) AS rn, count(*) OVER (PARTITION BY cluster_id) AS n FROM scale_rows)
SELECT sample_id, cluster_id FROM w WHERE rn <= greatest(1, round_even(0.05 * n, 0))""",
)
def i03(spark, sf):
    rows = X.scale_rows(spark, sf)
    d = ranked(rows, ["cluster_id"], ["-q", "sample_id"], size_name="n")
    return d.where(F.col("rn") <= F.greatest(F.lit(1.0), F.bround(0.05 * F.col("n")))).select("sample_id", "cluster_id")


@query("i02_top_k_per_group", "WITH " + T.SCALE + " SELECT sample_id, cluster_id FROM scale_rows QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY q DESC, sample_id) <= 20")
def i02(spark, sf):
    from pyspark.sql.window import Window as W

    rn = F.row_number().over(W.partitionBy("cluster_id").orderBy(F.desc("q"), "sample_id"))
    # a constant bound: each task keeps 20 rows per group before the shuffle
    return X.scale_rows(spark, sf).withColumn("rn", rn).where("rn <= 20").select("sample_id", "cluster_id")


@query("i04_first_n", "WITH " + T.POOL_TEXT + " SELECT sample_id, source FROM pool_text ORDER BY sample_id LIMIT 100")
def i04(spark, sf):
    return X.pool_text(spark, sf).orderBy("sample_id").limit(100).select("sample_id", "source")


def _ids(df):
    return df.select("sample_id")


@query("k01_random", "WITH " + T.POOL + f" SELECT sample_id FROM pool ORDER BY md5('0:' || sample_id), sample_id LIMIT ({K.replace('::BIGINT','::BIGINT')})")
def k01(spark, sf):
    p = X.pool_vectors(spark, sf)
    return _ids(uniform_sample(p, resolve_budget(p, 0.10)))


@query(
    "k02_balanced_random",
    "WITH "
    + T.POOL
    + f""", w AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY md5('0:' || sample_id), sample_id) AS rn FROM pool)
SELECT sample_id, cluster_id FROM w WHERE rn <= greatest(1, {K} // (SELECT count(DISTINCT cluster_id) FROM pool))
ORDER BY cluster_id, rn LIMIT ({K})""",
)
def k02(spark, sf):
    p = X.pool_vectors(spark, sf)
    return balanced_sample(p, resolve_budget(p, 0.10)).select("sample_id", "cluster_id")


@query("k03_length", "WITH " + T.POOL + f" SELECT sample_id, {r('ln(1 + length(response))')} AS score FROM pool ORDER BY length(response) DESC, sample_id LIMIT ({K})")
def k03(spark, sf):
    p = X.pool(spark, sf).select("sample_id", F.log1p(F.length("response")).alias("len_resp"))
    return S.select("length", {"pool": p}, resolve_budget(X.pool_vectors(spark, sf), 0.10)).select(
        "sample_id", F.round("score", 6).alias("score")
    )


EXTERNAL = T.POOL + ", ext AS (SELECT sample_id, (('0x' || substr(md5('ifd:' || sample_id), 1, 6))::BIGINT % 1000)::DOUBLE AS ifd, (('0x' || substr(md5('s2l:' || sample_id), 1, 6))::BIGINT % 1000)::DOUBLE AS s2l FROM pool)"


def external_scores(spark, sf):
    from siftwork.functions.ids import hash_index, order_key

    p = X.pool_vectors(spark, sf).select("sample_id")

    def score(name):
        return F.pmod(F.conv(F.substring(order_key(name, "sample_id"), 1, 6), 16, 10).cast("bigint"), F.lit(1000)).cast("double")

    return p.select("sample_id", score("ifd").alias("ifd"), score("s2l").alias("s2l"))


def _external(spark, sf, name):
    from siftwork.sources.tables import join_external_scores

    p = X.pool_vectors(spark, sf).select("sample_id")
    scored = join_external_scores(p, external_scores(spark, sf))
    return S.select(name, {"pool": scored}, resolve_budget(p, 0.10)).select("sample_id", "score")


for _name in ("ifd", "s2l"):
    query(
        f"k0{6 if _name == 'ifd' else 7}_{_name}",
        "WITH " + EXTERNAL + f" SELECT sample_id, {_name} AS score FROM ext ORDER BY {_name} DESC, sample_id LIMIT ({K})",
    )(lambda spark, sf, n=_name: _external(spark, sf, n))


STD = (
    T.SKETCH
    + ", "
    + T.QUERY_VECTOR
    + """, st AS (SELECT list(m ORDER BY i) AS mean, list(s ORDER BY i) AS sd FROM (
  SELECT i, avg(joint[i]) AS m, stddev_pop(joint[i]) AS s FROM pool, range(1, 65) AS d(i) GROUP BY i)),
zz AS (SELECT sample_id, cluster_id,
  list_transform(range(1, 65), lambda i: (joint[i] - mean[i]) / (sd[i] + 1e-6)) AS z,
  list_transform(range(1, 65), lambda i: (q[i] - mean[i]) / (sd[i] + 1e-6)) AS zq FROM pool, st, qv),
rds AS (SELECT sample_id, cluster_id, list_dot_product(z, zq) / ((sqrt(list_dot_product(z, z)) + 1e-8) * (sqrt(list_dot_product(zq, zq)) + 1e-8)) AS score FROM zz)"""
)


@query("k08_rds_plus", "WITH " + STD + f" SELECT sample_id, {r('score')} AS score FROM rds ORDER BY rds.score DESC, sample_id LIMIT ({K})")
def k08(spark, sf):
    p = X.pool_vectors(spark, sf)
    out = S.select("rds_plus", {"pool": p, "query": sketch_query(spark, sf)}, resolve_budget(p, 0.10))
    return out.select("sample_id", F.round("score", 6).alias("score"))


@query("k09_embedding_nn", "WITH " + COS + f" SELECT sample_id, {r('score')} AS score FROM cosine ORDER BY cosine.score DESC, sample_id LIMIT ({K})")
def k09(spark, sf):
    p = X.pool_vectors(spark, sf)
    out = S.select("embedding_nn", {"pool": p, "query": sketch_query(spark, sf)}, resolve_budget(p, 0.10))
    return out.select("sample_id", F.round("score", 6).alias("score"))


@query(
    "k10_diversity",
    "WITH "
    + T.POOL
    + f""", ce AS (SELECT cluster_id, list(m ORDER BY i) AS c FROM (SELECT cluster_id, i, avg(joint[i]) AS m FROM pool, range(1, 65) AS d(i) GROUP BY ALL) GROUP BY 1),
di AS (SELECT sample_id, cluster_id, list_distance(joint, c) AS distance FROM pool JOIN ce USING (cluster_id)),
rr AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY distance, sample_id) AS rn FROM di)
SELECT sample_id, cluster_id, rn::BIGINT AS round, {r('distance')} AS distance FROM rr ORDER BY rn, cluster_id, sample_id LIMIT ({K})""",
)
def k10(spark, sf):
    p = X.pool_vectors(spark, sf)
    out = S.select("diversity", {"pool": p}, resolve_budget(p, 0.10))
    return out.select("sample_id", "cluster_id", F.col("round").cast("bigint").alias("round"), F.round("distance", 6).alias("distance"))


@query("k21_full_pool", "WITH " + T.POOL + " SELECT sample_id, cluster_id FROM pool")
def k21(spark, sf):
    return X.pool_vectors(spark, sf).select("sample_id", "cluster_id")


@query(
    "k22_equal_quota",
    "WITH "
    + COS
    + f""", rr AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY score DESC, sample_id) AS rn FROM cosine)
SELECT sample_id, cluster_id, rn::BIGINT AS round FROM rr ORDER BY rn, cluster_id, sample_id LIMIT ({K})""",
)
def k22(spark, sf):
    scored = cosine_scored(spark, sf)
    k = resolve_budget(X.pool_vectors(spark, sf), 0.10)
    return S.round_robin(scored, "cluster_id", ["-score", "sample_id"], k).select(
        "sample_id", "cluster_id", F.col("round").cast("bigint").alias("round")
    )


@query(
    "k18_source_by_truth",
    "WITH " + T.POOL + ", " + T.TRUTH + f", j AS (SELECT sample_id, avg(u_hi) AS u FROM truth JOIN pool USING (sample_id) GROUP BY 1) SELECT sample_id, {r('u')} AS u FROM j ORDER BY j.u DESC, sample_id LIMIT (SELECT greatest(1, round_even(0.1 * count(*), 0))::BIGINT FROM j)",
)
def k18(spark, sf):
    t = X.truth(spark, sf).join(X.pool_vectors(spark, sf).select("sample_id"), "sample_id")
    u = t.groupBy("sample_id").agg(F.avg("u_hi").alias("u"))
    return S.top_by(u, "u", resolve_budget(u, 0.10)).select("sample_id", F.round("u", 6).alias("u"))


SWEEP_ALPHAS = (0.0, 0.3, 0.6, 0.9, 1.0)
SWEEP_PENALTIES = (0.0, 0.2)


def sweep_rows(spark, sf):
    """Scores with every (alpha, penalty) of the ablation; sigma is the distance to the own centroid."""
    scored = S.centroid_distances(S.cosine_scores(X.pool_vectors(spark, sf), sketch_query(spark, sf)))
    grid = F.array(
        *[F.struct(F.lit(a).alias("alpha"), F.lit(p).alias("penalty")) for a in SWEEP_ALPHAS for p in SWEEP_PENALTIES]
    )
    g = scored.select("sample_id", "cluster_id", F.col("score").alias("mu"), F.col("distance").alias("sigma"), F.explode(grid).alias("g"))
    return cut_lineage(g).select("sample_id", "cluster_id", "g.*", (F.col("mu") - F.col("g.penalty") * F.col("sigma")).alias("q"))


@query(
    "k17_ablation_sweep",
    "WITH "
    + COS
    + """, ce AS (SELECT cluster_id, list(m ORDER BY i) AS c FROM (SELECT cluster_id, i, avg(joint[i]) AS m FROM pool, range(1, 65) AS d(i) GROUP BY ALL) GROUP BY 1),
sw AS (SELECT p.sample_id, p.cluster_id, alpha, penalty, c.score - penalty * list_distance(p.joint, ce.c) AS q
  FROM pool p JOIN cosine c USING (sample_id) JOIN ce ON ce.cluster_id = p.cluster_id,
  (VALUES (0.0::DOUBLE), (0.3), (0.6), (0.9), (1.0)) AS a(alpha), (VALUES (0.0::DOUBLE), (0.2)) AS l(penalty)),
rk AS (SELECT *, row_number() OVER (PARTITION BY alpha, penalty, cluster_id ORDER BY q DESC, sample_id) AS rn,
  count(*) OVER (PARTITION BY alpha, penalty, cluster_id) AS size FROM sw),
vals AS (SELECT alpha, penalty, cluster_id, max(size) AS size, avg(q) FILTER (WHERE rn <= greatest(1, ceil(size * 0.1::DOUBLE))) AS value FROM rk GROUP BY ALL),
alloc_in AS (SELECT *, """
    + K
    + " AS budget FROM vals), "
    + T.budgets_sql("alloc_in", alpha="alpha", keys="alpha, penalty")
    + """, picked AS (SELECT rk.* FROM rk JOIN budgets b USING (alpha, penalty, cluster_id) WHERE rn <= b.b),
tops AS (SELECT DISTINCT ON (penalty, sample_id) penalty, sample_id, q, row_number() OVER (PARTITION BY penalty, alpha ORDER BY q DESC, sample_id) AS rn FROM sw WHERE alpha = 0.6)
SELECT 'adaptive' AS strategy, alpha, penalty, sample_id FROM picked
UNION ALL SELECT 'global_topk', NULL, penalty, sample_id FROM tops WHERE rn <= """
    + K,
)
def k17(spark, sf):
    rows = sweep_rows(spark, sf)
    k = resolve_budget(X.pool_vectors(spark, sf), 0.10)
    picked = Q.select_by_quota(rows, k, ["alpha", "penalty"], alpha="alpha")
    adaptive = picked.select(F.lit("adaptive").alias("strategy"), "alpha", "penalty", "sample_id")
    one = rows.where("alpha = 0.6").withColumn("_k", k)
    tops = ranked(one, ["penalty"], ["-q", "sample_id"], upto="_k")
    return adaptive.unionByName(
        tops.select(F.lit("global_topk").alias("strategy"), F.lit(None).cast("double").alias("alpha"), "penalty", "sample_id")
    )


@query(
    "k15_dense_scores",
    "WITH "
    + STD
    + f""", cosine AS (SELECT sample_id, list_dot_product(joint, q) / ((sqrt(list_dot_product(joint, joint)) + 1e-8) * (sqrt(list_dot_product(q, q)) + 1e-8)) AS score FROM pool, qv)
SELECT 'embedding_nn' AS method, sample_id, {r('score')} AS score FROM cosine
UNION ALL SELECT 'rds_plus', sample_id, {r('score')} FROM rds
UNION ALL SELECT 'length', sample_id, {r('ln(1 + length(response))')} FROM pool""",
)
def k15(spark, sf):
    p = X.pool_vectors(spark, sf)
    q = sketch_query(spark, sf)
    length = X.pool(spark, sf).select("sample_id", F.log1p(F.length("response")).alias("score"))
    out = S.dense_scores(
        {"embedding_nn": S.cosine_scores(p, q), "rds_plus": S.standardized_cosine_scores(p, q), "length": length}
    )
    return out.select("method", "sample_id", F.round("score", 6).alias("score"))
