"""Ranking, window, set and join queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from siftwork.functions.ranks import average_rank, quantiles, ranked
from siftwork.operators import metrics as M
from siftwork.plans import sqltext as T
from siftwork.plans import views as X
from siftwork.plans.catalog import query
from siftwork.plans.selection import COS, cosine_scored
from siftwork.plans.utilities import LABELS, ULO, hi_labels, u_lo
from siftwork.session import cut_lineage

r = T.r

SCORED = (
    COS
    + ", "
    + T.TRUTH
    + """, sc AS (SELECT m AS method, language, sample_id, CASE m WHEN 'cosine' THEN round(c.score, 9) WHEN 'length' THEN length(response)::DOUBLE ELSE (length(instruction) // 20)::DOUBLE END AS pred, u_hi AS truth
  FROM pool p JOIN cosine c USING (sample_id) JOIN truth USING (sample_id), (VALUES ('cosine'), ('length'), ('coarse')) AS t(m))"""
)
BY = ["method", "language"]


def scored(spark, sf):
    """Three predictors against the labels, per language; truth and one predictor have many ties."""
    p = X.pool(spark, sf).select("sample_id", "language", F.length("response").alias("lr"), F.length("instruction").alias("li"))
    d = p.join(cosine_scored(spark, sf).select("sample_id", "score"), "sample_id").join(X.truth(spark, sf), "sample_id")
    preds = F.array(
        F.struct(F.lit("cosine").alias("method"), F.round("score", 9).alias("pred")),
        F.struct(F.lit("length").alias("method"), F.col("lr").cast("double").alias("pred")),
        F.struct(F.lit("coarse").alias("method"), F.floor(F.col("li") / 20).cast("double").alias("pred")),
    )
    d = d.select("language", "sample_id", F.col("u_hi").alias("truth"), F.explode(preds).alias("x"))
    return cut_lineage(d.select("x.method", "language", "sample_id", "x.pred", "truth"))


AVG_RANK = "rank() OVER (PARTITION BY method, language ORDER BY {0}) + (count(*) OVER (PARTITION BY method, language, {0}) - 1) / 2.0"
RANKS = SCORED + f", rk AS (SELECT *, {AVG_RANK.format('pred')} AS rp, {AVG_RANK.format('truth')} AS rt FROM sc)"


@query("h01_average_rank", "WITH " + T.SCALE + f" SELECT sample_id, {r('rank() OVER (PARTITION BY cluster_id ORDER BY q) + (count(*) OVER (PARTITION BY cluster_id, q) - 1) / 2.0')} AS avg_rank FROM scale_rows")
def h01(spark, sf):
    rows = X.scale_rows(spark, sf)
    return average_rank(rows, ["cluster_id"], "q", "avg_rank").select("sample_id", "avg_rank")


@query("h02_bucket_size", "SELECT l_orderkey, l_linenumber, l_quantity, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem")
def h02(spark, sf):
    from siftwork.operators.common import skewed_join

    li = X.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_suppkey")
    # counts combine map-side and come back by a salted join, so a hot key is never gathered
    n = li.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    return skewed_join(li, n, "l_suppkey").drop("l_suppkey")


@query("h05_running_sums", f"WITH s AS (SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL) SELECT l_suppkey, l_returnflag, coalesce(sum(n) OVER (PARTITION BY l_returnflag ORDER BY n DESC, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM s")
def h05(spark, sf):
    s = cut_lineage(X.table(spark, sf, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.count(F.lit(1)).alias("n")))
    # equal counts: rows that lie before times the count; larger counts: a sum over distinct counts
    by_count = s.groupBy("l_returnflag", "n").agg((F.sum("n")).alias("of"))  # no more rows than distinct counts
    larger = W.partitionBy("l_returnflag").orderBy(F.desc("n")).rowsBetween(W.unboundedPreceding, -1)
    above = by_count.withColumn("above", F.coalesce(F.sum("of").over(larger), F.lit(0))).drop("of")
    r = ranked(s, ["l_returnflag", "n"], ["l_suppkey"]).join(above, ["l_returnflag", "n"])
    return r.select("l_suppkey", "l_returnflag", (F.col("above") + (F.col("rn") - 1) * F.col("n")).cast("bigint").alias("before"))


@query("h06_positional_frames", "SELECT conv_id, turn, lead(role) OVER w AS next_role, first_value(role) OVER w AS first_role, last_value(role) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def h06(spark, sf):
    w = W.partitionBy("conv_id").orderBy("turn")
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    c = X.table(spark, sf, "conversations")
    return c.select(
        "conv_id",
        "turn",
        F.lead("role").over(w).alias("next_role"),
        F.first("role").over(w).alias("first_role"),
        F.last("role").over(whole).alias("last_role"),
    )


@query("h07_exact_quantile", f"SELECT l_returnflag, {r('quantile_cont(l_extendedprice, 0.95)', 4)} AS q95, {r('quantile_cont(l_extendedprice, 0.025)', 4)} AS q025 FROM lineitem GROUP BY 1")
def h07(spark, sf):
    q = quantiles(X.table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", q95=0.95, q025=0.025)
    return q.select("l_returnflag", F.round("q95", 4).alias("q95"), F.round("q025", 4).alias("q025"))


query("p01_rank_table", "WITH " + RANKS + f" SELECT method, language, sample_id, {r('rp')} AS rank_pred, {r('rt')} AS rank_truth FROM rk")(
    lambda spark, sf: average_rank(average_rank(scored(spark, sf), BY, "pred", "rank_pred"), BY, "truth", "rank_truth").select(
        *BY, "sample_id", "rank_pred", "rank_truth"
    )
)

SPEARMAN = "CASE WHEN stddev_pop(rp) > 0 AND stddev_pop(rt) > 0 THEN corr(rp, rt) END"


@query("p02_spearman", "WITH " + RANKS + f" SELECT method, language, {r(SPEARMAN)} AS spearman FROM rk GROUP BY ALL")
def p02(spark, sf):
    return M.spearman(scored(spark, sf), BY).withColumn("spearman", F.round("spearman", 6))


KENDALL = """kt AS (SELECT a.method, a.language, sum(sign(a.pred - b.pred) * sign(a.truth - b.truth)) AS s, sum((a.pred = b.pred)::INT) AS tp, sum((a.truth = b.truth)::INT) AS tt, count(*)::DOUBLE AS n0
  FROM sc a JOIN sc b ON a.method = b.method AND a.language = b.language AND a.sample_id < b.sample_id GROUP BY ALL)"""
TAU = "CASE WHEN (n0 - tp) * (n0 - tt) > 0 THEN s / sqrt((n0 - tp) * (n0 - tt)) END"


@query("p03_kendall_tau", "WITH " + SCORED + ", " + KENDALL + f" SELECT method, language, {r(TAU)} AS kendall_tau FROM kt")
def p03(spark, sf):
    return M.kendall_tau(scored(spark, sf), BY, rows_per_task=50).withColumn("kendall_tau", F.round("kendall_tau", 6))


TOPS = """tp AS (SELECT *, row_number() OVER (PARTITION BY method, language ORDER BY pred DESC, sample_id) AS pp, row_number() OVER (PARTITION BY method, language ORDER BY truth DESC, sample_id) AS pt,
  truth - min(truth) OVER (PARTITION BY method, language) AS gain, count(*) OVER (PARTITION BY method, language) AS n FROM sc)"""
NDCG = "CASE WHEN sum(gain / log2(pt + 1)) FILTER (WHERE pt <= {k}) > 0 THEN sum(gain / log2(pp + 1)) FILTER (WHERE pp <= {k}) / sum(gain / log2(pt + 1)) FILTER (WHERE pt <= {k}) ELSE 0 END"
HIT = "count(*) FILTER (WHERE pp <= {k} AND pt <= {k})::DOUBLE / count(*) FILTER (WHERE pt <= {k})"


@query("p04_ndcg", "WITH " + SCORED + ", " + TOPS + f" SELECT method, language, {r(NDCG.format(k=20))} AS ndcg_at_k FROM tp GROUP BY ALL")
def p04(spark, sf):
    return M.ndcg(scored(spark, sf), BY, 20).withColumn("ndcg_at_k", F.round("ndcg_at_k", 6))


for _name in ("p05_top_k_hit_rate", "j06_top_k_intersection"):
    _k = 20 if _name[0] == "p" else 50
    query(_name, "WITH " + SCORED + ", " + TOPS + f" SELECT method, language, {r(HIT.format(k=_k))} AS topk_hit_rate FROM tp GROUP BY ALL")(
        lambda spark, sf, k=_k: M.hit_rate(scored(spark, sf), BY, k).withColumn("topk_hit_rate", F.round("topk_hit_rate", 6))
    )

PAIRS = """ix AS (SELECT *, row_number() OVER (PARTITION BY method, language ORDER BY sample_id) - 1 AS at, count(*) OVER (PARTITION BY method, language) AS n FROM sc),
dr AS (SELECT method, language, p, ('0x' || substr(md5('0:i:' || p), 1, 8))::BIGINT % n AS i, ('0x' || substr(md5('0:j:' || p), 1, 8))::BIGINT % n AS j FROM (SELECT DISTINCT method, language, n FROM ix), range(1, 5001) AS x(p) WHERE n >= 2),
pw AS (SELECT d.method, d.language, avg((sign(a.pred - b.pred) = sign(a.truth - b.truth))::INT) AS acc FROM dr d
  JOIN ix a ON a.method = d.method AND a.language = d.language AND a.at = d.i JOIN ix b ON b.method = d.method AND b.language = d.language AND b.at = d.j WHERE i <> j AND a.truth <> b.truth GROUP BY ALL)"""


@query("p06_pairwise_accuracy", "WITH " + SCORED + ", " + PAIRS + f" SELECT method, language, {r('acc')} AS pairwise_acc FROM pw")
def p06(spark, sf):
    return M.pairwise_accuracy(scored(spark, sf), BY).withColumn("pairwise_acc", F.round("pairwise_acc", 6))


@query(
    "p08_all_metrics",
    "WITH " + RANKS + ", " + KENDALL + ", " + TOPS + ", " + PAIRS + f""", s AS (SELECT method, language, {SPEARMAN} AS sp FROM rk GROUP BY ALL),
t AS (SELECT method, language, {NDCG.format(k=100)} AS nd, {HIT.format(k=100)} AS hit FROM tp GROUP BY ALL)
SELECT s.method, s.language, {r('sp')} AS spearman, {r(TAU)} AS kendall_tau, {r('nd')} AS ndcg_at_k, {r('hit')} AS topk_hit_rate, {r('acc')} AS pairwise_acc
FROM s LEFT JOIN kt USING (method, language) LEFT JOIN t USING (method, language) LEFT JOIN pw USING (method, language)""",
)
def p08(spark, sf):
    m = M.ranking_metrics(scored(spark, sf), BY)
    return m.select(*BY, *[F.round(c, 6).alias(c) for c in m.columns if c not in BY])


@query("p09_label_agreement", "WITH " + ULO + ", " + T.TRUTH + f""", j AS (SELECT config, round(u_lo, 9) AS u, u_hi FROM ulo JOIN truth USING (sample_id)),
rr AS (SELECT config, rank() OVER (PARTITION BY config ORDER BY u) + (count(*) OVER (PARTITION BY config, u) - 1) / 2.0 AS rp, rank() OVER (PARTITION BY config ORDER BY u_hi) + (count(*) OVER (PARTITION BY config, u_hi) - 1) / 2.0 AS rt FROM j)
SELECT config, {r(SPEARMAN)} AS spearman FROM rr GROUP BY 1""")
def p09(spark, sf):
    j = u_lo(spark, sf).join(X.truth(spark, sf), "sample_id").select("config", F.round("u_lo", 9).alias("pred"), F.col("u_hi").alias("truth"))
    return M.spearman(cut_lineage(j), ["config"]).withColumn("spearman", F.round("spearman", 6))


# ------------------------------------------------------------------- sets

MEMBERS = T.DELTAS + """, mx AS (SELECT task_id, peft_id, sample_id, max(delta_raw) AS d FROM deltas GROUP BY ALL),
mem AS (SELECT task_id, peft_id AS config, sample_id FROM (SELECT *, row_number() OVER (PARTITION BY task_id, peft_id ORDER BY d DESC, sample_id) AS rn, count(*) OVER (PARTITION BY task_id, peft_id) AS n FROM mx) WHERE rn <= greatest(1, round_even(0.1 * n, 0)))"""
JAC = """sz AS (SELECT task_id, config, count(*) AS n FROM mem GROUP BY ALL),
jc AS (SELECT a.task_id, a.config AS "left", b.config AS "right", coalesce(i.inter, 0) AS inter, a.n AS na, b.n AS nb FROM sz a JOIN sz b USING (task_id)
  LEFT JOIN (SELECT x.task_id, x.config AS l, y.config AS rr, count(*) AS inter FROM mem x JOIN mem y USING (task_id, sample_id) GROUP BY ALL) i ON i.task_id = a.task_id AND i.l = a.config AND i.rr = b.config)"""


def top_members(spark, sf):
    """The tenth of the rows with the largest delta per (task, config), one at least."""
    d = X.deltas(spark, sf).groupBy("task_id", F.col("peft_id").alias("config"), "sample_id").agg(F.max("delta_raw").alias("d"))
    top = ranked(cut_lineage(d), ["task_id", "config"], ["-d", "sample_id"], size_name="_n")
    return top.where(F.col("rn") <= F.greatest(F.lit(1.0), F.bround(F.col("_n") * F.lit(0.1)))).select("task_id", "config", "sample_id")


for _name in ("j01_jaccard", "j02_overlap_matrix"):
    query(_name, "WITH " + MEMBERS + ", " + JAC + f' SELECT task_id, "left", "right", {r("inter::DOUBLE / (na + nb - inter)")} AS jaccard FROM jc' + (' WHERE "left" < "right"' if _name[1] == "0" and _name[2] == "1" else ""))(
        lambda spark, sf, upper=_name.startswith("j01"): M.overlap(top_members(spark, sf), "config", ["task_id"])
        .where(F.col("left") < F.col("right") if upper else F.lit(True))
        .select("task_id", "left", "right", F.round("jaccard", 6).alias("jaccard"))
    )


@query("j03_common_ids", "WITH " + MEMBERS + " SELECT task_id, sample_id FROM (SELECT task_id, sample_id, count(DISTINCT config) AS h FROM mem GROUP BY ALL) JOIN (SELECT task_id, count(DISTINCT config) AS p FROM mem GROUP BY ALL) USING (task_id) WHERE h = p")
def j03(spark, sf):
    return M.common_to_all(top_members(spark, sf), by=["task_id"])


@query("j04_union_of_signals", "WITH " + T.DELTAS + ", " + T.TRUTH + " SELECT 'delta' AS signal, sample_id, count(*) AS n FROM deltas GROUP BY ALL UNION ALL SELECT 'truth', sample_id, count(*) FROM truth GROUP BY ALL")
def j04(spark, sf):
    a = X.deltas(spark, sf).select(F.lit("delta").alias("signal"), "sample_id")
    b = X.truth(spark, sf).select(F.lit("truth").alias("signal"), "sample_id")
    return a.unionByName(b).groupBy("signal", "sample_id").agg(F.count(F.lit(1)).alias("n"))


@query("j05_missing_ids", "SELECT vec_id AS sample_id FROM embeddings EXCEPT SELECT doc_id FROM labels")
def j05(spark, sf):
    from siftwork.operators.common import missing

    return missing(X.vectors(spark, sf), X.truth(spark, sf)).distinct()


# ------------------------------------------------------------------ joins


@query("f01_training_lookup", "WITH " + T.DELTAS + " SELECT d.peft_id, d.task_id, count(*) AS n, count(DISTINCT p_brand) AS n_brands FROM deltas d JOIN part ON p_partkey = sample_id GROUP BY ALL")
def f01(spark, sf):
    part = X.table(spark, sf, "part").select(F.col("p_partkey").alias("sample_id"), "p_brand")
    j = X.deltas(spark, sf).join(part, "sample_id")
    return j.groupBy("peft_id", "task_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("p_brand").alias("n_brands"))


@query("f02_labels_left_join", "WITH " + LABELS + ", lo AS (SELECT sample_id, peft_id, task_id, avg(delta_raw) AS u_lo FROM deltas WHERE horizon = 1 AND anchor_idx = 0 GROUP BY ALL)" + f" SELECT sample_id, peft_id, task_id, {r('u_hi')} AS u_hi, {r('lo.u_lo', 4)} AS u_lo FROM hi LEFT JOIN lo USING (sample_id, peft_id, task_id)")
def f02(spark, sf):
    keys = ["sample_id", "peft_id", "task_id"]
    lo = X.deltas(spark, sf).where("horizon = 1 and anchor_idx = 0").groupBy(*keys).agg(F.avg("delta_raw").alias("u_lo"))
    return hi_labels(spark, sf).join(lo, keys, "left").select(*keys, F.round("u_hi", 6).alias("u_hi"), F.round("u_lo", 4).alias("u_lo"))


@query("f03_truth_inner_join", "WITH " + SCORED + " SELECT method, language, count(*) AS n FROM sc GROUP BY ALL HAVING count(*) >= 2")
def f03(spark, sf):
    return scored(spark, sf).groupBy(*BY).agg(F.count(F.lit(1)).alias("n")).where("n >= 2")


@query("f04_condition_vector", "WITH " + T.SKETCH + ", " + T.QUERY_VECTOR + f" SELECT sample_id, {r('list_dot_product(joint, q)')} AS dot FROM pool, qv")
def f04(spark, sf):
    from siftwork.functions import vectors as V
    from siftwork.operators.common import attach
    from siftwork.plans.selection import sketch_query

    d = attach(X.pool_vectors(spark, sf), sketch_query(spark, sf))
    return d.select("sample_id", F.round(V.dot("joint", "q"), 6).alias("dot"))


@query("f05_triples", "WITH " + T.TRUTH + " SELECT sample_id, c AS config, t AS task, u_hi FROM truth, (VALUES ('AD-b64'), ('L-r8-qv')) AS a(c), (VALUES ('gsm8k'), ('mmlu')) AS b(t)")
def f05(spark, sf):
    # configurations and tasks are expanded inside each row, no join is needed
    d = X.truth(spark, sf)
    d = d.withColumn("config", F.explode(F.array(F.lit("AD-b64"), F.lit("L-r8-qv"))))
    return d.withColumn("task", F.explode(F.array(F.lit("gsm8k"), F.lit("mmlu")))).select("sample_id", "config", "task", "u_hi")


@query("f06_semi_join", "WITH " + T.DELTAS + " SELECT sample_id, peft_id, task_id, anchor_idx, horizon FROM deltas WHERE sample_id IN (SELECT doc_id FROM labels)")
def f06(spark, sf):
    d = X.deltas(spark, sf).join(X.truth(spark, sf).select("sample_id"), "sample_id", "left_semi")
    return d.select("sample_id", "peft_id", "task_id", "anchor_idx", "horizon")


@query("f07_anti_join", "WITH " + T.DELTAS + " SELECT sample_id, peft_id, task_id, anchor_idx, horizon FROM deltas WHERE sample_id NOT IN (SELECT doc_id FROM labels)")
def f07(spark, sf):
    d = X.deltas(spark, sf).join(X.truth(spark, sf).select("sample_id"), "sample_id", "left_anti")
    return d.select("sample_id", "peft_id", "task_id", "anchor_idx", "horizon")
