"""Paired statistics and agreement matrices."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from siftwork.operators import configs as C
from siftwork.operators import metrics as M
from siftwork.operators import paired as P
from siftwork.operators import reports as R
from siftwork.plans import sqltext as T
from siftwork.plans import views as X
from siftwork.plans.catalog import query
from siftwork.plans.configurations import NAME_FEATURES, REGISTRY
from siftwork.plans.reports import rounded
from siftwork.plans.selection import K
from siftwork.plans.utilities import ULO, u_lo
from siftwork.session import cut_lineage
from siftwork.sources import registry as REG

r = T.r
CELLS = "WITH " + T.RESULTS + ", cells AS (SELECT config, task, avg(metric) FILTER (WHERE method = 'view') AS a, avg(metric) FILTER (WHERE method = 'click') AS b, avg(metric) FILTER (WHERE method = 'view') - avg(metric) FILTER (WHERE method = 'click') AS diff FROM results GROUP BY ALL)"


def cells(spark, sf):
    return P.paired_cells(X.results(spark, sf), "view", "click", ["config", "task"])


@query("f11_paired_join", CELLS + f" SELECT config, task, {r('a')} AS a, {r('b')} AS b FROM cells")
def f11(spark, sf):
    return rounded(cells(spark, sf).select("config", "task", "a", "b"), "a", "b")


@query("t12_paired_difference", CELLS + f" SELECT {r('avg(diff)')} AS mean, sum((diff > 0)::INT)::BIGINT AS wins, count(*) AS n FROM cells")
def t12(spark, sf):
    return rounded(P.paired_summary(cells(spark, sf)).select("mean", "wins", "n"), "mean")


DRAWS = """ix AS (SELECT {p}diff, row_number() OVER ({part}ORDER BY config, task) - 1 AS pos, count(*) OVER ({win}) AS n FROM cells),
dr AS (SELECT rep, {p}('0x' || substr(md5('0:' || {k} || ':' || rep || ':' || draw), 1, 8))::BIGINT % n AS pos FROM (SELECT DISTINCT {p}n FROM ix), range(1, 1001) AS a(rep), range(1, 21) AS b(draw) WHERE draw <= n),
bm AS (SELECT rep, avg(m) AS m FROM (SELECT rep, {p}avg(diff) AS m FROM dr JOIN ix USING ({u}pos) GROUP BY ALL) GROUP BY 1)"""


@query("t13_bootstrap", CELLS + ", " + DRAWS.format(p="", part="", win="", k="0", u="") + f" SELECT {r('quantile_cont(m, 0.025)')} AS lo, {r('quantile_cont(m, 0.975)')} AS hi FROM bm")
def t13(spark, sf):
    b = P.bootstrap(cells(spark, sf), ["config", "task"], 1000)
    return rounded(b.select("lo", "hi"), "lo", "hi")


@query("t13_stratified_bootstrap", CELLS + ", " + DRAWS.format(p="task, ", part="PARTITION BY task ", win="PARTITION BY task", k="task", u="task, ") + f" SELECT {r('quantile_cont(m, 0.025)')} AS lo, {r('quantile_cont(m, 0.975)')} AS hi FROM bm")
def t13_strat(spark, sf):
    b = P.bootstrap(cells(spark, sf), ["config", "task"], 1000, strata="task")
    return rounded(b.select("lo", "hi"), "lo", "hi")


@query("t14_exact_bootstrap", CELLS + f", e AS (SELECT a.task, (a.diff + b.diff + c.diff + d.diff + e.diff) / 5 AS m FROM cells a JOIN cells b USING (task) JOIN cells c USING (task) JOIN cells d USING (task) JOIN cells e USING (task)) SELECT task, {r('quantile_cont(m, 0.025)')} AS lo, {r('quantile_cont(m, 0.975)')} AS hi, count(*) AS n_resamples FROM e GROUP BY 1")
def t14(spark, sf):
    return rounded(P.exact_bootstrap(cells(spark, sf), "task"), "lo", "hi")


@query("t15_wilcoxon", CELLS + f""", d AS (SELECT diff, abs(diff) AS mag FROM cells WHERE diff <> 0), k AS (SELECT *, rank() OVER (ORDER BY mag) + (count(*) OVER (PARTITION BY mag) - 1) / 2.0 AS rk FROM d),
t AS (SELECT coalesce(sum(c * c * c - c), 0) AS tie FROM (SELECT count(*)::DOUBLE AS c FROM d GROUP BY mag)), s AS (SELECT sum(rk) FILTER (WHERE diff > 0) AS w_plus, count(*)::DOUBLE AS n FROM k)
SELECT {r('w_plus')} AS w_plus, n::BIGINT AS n, {r('(abs(w_plus - n * (n + 1) / 4) - 0.5) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - tie / 48)')} AS z FROM s, t""")
def t15(spark, sf):
    return rounded(P.wilcoxon(cells(spark, sf)).select("w_plus", "n", "z"), "w_plus", "z")


@query("t16_t_and_equivalence", CELLS + f", s AS (SELECT avg(diff) AS m, stddev_samp(diff) AS sd, count(*) AS n FROM cells) SELECT {r('m / sd')} AS cohen_d, {r('m / (sd / sqrt(n))')} AS t, {r('(m + 1) / (sd / sqrt(n))')} AS t_low, {r('(m - 1) / (sd / sqrt(n))')} AS t_high FROM s")
def t16(spark, sf):
    from siftwork.operators.common import attach

    c = cells(spark, sf)
    d = attach(P.paired_summary(c).select("cohen_d", "t"), P.equivalence(c).select("t_low", "t_high"))
    return rounded(d, "cohen_d", "t", "t_low", "t_high")


@query("t17_cliffs_delta", "WITH " + T.RESULTS + f", x AS (SELECT a.config, sum(sign(a.metric - b.metric)) AS s, count(*) AS n FROM results a JOIN results b USING (config) WHERE a.method = 'view' AND b.method = 'error' AND b.metric IS NOT NULL GROUP BY 1) SELECT config, {r('s / n')} AS delta FROM x")
def t17(spark, sf):
    return rounded(P.cliffs_delta(X.results(spark, sf), "view", "error", ["config"]), "delta")


@query("t18_relative_gains", "WITH " + T.RESULTS + f", g AS (SELECT task, avg(metric) FILTER (WHERE method = 'view') AS v, avg(metric) FILTER (WHERE method = 'click') AS c, avg(metric) FILTER (WHERE method = 'error') AS e FROM results GROUP BY 1) SELECT task, {r('100 * (v - c) / c')} AS gain_click, {r('100 * (v - e) / e')} AS gain_error FROM g")
def t18(spark, sf):
    return rounded(P.relative_gains(X.results(spark, sf), "view", ["click", "error"], "task"), "gain_click", "gain_error")


# ---------------------------------------------------------------- agreement

# ids that occur in every (config, anchor, horizon) of their task
COMPLETE = T.DELTAS + """, rp AS (SELECT *, anchor_idx || '-' || horizon AS rep FROM deltas),
ok AS (SELECT task_id, sample_id FROM (SELECT task_id, sample_id, count(DISTINCT (peft_id, rep)) AS h FROM rp GROUP BY ALL) JOIN (SELECT task_id, count(DISTINCT (peft_id, rep)) AS p FROM rp GROUP BY ALL) USING (task_id) WHERE h = p),
vals AS (SELECT * FROM rp JOIN ok USING (task_id, sample_id)),
cv AS (SELECT task_id, peft_id AS member, sample_id, avg(delta_raw) AS v FROM vals GROUP BY ALL)"""


def agreement_sql(source: str, keys: str, share: float) -> str:
    return f"""ar AS (SELECT {keys}, member, sample_id, v, rank() OVER (PARTITION BY {keys}, member ORDER BY v) + (count(*) OVER (PARTITION BY {keys}, member, v) - 1) / 2.0 AS rk,
  row_number() OVER (PARTITION BY {keys}, member ORDER BY v DESC, sample_id) <= greatest(1, round_even({share}::DOUBLE * count(*) OVER (PARTITION BY {keys}, member), 0)) AS top FROM {source}),
ag AS (SELECT {keys}, a.member AS "left", b.member AS "right", corr(a.rk, b.rk) AS rho, sum((a.top AND b.top)::INT) AS inter, sum(a.top::INT) AS na, sum(b.top::INT) AS nb FROM ar a JOIN ar b USING ({keys}, sample_id) WHERE a.member < b.member GROUP BY ALL)"""


JACC = "inter::DOUBLE / (na + nb - inter)"


def complete_values(spark, sf):
    d = X.deltas(spark, sf).withColumn("rep", F.concat_ws("-", "anchor_idx", "horizon"))
    d = cut_lineage(d.withColumn("cell", F.concat_ws("/", "peft_id", "rep")))
    ok = M.common_to_all(d, "cell", by=["task_id"])
    return d.join(ok, ["task_id", "sample_id"], "left_semi")


def config_values(spark, sf):
    d = complete_values(spark, sf)
    # mean over replicates of the per-replicate mean
    per = d.groupBy("task_id", "peft_id", "rep", "sample_id").agg(F.avg("delta_raw").alias("v"))
    return cut_lineage(per.groupBy("task_id", "peft_id", "sample_id").agg(F.avg("v").alias("value")))


@query("f12_common_to_all", "WITH " + COMPLETE + " SELECT DISTINCT task_id, sample_id FROM ok")
def f12(spark, sf):
    return complete_values(spark, sf).select("task_id", "sample_id").distinct()


@query("t07_disagreement", "WITH " + COMPLETE + ", " + agreement_sql("cv", "task_id", 0.05) + f' SELECT "left", "right", {r("avg(rho)")} AS spearman, {r(f"avg({JACC})")} AS jaccard FROM ag GROUP BY ALL')
def t07(spark, sf):
    a = R.pair_agreement(config_values(spark, sf), ["task_id"], "peft_id", 0.05)
    g = a.groupBy("left", "right").agg(F.avg("spearman").alias("spearman"), F.avg("jaccard").alias("jaccard"))
    return rounded(g, "spearman", "jaccard")


@query("t08_noise_floor", "WITH " + COMPLETE + ", rv AS (SELECT task_id, peft_id, rep AS member, sample_id, delta_raw AS v FROM vals), " + agreement_sql("rv", "task_id, peft_id", 0.05) + f" SELECT peft_id, {r('avg(rho)')} AS spearman, {r(f'avg({JACC})')} AS jaccard, count(*) AS n_pairs FROM ag GROUP BY 1")
def t08(spark, sf):
    v = cut_lineage(complete_values(spark, sf).select("task_id", "peft_id", "rep", "sample_id", F.col("delta_raw").alias("value")))
    a = R.pair_agreement(v, ["task_id", "peft_id"], "rep", 0.05)
    g = a.groupBy("peft_id").agg(F.avg("spearman").alias("spearman"), F.avg("jaccard").alias("jaccard"), F.count(F.lit(1)).alias("n_pairs"))
    return rounded(g, "spearman", "jaccard")


LESS_SETS = ULO + f", sel AS (SELECT config, sample_id FROM (SELECT *, row_number() OVER (PARTITION BY config ORDER BY round(u_lo, 9) DESC, sample_id) AS rn FROM ulo) WHERE rn <= {K})"
UAGREE = ULO + ", uv AS (SELECT 0 AS grp, config AS member, sample_id, round(u_lo, 9) AS v FROM ulo), " + agreement_sql("uv", "grp", 0.10)


def utility_agreement(spark, sf):
    v = u_lo(spark, sf).select(F.lit(0).alias("grp"), "config", "sample_id", F.round("u_lo", 9).alias("value"))
    return R.pair_agreement(cut_lineage(v), ["grp"], "config", 0.10)


BUCKET_SQL = """bk AS (SELECT a.name AS "left", b.name AS "right", CASE WHEN a.family <> b.family THEN 'cross-family' WHEN a.modules_key = b.modules_key AND a.layer_range = b.layer_range THEN 'same-fam-capacity' ELSE 'same-fam-placement' END AS bucket FROM specs a JOIN specs b ON a.name < b.name)"""


@query("t09_structural_summary", "WITH " + UAGREE + ", " + BUCKET_SQL + f' SELECT bucket, count(*) AS n_pairs, {r("avg(rho)")} AS mean_spearman, {r(f"avg({JACC})")} AS mean_overlap FROM ag JOIN bk USING ("left", "right") GROUP BY 1')
def t09(spark, sf):
    b = C.pairs(REG.specs(spark)).select(F.col("a.name").alias("left"), F.col("b.name").alias("right"), C.structural_bucket().alias("bucket"))
    j = utility_agreement(spark, sf).join(F.broadcast(b), ["left", "right"])
    g = j.groupBy("bucket").agg(F.count(F.lit(1)).alias("n_pairs"), F.avg("spearman").alias("mean_spearman"), F.avg("jaccard").alias("mean_overlap"))
    return rounded(g, "mean_spearman", "mean_overlap")


@query("t24_cross_family_mean", "WITH " + UAGREE + f" SELECT {r('avg(rho)')} AS mean_spearman, count(*) AS n FROM ag WHERE split_part(\"left\", '-', 1) <> split_part(\"right\", '-', 1)")
def t24(spark, sf):
    fam = lambda c: F.substring_index(c, "-", 1)
    a = utility_agreement(spark, sf).where(fam(F.col("left")) != fam(F.col("right")))
    return rounded(a.agg(F.avg("spearman").alias("mean_spearman"), F.count(F.lit(1)).alias("n")), "mean_spearman")


def rounded_u_lo(spark, sf):
    """Utilities, stored: a sketch, the site similarities and the ranks' several passes hang on them."""
    return cut_lineage(u_lo(spark, sf).withColumn("u", F.round("u_lo", 9)))


def less_sets(spark, sf, u=None):
    u = rounded_u_lo(spark, sf) if u is None else u
    from siftwork.functions.ranks import ranked
    from siftwork.operators.common import resolve_budget

    k = resolve_budget(X.pool_vectors(spark, sf), 0.10)
    return ranked(u.withColumn("_k", k), ["config"], ["-u", "sample_id"], upto="_k").select("config", "sample_id", "u")


OVERLAP = LESS_SETS + f""", ov AS (SELECT a.config AS "left", b.config AS "right", count(*) AS inter FROM sel a JOIN sel b USING (sample_id) GROUP BY ALL),
nf AS (SELECT DISTINCT name, {NAME_FEATURES} FROM specs),
pt AS (SELECT a.name AS "left", b.name AS "right", abs(a.lr2 - b.lr2) + (a.place <> b.place)::INT + (a.mods <> b.mods)::INT AS distance,
  1 - coalesce(inter, 0)::DOUBLE / (2 * (SELECT {K}) - coalesce(inter, 0)) AS difference FROM nf a JOIN nf b ON a.name < b.name LEFT JOIN ov ON ov."left" = a.name AND ov."right" = b.name)"""


def overlap_points(spark, sf):
    o = M.overlap(less_sets(spark, sf).select("config", "sample_id"), "config").where(F.col("left") < F.col("right"))
    return o.select("left", "right", C.name_distance(F.col("left"), F.col("right")).alias("distance"), (1 - F.col("jaccard")).alias("difference"))


@query("f08_set_overlap", "WITH " + OVERLAP + ' SELECT "left", "right", coalesce(inter, 0) AS inter FROM pt LEFT JOIN ov USING ("left", "right")')
def f08(spark, sf):
    o = M.overlap(less_sets(spark, sf).select("config", "sample_id"), "config")
    return o.where(F.col("left") < F.col("right")).select("left", "right", "inter")


@query("t04_overlap_points", "WITH " + OVERLAP + f' SELECT "left", "right", {r("distance")} AS distance, {r("difference")} AS difference FROM pt')
def t04(spark, sf):
    return rounded(overlap_points(spark, sf), "distance", "difference")


RANK_PT = """prk AS (SELECT {k}, rank() OVER ({p} ORDER BY d) + (count(*) OVER (PARTITION BY {k}, d) - 1) / 2.0 AS rx, rank() OVER ({p} ORDER BY e) + (count(*) OVER (PARTITION BY {k}, e) - 1) / 2.0 AS ry FROM {s})"""


@query("t04_overlap_correlation", "WITH " + OVERLAP + ", ps AS (SELECT 0 AS g, round(distance, 9) AS d, round(difference, 9) AS e FROM pt), " + RANK_PT.format(k="g", p="PARTITION BY g", s="ps") + f" SELECT {r('corr(rx, ry)')} AS rho FROM prk")
def t04_rho(spark, sf):
    p = overlap_points(spark, sf).select(F.lit(0).alias("g"), F.round("distance", 9).alias("d"), F.round("difference", 9).alias("e"))
    return rounded(M.spearman(cut_lineage(p), ["g"], "rho", "d", "e").select("rho"), "rho")


@query("t22_jackknife", "WITH " + OVERLAP + """, ps AS (SELECT n.name AS o, round(distance, 9) AS d, round(difference, 9) AS e FROM pt, nf n WHERE n.name <> "left" AND n.name <> "right"), """ + RANK_PT.format(k="o", p="PARTITION BY o", s="ps") + f", jk AS (SELECT o, corr(rx, ry) AS rho FROM prk GROUP BY 1) SELECT {r('min(rho)')} AS lo, {r('max(rho)')} AS hi, count(rho) AS n FROM jk")
def t22(spark, sf):
    p = overlap_points(spark, sf).withColumn("distance", F.round("distance", 9)).withColumn("difference", F.round("difference", 9))
    return rounded(P.jackknife_correlation(cut_lineage(p), "left", "right", "distance", "difference"), "lo", "hi")


@query("t23_top_k_rank_agreement", "WITH " + LESS_SETS + """, un AS (SELECT DISTINCT a.config AS l, b.config AS rr, s.sample_id FROM (SELECT DISTINCT config FROM sel) a JOIN (SELECT DISTINCT config FROM sel) b ON a.config < b.config JOIN sel s ON s.config = a.config OR s.config = b.config),
ps AS (SELECT l || '|' || rr AS o, round(x.u_lo, 9) AS d, round(y.u_lo, 9) AS e FROM un JOIN ulo x ON x.config = l AND x.sample_id = un.sample_id JOIN ulo y ON y.config = rr AND y.sample_id = un.sample_id), """
    + RANK_PT.format(k="o", p="PARTITION BY o", s="ps") + f" SELECT o AS pair, {r('corr(rx, ry)')} AS rho, count(*) AS n FROM prk GROUP BY 1")
def t23(spark, sf):
    """Spearman on the union of two top sets, for every pair of configurations."""
    names = sorted(x[0] for x in REG.SPECS)
    u = rounded_u_lo(spark, sf)
    s = less_sets(spark, sf, u).select("config", "sample_id", F.lit(True).alias("top"))
    d = u.join(s, ["config", "sample_id"], "left")
    w = d.groupBy("sample_id").pivot("config", names).agg(F.first("u").alias("u"), F.max("top").alias("top"))
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    rows = F.array(
        *[
            F.struct(
                F.lit(f"{a}|{b}").alias("pair"),
                F.col(f"`{a}_u`").alias("d"),
                F.col(f"`{b}_u`").alias("e"),
                (F.coalesce(F.col(f"`{a}_top`"), F.lit(False)) | F.coalesce(F.col(f"`{b}_top`"), F.lit(False))).alias("on"),
            )
            for a, b in pairs
        ]
    )
    p = cut_lineage(w.select(F.explode(rows).alias("x")).select("x.*").where("on"))
    n = p.groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    return rounded(M.spearman(p, ["pair"], "rho", "d", "e").join(n, "pair"), "rho")


@query("k19_reuse_one", "WITH " + LESS_SETS + ", tg AS (SELECT DISTINCT config AS target FROM sel) SELECT target, count(*) AS n, sum((s2.sample_id IS NOT NULL)::INT)::BIGINT AS shared FROM tg JOIN sel ON sel.config = 'L-r8-qv' LEFT JOIN sel s2 ON s2.config = target AND s2.sample_id = sel.sample_id GROUP BY 1")
def k19(spark, sf):
    """One source selection reused for every target, and how much of it each target would have picked."""
    s = cut_lineage(less_sets(spark, sf).select("config", "sample_id"))
    names = F.array(*[F.lit(x[0]) for x in REG.SPECS])
    reused = s.where("config = 'L-r8-qv'").select("sample_id", F.explode(names).alias("target"))
    own = s.select(F.col("config").alias("target"), "sample_id", F.lit(1).alias("own"))
    j = reused.join(own, ["target", "sample_id"], "left")
    return j.groupBy("target").agg(F.count(F.lit(1)).alias("n"), F.count("own").alias("shared"))
