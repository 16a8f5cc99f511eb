"""Report queries over the result and cost logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwork.operators import cost as C
from siftwork.operators import metrics as M
from siftwork.operators import reports as R
from siftwork.operators import scoring as U
from siftwork.plans import sqltext as T
from siftwork.plans import views as X
from siftwork.plans.catalog import query

r = T.r
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]  # fixed values of the events table
RES = "WITH " + T.RESULTS


def rounded(df, *cols, digits=6):
    for c in cols:
        df = df.withColumn(c, F.round(c, digits))
    return df


@query("g08_result_aggregate", RES + f" SELECT method, config, task, budget, {r('avg(metric)')} AS mean, {r('coalesce(stddev_pop(metric), 0)')} AS std, count(metric) AS n FROM results GROUP BY ALL HAVING count(metric) > 0")
def g08(spark, sf):
    return rounded(R.aggregate(X.results(spark, sf), ["method", "config", "task", "budget"]), "mean", "std")


def costs(spark, sf):
    return X.cost_events(spark, sf).withColumn("gpu_hours", C.gpu_hours())


HOURS = "WITH " + T.COST + ", ce AS (SELECT *, wall_time_sec * greatest(1, gpu_count) / 3600.0::DOUBLE AS h FROM cost_events)"


@query("g09_cost_totals", HOURS + f" SELECT {r('sum(h)', 4)} AS total_h, {r('sum(h) FILTER (WHERE stage IN (' + chr(39) + 'click' + chr(39) + ', ' + chr(39) + 'signup' + chr(39) + '))', 4)} AS offline_h FROM ce")
def g09(spark, sf):
    return rounded(C.totals(costs(spark, sf), ("click", "signup")), "total_h", "offline_h", digits=4)


@query("s01_gpu_hours", HOURS + f" SELECT run_no, {r('h')} AS gpu_hours FROM ce")
def s01(spark, sf):
    return rounded(costs(spark, sf).select("run_no", "gpu_hours"), "gpu_hours")


@query("s06_cost_by_stage", HOURS + " SELECT run_id, " + ", ".join(f"{r(f'sum(h) FILTER (WHERE stage = {chr(39)}{s}{chr(39)})')} AS {s}" for s in EVENT_TYPES) + " FROM ce GROUP BY 1")
def s06(spark, sf):
    return rounded(C.by_stage(costs(spark, sf), "run_id", EVENT_TYPES), *EVENT_TYPES)


@query("g10_pivot", RES + " SELECT method, " + ", ".join(f"{r(f'avg(metric) FILTER (WHERE config = {c})')} AS c{c}" for c in range(5)) + " FROM results WHERE budget = 0.1 GROUP BY 1")
def g10(spark, sf):
    d = X.results(spark, sf).where(R.near("budget", 0.1))
    return rounded(R.pivot_mean(d, "method", "config", list(range(5))), *[f"c{i}" for i in range(5)])


@query("g11_budget_curve", RES + f" SELECT method, budget, {r('avg(metric)')} AS mean, {r('stddev_samp(metric)')} AS std FROM results GROUP BY ALL")
def g11(spark, sf):
    return rounded(R.mean_and_spread(X.results(spark, sf), ["method", "budget"]), "mean", "std")


DISP = """cl AS (SELECT method, config::VARCHAR AS config, seed, avg(metric) AS m FROM results GROUP BY ALL UNION ALL SELECT method, 'Avg.', seed, avg(metric) FROM results GROUP BY ALL),
dsp AS (SELECT method, config, avg(m) AS mean, stddev_samp(m) AS std FROM cl GROUP BY ALL)"""


@query("g12_dispersion", RES + ", " + DISP + f" SELECT method, config, {r('mean')} AS mean, {r('std')} AS std FROM dsp")
def g12(spark, sf):
    return rounded(R.dispersion(X.results(spark, sf)), "mean", "std")


@query("g12_rollup", RES + f" SELECT method, config, {r('avg(metric)')} AS mean, count(*) AS n FROM results GROUP BY ROLLUP (method, config)")
def g12_rollup(spark, sf):
    d = X.results(spark, sf).withColumn("metric", R.without_nan("metric"))
    return rounded(d.rollup("method", "config").agg(F.avg("metric").alias("mean"), F.count(F.lit(1)).alias("n")), "mean")


@query("g13_ablation", RES + f", g AS (SELECT method, avg(metric) AS m, avg(budget) AS nd, count(*) AS n FROM results GROUP BY 1) SELECT method, {r('m')} AS mean, {r('nd')} AS mean_ndcg, n, {r('(SELECT m FROM g WHERE method = ' + chr(39) + 'view' + chr(39) + ') - m')} AS drop FROM g")
def g13(spark, sf):
    d = X.results(spark, sf).withColumn("ndcg", F.col("budget"))
    return rounded(R.ablation(d, "view"), "mean", "mean_ndcg", "drop")


@query("g14_alpha_sweep", RES + f", t AS (SELECT 'sel_alpha=' || (config * 0.25)::DECIMAL(4,2) AS tag, metric FROM results), x AS (SELECT regexp_extract(tag, 'alpha=([0-9.]+)', 1)::DOUBLE AS alpha, metric FROM t) SELECT alpha, {r('avg(metric)')} AS mean, {r('stddev_samp(metric)')} AS std FROM x GROUP BY 1")
def g14(spark, sf):
    d = X.results(spark, sf).withColumn("tag", F.concat(F.lit("sel_alpha="), (F.col("config") * 0.25).cast("decimal(4,2)").cast("string")))
    d = d.withColumn("alpha", F.regexp_extract("tag", r"alpha=([0-9.]+)", 1).cast("double"))
    return rounded(R.mean_and_spread(d, ["alpha"]), "mean", "std")


@query("g15_level_by_mode", RES + " SELECT 'L' || seed AS level, " + ", ".join(f"{r(f'avg(metric) FILTER (WHERE method = {chr(39)}{m}{chr(39)})')} AS mode_{m}" for m in EVENT_TYPES) + " FROM results GROUP BY 1")
def g15(spark, sf):
    d = X.results(spark, sf).withColumn("level", F.concat(F.lit("L"), F.col("seed").cast("string")))
    return rounded(R.pivot_mean(d, "level", "method", EVENT_TYPES, prefix="mode_"), *[f"mode_{m}" for m in EVENT_TYPES])


@query("g16_mean_by_key_path", RES + f" SELECT method, 'L' || seed AS level, {r('avg(metric)')} AS mean FROM results GROUP BY ALL")
def g16(spark, sf):
    d = X.results(spark, sf).withColumn("extra", F.create_map(F.lit("level"), F.concat(F.lit("L"), F.col("seed").cast("string"))))
    return rounded(R.group_mean(d, ["method", "extra.level"]), "mean")


# ------------------------------------------------------------------- cost

MAIN, INFLUENCE, OFFLINE, RECOMPUTE = "view", ["click", "purchase"], 40.0, 30.0
MC = RES + ", mc AS (SELECT method, avg(wall / 3600.0::DOUBLE) AS apply_h, avg(metric) AS perf FROM (SELECT r.*, e.value AS wall FROM results r JOIN events e ON e.event_id = r.run_no) GROUP BY 1)"
TOTAL = "CASE WHEN method = 'view' THEN 40 + {t} * apply_h WHEN method IN ('click', 'purchase') THEN {t} * (30 + apply_h) ELSE {t} * apply_h END"
CURVE = ", cv AS (SELECT method, t, perf, " + TOTAL.format(t="t") + " AS total_h FROM mc, (VALUES (1), (3), (5), (10)) AS x(t))"


def method_costs(spark, sf):
    e = X.table(spark, sf, "events").select(F.col("event_id").alias("run_no"), (F.col("value") / 3600.0).alias("apply_h"))
    d = X.results(spark, sf).join(e, "run_no").withColumn("metric", R.without_nan("metric"))
    return C.method_costs(d)


@query("s02_break_even", RES + f", a AS (SELECT config, avg(metric) FILTER (WHERE method = 'view') AS own, avg(metric) FILTER (WHERE method = 'click') AS other FROM results GROUP BY 1) SELECT config, CASE WHEN other - own <= 1e-9 THEN 'Infinity'::DOUBLE ELSE {r('40.0 / (other - own)')} END AS t FROM a")
def s02(spark, sf):
    v = R.without_nan("metric")
    g = X.results(spark, sf).groupBy("config").agg(
        F.avg(F.when(F.col("method") == "view", v)).alias("own"), F.avg(F.when(F.col("method") == "click", v)).alias("other")
    )
    return rounded(g.select("config", C.break_even(F.lit(40.0), F.col("own"), F.col("other")).alias("t")), "t")


@query("s03_cost_curve", MC + CURVE + f" SELECT method, t, {r('total_h')} AS total_h FROM cv")
def s03(spark, sf):
    return rounded(C.cost_curve(method_costs(spark, sf), MAIN, INFLUENCE, OFFLINE, RECOMPUTE, [1, 3, 5, 10]).select("method", "t", "total_h"), "total_h")


@query("s04_break_even_table", MC + f", w AS (SELECT method, CASE WHEN method IN ('click', 'purchase') THEN 30 + apply_h ELSE apply_h END - (SELECT apply_h FROM mc WHERE method = 'view') AS saved FROM mc WHERE method <> 'view') SELECT method, CASE WHEN saved <= 1e-9 THEN 'Infinity'::DOUBLE ELSE {r('40.0 / saved', 3)} END AS break_even FROM w")
def s04(spark, sf):
    return rounded(C.break_even_table(method_costs(spark, sf), MAIN, INFLUENCE, OFFLINE, RECOMPUTE).select("method", "break_even"), "break_even", digits=3)


@query("s05_frontier", MC + CURVE + f", p AS (SELECT *, max(perf) OVER (ORDER BY total_h, perf DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM cv WHERE t = 10) SELECT method, {r('total_h')} AS total_h, {r('perf')} AS perf, best IS NULL OR perf > best AS on_frontier FROM p")
def s05(spark, sf):
    d = C.cost_curve(method_costs(spark, sf), MAIN, INFLUENCE, OFFLINE, RECOMPUTE, [10]).select("method", "total_h", "perf")
    return rounded(C.frontier(d), "total_h", "perf")


@query("s07_headline", MC + f""", h AS (SELECT method, perf, CASE WHEN method = 'view' THEN 40.0 ELSE 0.0 END::DOUBLE AS fixed_h, apply_h + CASE WHEN method IN ('click', 'purchase') THEN 30 ELSE 0 END AS marginal_h FROM mc)
SELECT method, {r('perf')} AS perf, fixed_h, {r('marginal_h')} AS marginal_h, {r('fixed_h + 5 * marginal_h')} AS total_h, {r('perf - (SELECT perf FROM h WHERE method = ' + chr(39) + 'click' + chr(39) + ')')} AS gap FROM h""")
def s07(spark, sf):
    d = C.headline(method_costs(spark, sf), MAIN, INFLUENCE, "click", OFFLINE, RECOMPUTE, 5)
    return rounded(d.drop("apply_h"), "perf", "marginal_h", "total_h", "gap")


# -------------------------------------------------------- grids and matrices


@query("t01_grid", RES + " SELECT DISTINCT m.method, c.config, t.task, b.budget, s.seed FROM (SELECT DISTINCT method FROM results) m, (SELECT DISTINCT config FROM results) c, (SELECT DISTINCT task FROM results) t, (SELECT DISTINCT budget FROM results) b, (SELECT DISTINCT seed FROM results) s")
def t01(spark, sf):
    d = X.results(spark, sf)
    axes = d.agg(*[F.collect_set(a).alias(a) for a in ("method", "config", "task", "budget", "seed")])  # a few values each
    for a in ("method", "config", "task", "budget", "seed"):
        axes = axes.withColumn(a, F.explode(a))
    return axes


@query("t02_result_rows")
def t02(spark, sf):
    """One result row per (method, language): selection size, ranking metrics, cost."""
    from siftwork.plans.rankings import BY, scored

    s = scored(spark, sf)
    m = M.ranking_metrics(s, BY)
    n = s.groupBy(*BY).agg(F.greatest(F.lit(1.0), F.bround(F.count(F.lit(1)) * 0.1)).cast("bigint").alias("n_selected"))
    c = costs(spark, sf).agg((F.sum("gpu_hours") / F.count(F.lit(1))).alias("h"))
    return m.join(n, BY).withColumn("select_gpu_h", F.round(c.scalar(), 6))


@query("t03_seeded_selection", """WITH """ + T.POOL_TEXT + """, m AS (SELECT sample_id, source, length(response) AS n, method, seed FROM pool_text, (VALUES ('random', 0), ('random', 1), ('random', 2), ('length', 0)) AS x(method, seed)),
w AS (SELECT *, row_number() OVER (PARTITION BY method, seed, source ORDER BY CASE WHEN method = 'random' THEN md5(seed || ':' || sample_id) ELSE '' END, CASE WHEN method = 'length' THEN n END DESC, sample_id DESC) AS rn FROM m)
SELECT method, seed::BIGINT AS seed, source, sample_id FROM w WHERE rn <= 5""")
def t03(spark, sf):
    from pyspark.sql.window import Window as W

    # only the random method is repeated per seed
    runs = F.array(*[F.struct(F.lit(m).alias("method"), F.lit(s).alias("seed")) for m, s in (("random", 0), ("random", 1), ("random", 2), ("length", 0))])
    d = X.pool_text(spark, sf).select("sample_id", "source", F.length("response").alias("n"), F.explode(runs).alias("x"))
    d = d.select("sample_id", "source", "n", "x.*")
    h = F.when(F.col("method") == "random", F.md5(F.concat_ws(":", "seed", "sample_id"))).otherwise("")
    rn = F.row_number().over(W.partitionBy("method", "seed", "source").orderBy("h", F.when(F.col("method") == "length", F.col("n")).desc(), F.desc("sample_id")))
    return d.withColumn("h", h).withColumn("rn", rn).where("rn <= 5").select("method", F.col("seed").cast("bigint").alias("seed"), "source", "sample_id")


MM = RES + ", ev2 AS (SELECT r.*, r.config AS src, (e.user_id // 5) % 5 AS tgt FROM results r JOIN events e ON e.event_id = r.run_no)"


def with_targets(spark, sf):
    e = X.table(spark, sf, "events").select(F.col("event_id").alias("run_no"), (F.floor(F.col("user_id") / 5) % 5).alias("tgt"))
    return X.results(spark, sf).join(e, "run_no").withColumn("src", F.col("config"))


@query("t05_mismatch_matrix", MM + f", g AS (SELECT src, tgt, avg(metric) AS m FROM ev2 GROUP BY ALL) SELECT src, tgt, {r('m')} AS mean, {r('m / max(CASE WHEN src = tgt THEN m END) OVER (PARTITION BY tgt)')} AS ratio FROM g")
def t05(spark, sf):
    return rounded(R.mismatch_matrix(with_targets(spark, sf)), "mean", "ratio")


@query("t06_degradation", RES + f", f AS (SELECT config, avg(metric) AS ref FROM results WHERE method = 'click' GROUP BY 1) SELECT run_no, config, {r('1 - metric / ref')} AS degradation FROM results JOIN f USING (config) WHERE method = 'view'")
def t06(spark, sf):
    d = X.results(spark, sf)
    out = R.degradation(d.where("method = 'view'"), d.where("method = 'click'"))
    return rounded(out.select("run_no", "config", "degradation"), "degradation")


TRANSFER = MM + """, pf AS (SELECT tgt, src, avg(metric) AS perf FROM ev2 WHERE method = 'view' GROUP BY ALL),
tm AS (SELECT p.*, max(CASE WHEN src = tgt THEN perf END) OVER (PARTITION BY tgt) AS diag, (SELECT avg(metric) FROM ev2 e WHERE method = 'error' AND e.tgt = p.tgt) AS rnd, (SELECT avg(metric) FROM ev2 e WHERE method = 'signup' AND e.tgt = p.tgt) AS agn FROM pf p),
nm AS (SELECT tgt, src, perf, (perf - rnd) / CASE WHEN abs(diag - rnd) >= 1e-9 THEN diag - rnd END AS norm, (agn - rnd) / CASE WHEN abs(diag - rnd) >= 1e-9 THEN diag - rnd END AS norm_agnostic FROM tm)"""


def transfer(spark, sf):
    d = with_targets(spark, sf)
    return R.transfer_matrix(*[d.where(F.col("method") == m) for m in ("view", "error", "signup")])


@query("t10_transfer_matrix", TRANSFER + f" SELECT tgt, src, {r('perf')} AS perf, {r('norm')} AS norm, {r('norm_agnostic')} AS norm_agnostic FROM nm")
def t10(spark, sf):
    return rounded(transfer(spark, sf), "perf", "norm", "norm_agnostic")


@query("t11_diagonal_gap", TRANSFER + f", g AS (SELECT tgt, max(norm) FILTER (WHERE src = tgt) AS d, avg(norm) FILTER (WHERE src <> tgt) AS o FROM nm GROUP BY 1) SELECT {r('avg(d - o)')} AS gap FROM g")
def t11(spark, sf):
    return rounded(R.diagonal_gap(transfer(spark, sf)), "gap")


@query("t19_best_per_column", RES + ", " + DISP + f" SELECT method, config, abs(mean - max(mean) OVER (PARTITION BY config)) < 1e-9 AS best FROM dsp")
def t19(spark, sf):
    return R.mark_best(R.dispersion(X.results(spark, sf)), ["config"]).select("method", "config", "best")


@query("t20_tier_gaps", RES + f", x AS (SELECT *, CASE WHEN config < 2 THEN 'L0' WHEN config < 4 THEN 'L1' ELSE 'L2' END AS tier, CASE WHEN config = 4 THEN 'signup' ELSE 'click' END AS reference FROM results), p AS (SELECT tier, config, seed, avg(metric) FILTER (WHERE method = 'view') - avg(metric) FILTER (WHERE method = reference) AS g FROM x GROUP BY ALL) SELECT tier, config, {r('avg(g)')} AS gap, {r('stddev_samp(g)')} AS sd FROM p GROUP BY 1, 2")
def t20(spark, sf):
    tier = F.when(F.col("config") < 2, "L0").when(F.col("config") < 4, "L1").otherwise("L2")
    d = X.results(spark, sf).withColumn("tier", tier).withColumn("reference", F.when(F.col("config") == 4, "signup").otherwise("click"))
    return rounded(R.tier_gaps(d, "view", ["tier", "config"]), "gap", "sd")


@query("t21_stability", RES + " " + " UNION ALL ".join(f"SELECT method, '{a}' AS axis, {r('stddev_samp(m)')} AS spread FROM (SELECT method, {a}, avg(metric) AS m FROM results GROUP BY ALL) GROUP BY 1" for a in ("seed", "budget", "config", "task")))
def t21(spark, sf):
    return rounded(R.stability(X.results(spark, sf), ["seed", "budget", "config", "task"]), "spread")


# --------------------------------------------------------------- predictions


@query("u01_exact_match", "WITH " + T.EVENTS + f", p AS (SELECT k % 4 AS task, 'first ' || (event_id % 11) || ', so 1,000 then ' || (event_id % 7) || '.' AS prediction, (k % 7)::DOUBLE AS gold FROM ev), x AS (SELECT task, gold, list_last(regexp_extract_all(regexp_replace(prediction, '(\\d),(\\d)', '\\1\\2', 'g'), '-?\\d+(?:\\.\\d+)?'))::DOUBLE AS n FROM p) SELECT task, {r('avg((abs(n - gold) < 1e-9)::INT)')} AS exact_match FROM x GROUP BY 1")
def u01(spark, sf):
    e = X.events(spark, sf)
    text = F.concat(F.lit("first "), (F.col("event_id") % 11).cast("string"), F.lit(", so 1,000 then "), (F.col("event_id") % 7).cast("string"), F.lit("."))
    d = e.select((F.col("k") % 4).alias("task"), text.alias("prediction"), (F.col("k") % 7).cast("double").alias("gold"))
    return rounded(U.exact_match(d, ["task"]), "exact_match")


@query("u02_pass_at_k", "WITH " + T.EVENTS + f", g AS (SELECT k % 4 AS task, user_id, count(*) AS n, sum((value > 80)::INT)::BIGINT AS c FROM ev GROUP BY ALL), q AS (SELECT task, CASE WHEN c = 0 THEN 0.0 WHEN n - c < 3 THEN 1.0 ELSE 1 - list_product(list_transform(range(n - c + 1, n + 1), lambda i: 1 - 3.0::DOUBLE / i)) END AS p FROM g) SELECT task, {r('avg(p)')} AS pass_at_k FROM q GROUP BY 1")
def u02(spark, sf):
    d = X.events(spark, sf).select((F.col("k") % 4).alias("task"), F.col("user_id").alias("item_id"), (F.col("value") > 80).alias("passed"))
    return rounded(U.pass_rates(d, ["task"], 3), "pass_at_k")


@query("u03_choice_accuracy", "WITH " + T.EVENTS + f", b AS (SELECT user_id % 4 AS task, user_id, arg_max(event_type, struct_pack(v := -value, o := event_type)) AS o FROM ev GROUP BY ALL) SELECT task, {r('avg((o = CASE user_id % 2 WHEN 0 THEN ' + chr(39) + 'click' + chr(39) + ' ELSE ' + chr(39) + 'view' + chr(39) + ' END)::INT)')} AS accuracy FROM b GROUP BY 1")
def u03(spark, sf):
    gold = F.when(F.col("user_id") % 2 == 0, "click").otherwise("view")
    d = X.events(spark, sf).select(
        (F.col("user_id") % 4).alias("task"), F.col("user_id").alias("item_id"), F.col("event_type").alias("option"), (-F.col("value")).alias("loglik"), gold.alias("gold")
    )
    return rounded(U.choice_accuracy(d, ["task"]), "accuracy")


@query("u04_token_f1", """WITH t AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS reply FROM conversations),
p AS (SELECT conv_id, turn, text AS prediction, [reply, left(reply, 60)] AS golds FROM t WHERE reply IS NOT NULL),
pw AS (SELECT conv_id, turn, w, count(*) AS n FROM (SELECT conv_id, turn, unnest(list_filter(regexp_split_to_array(lower(prediction), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')) AS w FROM p) GROUP BY ALL),
gs AS (SELECT conv_id, turn, g, golds[g] AS gold FROM p, (VALUES (1), (2)) AS x(g)),
gw AS (SELECT conv_id, turn, g, w, count(*) AS n FROM (SELECT conv_id, turn, g, unnest(list_filter(regexp_split_to_array(lower(gold), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')) AS w FROM gs) GROUP BY ALL),
sm AS (SELECT gw.conv_id, gw.turn, g, sum(least(gw.n, pw.n)) AS same FROM gw JOIN pw USING (conv_id, turn, w) GROUP BY ALL)
SELECT conv_id, turn, """ + r("max(CASE WHEN coalesce(same, 0) = 0 THEN 0 ELSE 2.0 * same / ((SELECT sum(n) FROM pw WHERE pw.conv_id = gs.conv_id AND pw.turn = gs.turn) + (SELECT sum(n) FROM gw WHERE gw.conv_id = gs.conv_id AND gw.turn = gs.turn AND gw.g = gs.g)) END)") + " AS f1 FROM gs LEFT JOIN sm USING (conv_id, turn, g) GROUP BY ALL")
def u04(spark, sf):
    from pyspark.sql.window import Window as W

    c = X.table(spark, sf, "conversations").withColumn("reply", F.lead("text").over(W.partitionBy("conv_id").orderBy("turn")))
    d = c.where(F.col("reply").isNotNull()).select("conv_id", "turn", F.col("text").alias("prediction"), F.array(F.col("reply"), F.substring("reply", 1, 60)).alias("golds"))
    return rounded(U.token_f1(d, ["conv_id", "turn"]), "f1")


@query("u05_judged_rates", "WITH " + T.EVENTS + f" SELECT user_id % 5 AS judge, {r('avg(CASE WHEN value > 60 THEN 1.0 WHEN value > 40 THEN 0.5 ELSE 0.0 END)')} AS win_rate, {r('avg((k % 3 = 0)::INT) FILTER (WHERE event_type = ' + chr(39) + 'error' + chr(39) + ')')} AS refusal_acc, {r('avg((k % 3 = 0)::INT) FILTER (WHERE event_type <> ' + chr(39) + 'error' + chr(39) + ')')} AS over_refusal FROM ev GROUP BY 1")
def u05(spark, sf):
    verdict = F.when(F.col("value") > 60, "win").when(F.col("value") > 40, "tie").otherwise("loss")
    d = X.events(spark, sf).select(
        (F.col("user_id") % 5).alias("judge"), verdict.alias("verdict"), (F.col("k") % 3 == 0).alias("refused"), (F.col("event_type") == "error").alias("harmful")
    )
    return rounded(U.judged_rates(d, ["judge"]), "win_rate", "refusal_acc", "over_refusal")
