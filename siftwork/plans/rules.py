"""Data-quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwork.operators import cost as C
from siftwork.operators import rules as V
from siftwork.operators.common import duplicates, missing
from siftwork.plans import reports as RP
from siftwork.plans import sqltext as T
from siftwork.plans import views as X
from siftwork.plans.catalog import query
from siftwork.plans.tables import OVERLAP, overlap_documents
from siftwork.sources import logs as L

r = T.r
RES = "WITH " + T.RESULTS


def _metrics(spark, sf):
    d = X.results(spark, sf)
    return d.select(
        "run_no",
        "metric",
        (F.col("metric") / 100).alias("ndcg_at_k"),
        (F.col("metric") / 150 - 0.2).alias("spearman"),
        (F.col("metric") - 2).alias("select_gpu_h"),
    )


@query("v01_numeric_ranges", RES + f""", l AS (SELECT run_no, unnest(['metric', 'ndcg_at_k', 'spearman', 'select_gpu_h']) AS "column", unnest([metric, metric / 100, metric / 150 - 0.2, metric - 2]) AS v FROM results),
x AS (SELECT run_no, "column", CASE WHEN v IS NULL THEN 'finite' WHEN "column" = 'select_gpu_h' AND v < 0 THEN 'non-negative' WHEN "column" = 'ndcg_at_k' AND (v < 0 OR v > 1) THEN 'in [0, 1]' WHEN "column" = 'spearman' AND (v < -1 OR v > 1) THEN 'in [-1, 1]' END AS rule FROM l)
SELECT * FROM x WHERE rule IS NOT NULL""")
def v01(spark, sf):
    return V.numeric_ranges(_metrics(spark, sf), "run_no", ["metric", "ndcg_at_k", "spearman", "select_gpu_h"]).drop("value")


@query("v02_selected_counts", RES + ", x AS (SELECT run_no, (user_id * 10)::BIGINT AS n_selected, round_even(budget * (SELECT count(*) FROM documents), 0)::BIGINT AS expected FROM results JOIN events ON event_id = run_no) SELECT * FROM x WHERE n_selected <> expected")
def v02(spark, sf):
    e = X.table(spark, sf, "events").select(F.col("event_id").alias("run_no"), (F.col("user_id") * 10).alias("n_selected"))
    size = X.table(spark, sf, "documents").agg(F.count(F.lit(1)).alias("n")).scalar()
    d = X.results(spark, sf).join(e, "run_no").select("run_no", "budget", "n_selected")
    return V.wrong_counts(d, size).drop("budget")


@query("v03_generated_marks", RES + " SELECT run_no FROM results WHERE method = 'signup' AND task = 2")
def v03(spark, sf):
    marked = (F.col("method") == "signup") & (F.col("task") == 2)
    d = X.results(spark, sf).withColumn("extra", F.when(marked, F.create_map(F.lit("provenance"), F.lit("generated"))).otherwise(F.create_map(F.lit("n"), F.lit("1"))))
    return V.generated_rows(d).select("run_no")


@query("v04_main_not_cheaper", RP.MC + RP.CURVE + f", m AS (SELECT t, total_h AS main_h FROM cv WHERE method = 'view') SELECT method, t FROM cv JOIN m USING (t) WHERE method IN ('click', 'purchase') AND t >= 2 AND main_h >= total_h UNION ALL SELECT 'checked', count(*)::INT FROM cv")
def v04(spark, sf):
    c = C.cost_curve(RP.method_costs(spark, sf), RP.MAIN, RP.INFLUENCE, RP.OFFLINE, RP.RECOMPUTE, [1, 3, 5, 10])
    bad = V.costlier_main(c, RP.MAIN, RP.INFLUENCE).select("method", "t")
    return bad.unionByName(c.agg(F.lit("checked").alias("method"), F.count(F.lit(1)).cast("int").alias("t")))


@query("v05_overlap_symmetry", "WITH " + OVERLAP + """, b AS (SELECT method, "left", "right", CASE WHEN "left" = 'en' AND "right" = 'fr' THEN jaccard + 0.1 WHEN "left" = 'de' AND "right" = 'de' THEN 0.9 ELSE jaccard END AS jaccard FROM om)
SELECT method, "left", "right", 'diagonal' AS rule FROM b WHERE "left" = "right" AND abs(jaccard - 1) > 1e-12
UNION ALL SELECT b.method, b."left", b."right", 'symmetric' FROM b LEFT JOIN b c ON b.method = c.method AND b."left" = c."right" AND b."right" = c."left" WHERE c.jaccard IS NULL OR abs(b.jaccard - c.jaccard) > 1e-12""")
def v05(spark, sf):
    o = L.overlap_rows(overlap_documents(spark, sf))
    l, rr, j = F.col("left"), F.col("right"), F.col("jaccard")
    broken = F.when((l == "en") & (rr == "fr"), j + 0.1).when((l == "de") & (rr == "de"), 0.9).otherwise(j)
    return V.bad_overlap(o.withColumn("jaccard", broken))


MATCH = RP.MM + ", a AS (SELECT config, task, avg(metric) AS matched FROM ev2 WHERE method = 'view' AND src = tgt GROUP BY ALL), b AS (SELECT config, task, avg(metric) AS diagonal FROM ev2 WHERE method IN ('view', 'click') AND src = tgt AND (method = 'view' OR task = 1) GROUP BY ALL)"


@query("v06_matched_diagonal", MATCH + " SELECT config, task FROM a LEFT JOIN b USING (config, task) WHERE diagonal IS NULL OR abs(matched - diagonal) > 1e-9")
def v06(spark, sf):
    d = RP.with_targets(spark, sf).where("src = tgt").withColumn("metric", F.when(~F.isnan("metric"), F.col("metric")))
    matched = d.where("method = 'view'")
    diagonal = d.where("method = 'view' or (method = 'click' and task = 1)")
    return V.diagonal_mismatch(matched, diagonal, ["config", "task"], 1e-9).select("config", "task")


@query("v07_off_diagonal", RP.MM + ", g AS (SELECT task, src, tgt, avg(metric) AS m FROM ev2 GROUP BY ALL), d AS (SELECT *, max(CASE WHEN src = tgt THEN m END) OVER (PARTITION BY task, tgt) AS diag FROM g) SELECT task, src, tgt FROM d WHERE diag IS NULL OR (src <> tgt AND m > diag + 1e-9)")
def v07(spark, sf):
    d = RP.with_targets(spark, sf).withColumn("metric", F.when(~F.isnan("metric"), F.col("metric")))
    m = d.groupBy("task", "src", "tgt").agg(F.avg("metric").alias("mean"))
    return V.off_diagonal_above(m, ["task"]).select("task", "src", "tgt")


@query("v08_copies_differ", "WITH a AS (SELECT doc_id AS id, source FROM documents), b AS (SELECT doc_id AS id, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN source || '!' ELSE source END AS source FROM documents) (SELECT id, source, 'left' AS only_in FROM a EXCEPT ALL SELECT id, source, 'left' FROM b) UNION ALL (SELECT id, source, 'right' FROM b EXCEPT ALL SELECT id, source, 'right' FROM a)")
def v08(spark, sf):
    a = X.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source")
    toxic = X.table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"), F.lit("!").alias("x"))
    b = a.join(toxic, "id", "left").select("id", F.concat("source", F.coalesce("x", F.lit(""))).alias("source"))
    return V.differences(a, b)


@query("v09_bad_json_lines", "SELECT event_id FROM events WHERE event_type = 'error'")
def v09(spark, sf):
    cut = F.when(F.col("event_type") == "error", F.expr("left(props, length(props) - 1)")).otherwise(F.col("props"))
    return V.bad_lines(X.table(spark, sf, "events").select("event_id", cut.alias("value")), "k bigint").select("event_id")


@query("v10_unique_and_covered", "WITH d AS (SELECT l_orderkey AS id FROM lineitem GROUP BY 1 HAVING count(*) > 1), m AS (SELECT DISTINCT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) SELECT 'duplicate' AS rule, id FROM d UNION ALL SELECT 'missing', id FROM m")
def v10(spark, sf):
    li = X.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"))
    o = X.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    dup = duplicates(li, "id").select(F.lit("duplicate").alias("rule"), "id")
    gap = missing(o, li, "id").distinct().select(F.lit("missing").alias("rule"), "id")
    return dup.unionByName(gap)


@query("f10_coverage_join", "SELECT o_orderkey AS id, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def f10(spark, sf):
    from siftwork.operators.common import assert_covers

    li = X.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"))
    o = X.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    assert_covers(o, li, "id")  # a line without its order is an error
    return o.join(li, "id").groupBy("id").agg(F.count(F.lit(1)).alias("n"))
