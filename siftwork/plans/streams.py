"""Streaming queries: each runs the job on files made from the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwork.functions import vectors as V
from siftwork.operators import clusters as CL
from siftwork.operators import ood as O
from siftwork.operators.common import attach
from siftwork.plans import sqltext as T
from siftwork.plans import views as X
from siftwork.plans.catalog import query
from siftwork.plans.models import D2, _stored_sql, stored_model, task_table
from siftwork.plans.reports import costs, rounded
from siftwork.session import cut_lineage, scratch_path
from siftwork.streaming import jobs as J

r = T.r
COST_SCHEMA = "run_no bigint, stage string, ts timestamp, run_id bigint, gpu_hours double"
CE = "ce AS (SELECT event_type AS stage, ts, user_id AS run_id, value * 8 / 3600.0::DOUBLE AS h FROM events), wm AS (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE AS m FROM events)"


def cost_stream(spark, sf):
    path = scratch_path(spark, "cost-log")
    costs(spark, sf).select("run_no", "stage", "ts", "run_id", "gpu_hours").write.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").json(path)
    return J.read_stream(spark, path, COST_SCHEMA)


def _stamps(df):
    for c in ("start", "end"):
        df = df.withColumn(c, F.unix_micros(c))
    return rounded(df, "gpu_hours")


@query("w01_cost_rollup", "WITH " + CE + f" SELECT epoch_us(s) AS start, epoch_us(s + INTERVAL 1 HOUR) AS \"end\", stage, {r('sum(h)')} AS gpu_hours, count(*) AS n FROM (SELECT *, date_trunc('hour', ts) AS s FROM ce) GROUP BY ALL HAVING s + INTERVAL 1 HOUR <= (SELECT m FROM wm)")
def w01(spark, sf):
    return _stamps(J.cost_rollup(cost_stream(spark, sf), scratch_path(spark, "w01")))


@query("w05_sliding_windows", "WITH " + CE + f""", sw AS (SELECT date_trunc('hour', ts) - o * INTERVAL 1 HOUR AS s, stage, h FROM ce, (VALUES (0), (1)) AS x(o))
SELECT epoch_us(s) AS start, epoch_us(s + INTERVAL 2 HOUR) AS "end", stage, {r('sum(h)')} AS gpu_hours, count(*) AS n FROM sw GROUP BY ALL HAVING s + INTERVAL 2 HOUR <= (SELECT m FROM wm)""")
def w05(spark, sf):
    return _stamps(J.cost_rollup(cost_stream(spark, sf), scratch_path(spark, "w05"), "2 hours", "1 hour"))


@query("w05_session_windows", "WITH " + CE + f""", g AS (SELECT *, (ts >= lag(ts) OVER (PARTITION BY run_id ORDER BY ts) + INTERVAL 30 MINUTE)::INT AS brk FROM ce),
ss AS (SELECT *, sum(coalesce(brk, 0)) OVER (PARTITION BY run_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT run_id, epoch_us(min(ts)) AS start, epoch_us(max(ts) + INTERVAL 30 MINUTE) AS "end", {r('sum(h)')} AS gpu_hours, count(*) AS n FROM ss GROUP BY run_id, sid HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT m FROM wm)""")
def w05_sessions(spark, sf):
    return _stamps(J.cost_sessions(cost_stream(spark, sf), scratch_path(spark, "w05s")))


@query("w02_running_aggregates", "WITH " + T.RESULTS + f" SELECT method, config, {r('avg(metric)')} AS mean, {r('coalesce(stddev_pop(metric), 0)')} AS std, count(metric) AS n FROM results GROUP BY ALL")
def w02(spark, sf):
    path = scratch_path(spark, "result-log")
    X.results(spark, sf).select("method", "config", "metric").repartition(3).write.json(path)
    s = J.read_stream(spark, path, "method string, config bigint, metric double", files_per_batch=1)
    return rounded(J.result_aggregates(s, scratch_path(spark, "w02"), ["method", "config"]), "mean", "std")


@query("w03_streaming_ingest", "WITH " + T.POOL_TEXT + " SELECT DISTINCT substr(sha256(instruction || chr(31) || response || chr(31) || coalesce(source, '')), 1, 16) AS sample_id FROM pool_text")
def w03(spark, sf):
    path = scratch_path(spark, "pool-log")
    rows = X.pool_text(spark, sf).withColumn("ts", F.timestamp_seconds(F.lit(1704067200) + F.col("sample_id") * 3600))
    # three batches; the files follow the size of the documents and the cores
    parts = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").rdd.getNumPartitions()
    each = -(-max(parts, spark.sparkContext.defaultParallelism) // 3)
    rows.select("instruction", "response", "source", "ts").repartition(3 * each).write.json(path)
    s = J.read_stream(spark, path, "instruction string, response string, source string, ts timestamp", files_per_batch=each)
    return J.ingest(s, scratch_path(spark, "w03")).select("sample_id")


SHARE, BIN = 0.1, 0.01
APPLY = _stored_sql(f"SELECT sample_id, mu, greatest(z, 0) + ln(1 + exp(-abs(z))) + 0.001 AS sigma FROM st WHERE config = 'AD-b64' AND '$task' = 'good'")


@query(
    "w04_streaming_selection",
    "WITH RECURSIVE " + D2 + """, ce AS (SELECT cluster_id AS c, list(v ORDER BY i) AS m FROM (SELECT cluster_id, i, avg(joint[i]) AS v FROM pool, range(1, 65) AS d(i) GROUP BY ALL) GROUP BY 1),
nc AS (SELECT sample_id, c AS cluster_id FROM pool, ce QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY round(list_dot_product(joint, joint) - 2 * list_dot_product(joint, m) + list_dot_product(m, m), 9), c) = 1),
"""
    + f"""sc AS ({APPLY}),
rows_ AS (SELECT sc.sample_id, cluster_id, mu, sigma, floor((mu - 0.2 * sigma) / {BIN})::BIGINT AS bin,
  CASE WHEN sc.sample_id IN (SELECT doc_id FROM labels) THEN 0 WHEN sc.sample_id % 2 = 0 THEN 1 ELSE 2 END AS batch FROM sc JOIN nc USING (sample_id)),
hist AS (SELECT b.batch, r.cluster_id, r.bin, count(*) AS n FROM rows_ r JOIN (VALUES (1), (2)) b(batch) ON r.batch < b.batch GROUP BY ALL),
cum AS (SELECT *, sum(n) OVER (PARTITION BY batch, cluster_id ORDER BY bin DESC) AS above, sum(n) OVER (PARTITION BY batch, cluster_id) AS seen FROM hist),
cut AS (SELECT batch, cluster_id, coalesce(min(bin) FILTER (WHERE above <= seen * {SHARE}::DOUBLE), max(bin) + 1) AS edge FROM cum GROUP BY ALL)
SELECT sample_id, r.cluster_id, {r('mu')} AS mu, {r('sigma')} AS sigma, d2 > (SELECT quantile_cont(d2, 0.95) FROM dd) AS is_ood, coalesce(bin >= edge, false) AS keep, r.batch - 1 AS batch_no
FROM rows_ r JOIN dd USING (sample_id) LEFT JOIN cut ON cut.batch = r.batch AND cut.cluster_id = r.cluster_id WHERE r.batch > 0""",
)
def w04(spark, sf):
    """Labelled rows stand for the last batch selection; the others come in two batches."""
    pool = X.pool_vectors(spark, sf).select("sample_id", "joint", "cluster_id")
    centres = cut_lineage(V.vector_mean(pool, "joint", ["cluster_id"], "centre"))
    triples, conditions = task_table(spark, sf)
    one = conditions.where("config = 'AD-b64' AND task = 'good'").select("z_p", "z_t")
    model = stored_model()
    stats = O.fit(pool, "joint")

    def score(batch):
        d = model.score(attach(batch.withColumnRenamed("joint", "z_x"), one)).withColumnRenamed("z_x", "joint")
        far = O.flag(batch, stats, "joint").select("sample_id", "is_ood")
        return d.select("sample_id", "joint", "mu", "sigma").join(far, "sample_id")

    def assign(batch):
        return batch.join(CL.assign(batch, centres).drop("distance"), "sample_id").drop("joint")

    known = X.table(spark, sf, "labels").select(F.col("doc_id").alias("sample_id"))
    first = assign(score(pool.select("sample_id", "joint").join(known, "sample_id", "left_semi")))
    path = scratch_path(spark, "new-rows")
    new = pool.select("sample_id", "joint").join(known, "sample_id", "left_anti")
    for odd in (0, 1):
        new.where(F.col("sample_id") % 2 == odd).coalesce(1).write.mode("append").json(path)
    s = J.read_stream(spark, path, "sample_id bigint, joint array<double>", files_per_batch=1)
    out = J.apply_selection(s, scratch_path(spark, "w04"), score, assign, first.withColumn("q", F.col("mu") - 0.2 * F.col("sigma")), SHARE, BIN)
    return rounded(out.select("sample_id", F.col("cluster_id").cast("bigint").alias("cluster_id"), "mu", "sigma", "is_ood", "keep", F.col("batch_id").cast("int").alias("batch_no")), "mu", "sigma")
