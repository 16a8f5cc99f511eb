"""Source and sink queries. Files go to a fresh path under the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwork.functions import ids as I
from siftwork.functions import text as TX
from siftwork.functions import vectors as V
from siftwork.operators import common as C
from siftwork.plans import sqltext as T
from siftwork.plans import views as X
from siftwork.plans.catalog import query
from siftwork.session import scratch_path
from siftwork.sources import logs as L
from siftwork.sources import pool as P
from siftwork.sources import tables as S

r = T.r
SID = "substr(sha256(instruction || chr(31) || response || chr(31) || coalesce(source, '')), 1, 16)"


def pool_lines(spark, sf):
    """The documents as JSON lines under foreign key names, each followed by a blank line."""
    p = X.pool_text(spark, sf)
    row = F.to_json(F.struct(F.col("instruction").alias("prompt"), F.col("response").alias("answer"), F.col("source").alias("origin"), "language"))
    bad = F.when(F.col("language") == "es", F.concat(F.lit("{"), row)).otherwise(row)
    return p.select("sample_id", F.explode(F.array(bad, F.lit("  "))).alias("value"))


def parsed(spark, sf):
    d = pool_lines(spark, sf).withColumnRenamed("sample_id", "line_no")
    return P.parse_pool(d, "prompt", "answer", "origin")


@query("a01_pool_scan", "WITH " + T.POOL_TEXT + f" SELECT sample_id AS line_no, {SID} AS sample_id, length(instruction)::BIGINT AS li, length(response)::BIGINT AS lr FROM pool_text WHERE language <> 'es'")
def a01(spark, sf):
    d = P.good_rows(parsed(spark, sf))
    return d.select("line_no", "sample_id", F.length("instruction").cast("bigint").alias("li"), F.length("response").cast("bigint").alias("lr"))


@query("a01_quarantine", "SELECT doc_id AS line_no FROM documents WHERE lang = 'es'")
def a01_bad(spark, sf):
    return P.quarantine(parsed(spark, sf)).select("line_no")


@query("a02_sample_ids", "WITH " + T.POOL_TEXT + f" SELECT sample_id AS doc_id, {SID} AS sample_id FROM pool_text")
def a02(spark, sf):
    return X.pool_text(spark, sf).select(F.col("sample_id").alias("doc_id"), I.sample_id().alias("sample_id"))


@query("a03_task_ids", "SELECT conv_id, substr(sha256('dialogue' || chr(31) || string_agg(turn::VARCHAR, ',' ORDER BY turn)), 1, 16) AS task_id FROM conversations GROUP BY 1")
def a03(spark, sf):
    # a conversation stands for a sketch: its turns are the members
    c = X.table(spark, sf, "conversations").groupBy("conv_id").agg(F.collect_list("turn").alias("members"))
    return c.select("conv_id", I.task_id(F.lit("dialogue"), "members").alias("task_id"))


@query("a04_duplicate_ids", "WITH " + T.POOL_TEXT + f" SELECT {SID} AS content_id, count(*) AS n FROM pool_text GROUP BY 1 HAVING count(*) > 1")
def a04(spark, sf):
    d = X.pool_text(spark, sf).select(I.sample_id().alias("content_id"))
    return C.duplicates(d, "content_id")


@query("a05_take_in_order", "WITH req AS (SELECT event_id AS position, user_id * 7 AS sample_id FROM events) SELECT position, req.sample_id, source, doc_id IS NOT NULL AS found FROM req LEFT JOIN documents ON doc_id = req.sample_id")
def a05(spark, sf):
    req = X.table(spark, sf, "events").select(F.col("event_id").alias("position"), (F.col("user_id") * 7).alias("sample_id"))
    return P.take(X.pool_text(spark, sf).select("sample_id", "source"), req).select("position", "sample_id", "source", "found")


@query("a06_pool_sink", "WITH " + T.POOL_TEXT + " SELECT language, count(*) AS n_rows, sum(length(response))::BIGINT AS n_chars FROM pool_text GROUP BY 1")
def a06(spark, sf):
    path = scratch_path(spark, "pool")
    P.write_pool(X.pool_text(spark, sf), path)
    d = P.good_rows(P.parse_pool(spark.read.text(path)))
    return d.groupBy("language").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.length("response")).alias("n_chars"))


@query("a07_sketch_document", "WITH " + T.SKETCH + " SELECT 'demo' AS task_id, sample_id::VARCHAR AS sample_id, language, length(response)::BIGINT AS lr FROM sketch")
def a07(spark, sf):
    path = scratch_path(spark, "sketch")
    P.sketch_document(X.sketch(spark, sf), "demo").coalesce(1).write.text(path)
    return P.read_sketches(spark, path).select("task_id", "sample_id", "language", F.length("response").cast("bigint").alias("lr"))


@query("a08_feature_table", "WITH " + T.POOL + f" SELECT sample_id, {r('list_sum(joint)')} AS total, 64::BIGINT AS width FROM pool")
def a08(spark, sf):
    path = scratch_path(spark, "features")
    p = X.pool_vectors(spark, sf)
    S.write_features(p.select("sample_id", F.col("joint").alias("e_x_joint"), F.slice("joint", 1, 16).alias("d_x")), path)
    d = S.read_features(spark, path, ["e_x_joint"])
    return d.select("sample_id", F.round(V.total("e_x_joint"), 6).alias("total"), F.size("e_x_joint").cast("bigint").alias("width"))


@query("a09_signature_store", "WITH " + T.POOL + ", " + T.SIGNATURES + f" SELECT sample_id, layer::BIGINT AS layer, module, {r('g[1]')} AS g0 FROM signatures WHERE (layer = 7 AND module = 'mlp_out') OR (layer = 31 AND module = 'attn_out')")
def a09(spark, sf):
    path = scratch_path(spark, "signatures")
    S.write_signatures(X.signatures(spark, sf).select("sample_id", "layer", "module", "g"), path)
    d = S.read_signatures(spark, path, [(7, "mlp_out"), (31, "attn_out")])
    return d.select("sample_id", F.col("layer").cast("bigint").alias("layer"), "module", F.round(F.col("g")[0], 6).alias("g0"))


@query("a10_row_order", "WITH " + T.POOL + " SELECT sample_id, row_number() OVER (ORDER BY sample_id)::BIGINT AS position FROM pool")
def a10(spark, sf):
    from siftwork.functions.ranks import ranked

    d = ranked(X.pool_vectors(spark, sf).select("sample_id"), [], ["sample_id"], name="position")
    return d.select("sample_id", F.col("position").cast("bigint").alias("position"))


@query("a11_external_scores", "WITH " + T.POOL + ", ext AS (SELECT sample_id, (('0x' || substr(md5('ifd:' || sample_id), 1, 6))::BIGINT % 1000)::DOUBLE AS ifd FROM pool) SELECT sample_id, ifd FROM ext")
def a11(spark, sf):
    from siftwork.plans.selection import external_scores

    path = scratch_path(spark, "scores")
    external_scores(spark, sf).select("sample_id", "ifd").write.parquet(path)
    return S.read_external_scores(spark, path, X.pool_vectors(spark, sf).select("sample_id"))


@query("a13_label_table", "WITH " + T.DELTAS + f" SELECT sample_id, anchor_idx, horizon, {r('delta_raw', 4)} AS delta_raw FROM deltas WHERE peft_id = 'R' AND task_id = 'F'")
def a13(spark, sf):
    path = scratch_path(spark, "labels")
    S.write_labels(X.deltas(spark, sf), path)
    d = spark.read.parquet(path).where("peft_id = 'R' and task_id = 'F'")
    return d.select("sample_id", "anchor_idx", "horizon", F.round("delta_raw", 4).alias("delta_raw"))


@query("a14_cost_log", "WITH " + T.COST + f" SELECT stage, count(*) AS n, {r('sum(wall_time_sec)', 2)} AS wall FROM cost_events GROUP BY 1")
def a14(spark, sf):
    path = scratch_path(spark, "cost")
    e = X.cost_events(spark, sf).select("stage", "wall_time_sec", "ts", F.create_map(F.lit("run"), F.col("run_id").cast("string")).alias("extra"))
    early = F.col("ts") < F.lit("2024-01-15").cast("timestamp")
    L.append_log(e.where(early), path)
    L.append_log(e.where(~early), path)
    d = L.read_log(spark, path, L.COST_SCHEMA)
    return d.groupBy("stage").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("wall_time_sec"), 2).alias("wall"))


def result_lines(spark, sf):
    """Result rows as JSON text with NaN metrics and an ``extra`` object."""
    d = X.results(spark, sf)
    extra = F.to_json(F.struct(F.concat(F.lit("L"), (F.col("seed")).cast("string")).alias("level"), F.col("task").cast("string").alias("sub"), F.col("run_no").cast("string").alias("n_selected")))
    metric = F.when(F.isnan("metric"), "NaN").otherwise(F.col("metric").cast("string"))
    text = F.concat(F.lit('{"method":"'), "method", F.lit('","seed":'), F.col("seed").cast("string"), F.lit(',"metric":'), metric, F.lit(',"extra":'), extra, F.lit("}"))
    return d.select(F.explode(F.array(text, F.lit(""))).alias("value"))


@query("a15_result_log", "WITH " + T.RESULTS + " SELECT method, count(*) AS n, count(metric) AS n_metric FROM results GROUP BY 1")
def a15(spark, sf):
    d = L.parse_results(result_lines(spark, sf))
    return d.groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.count("metric").alias("n_metric"))


@query("a16_extra_columns", "WITH " + T.RESULTS + " SELECT run_no::VARCHAR AS n_selected, 'L' || seed AS level, task::VARCHAR AS sub, NULL::VARCHAR AS axis FROM results")
def a16(spark, sf):
    d = L.with_extra_columns(L.parse_results(result_lines(spark, sf)))
    return d.select("n_selected", "level", "sub", "axis")


@query("a17_selection_output", "WITH " + T.POOL + " SELECT cluster_id::BIGINT AS task_no, sample_id, rn::BIGINT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY joint[1] DESC, sample_id) AS rn FROM pool) WHERE rn <= 5")
def a17(spark, sf):
    from siftwork.functions.ranks import ranked

    p = X.pool_vectors(spark, sf).withColumn("q", F.col("joint")[0]).withColumn("_k", F.lit(5))
    sel = ranked(p, ["cluster_id"], ["-q", "sample_id"], upto="_k", name="rank").select(
        "sample_id", "q", "rank", F.lit("L-r8-qv").alias("peft_id"), F.col("cluster_id").alias("task_id")
    )
    path = scratch_path(spark, "selection")
    S.write_selection(sel, path)
    d = spark.read.parquet(path)
    return d.select(F.col("task_id").cast("bigint").alias("task_no"), "sample_id", F.col("rank").cast("bigint").alias("rank"))


@query("a18_candidate_features", "WITH " + T.POOL + f" SELECT sample_id, {r('joint[1]')} AS head FROM pool WHERE sample_id IN (SELECT doc_id FROM labels)")
def a18(spark, sf):
    f = X.vectors(spark, sf)
    lab = X.table(spark, sf, "labels").select(F.col("doc_id").alias("sample_id"))
    candidates = X.pool_vectors(spark, sf).select("sample_id").join(lab, "sample_id", "left_semi")
    return S.features_for(f, candidates).select("sample_id", F.round(F.col("joint")[0], 6).alias("head"))


@query("a19_csv_report", "WITH " + T.RESULTS + " SELECT method, task, count(*) AS n FROM results GROUP BY ALL")
def a19(spark, sf):
    path = scratch_path(spark, "report")
    S.write_report(X.results(spark, sf).groupBy("method", "task").agg(F.count(F.lit(1)).alias("n")), path)
    return spark.read.schema("method string, task bigint, n bigint").option("header", True).csv(path)


OVERLAP = """ov AS (SELECT source AS method, language AS l, count(*) AS n FROM (SELECT source, lang AS language FROM documents) GROUP BY ALL),
om AS (SELECT a.method, a.l AS "left", b.l AS "right", CASE WHEN a.l = b.l THEN 1.0 ELSE round(least(a.n, b.n)::DOUBLE / (a.n + b.n), 6) END AS jaccard FROM ov a JOIN ov b USING (method))"""


def overlap_documents(spark, sf):
    """One nested document per source: language against language, from the row counts."""
    d = X.pool_text(spark, sf).groupBy("source", "language").agg(F.count(F.lit(1)).alias("n"))
    g = d.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("language", "n"))).alias("c"))

    def cell(a, b):
        v = F.when(a["language"] == b["language"], 1.0).otherwise(F.round(F.least(a["n"], b["n"]) / (a["n"] + b["n"]), 6))
        return F.struct(b["language"].alias("k"), v.alias("v"))

    inner = F.map_from_entries(
        F.transform("c", lambda a: F.struct(a["language"].alias("k"), F.map_from_entries(F.transform("c", lambda b: cell(a, b))).alias("v")))
    )
    return g.select(F.to_json(F.struct(F.create_map(F.col("source"), inner).alias("overlap"))).alias("value"))


@query("a20_overlap_rows", "WITH " + OVERLAP + ' SELECT method, "left", "right", jaccard::DOUBLE AS jaccard FROM om')
def a20(spark, sf):
    return L.overlap_rows(overlap_documents(spark, sf))


@query("a21_resumable_keys", "WITH " + T.POOL_TEXT + """, k AS (SELECT sample_id, substr(sha256('stats' || chr(31) || sample_id || chr(31) || md5(response)), 1, 16) AS cache_key FROM pool_text)
SELECT sample_id, cache_key FROM k WHERE sample_id NOT IN (SELECT doc_id FROM labels)""")
def a21(spark, sf):
    p = X.pool_text(spark, sf)
    keyed = p.select("sample_id", I.content_id(F.lit("stats"), "sample_id", F.md5("response")).alias("cache_key"))
    done = keyed.join(X.table(spark, sf, "labels").select(F.col("doc_id").alias("sample_id")), "sample_id", "left_semi")
    path = scratch_path(spark, "stored")
    done.select("cache_key").write.parquet(path)
    return S.only_new(keyed, spark.read.parquet(path))


# ------------------------------------------------------------- conversations


@query(
    "m02_conversation_pairs",
    """WITH t AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS next_role, lead(text) OVER w AS reply FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, substr(sha256(text || chr(31) || reply || chr(31) || 'chat'), 1, 16) AS sample_id, length(reply)::BIGINT AS lr FROM t WHERE role = 'user' AND next_role = 'assistant'""",
)
def m02(spark, sf):
    from pyspark.sql.window import Window as W

    w = W.partitionBy("conv_id").orderBy("turn")
    t = X.table(spark, sf, "conversations")
    d = t.withColumn("next_role", F.lead("role").over(w)).withColumn("reply", F.lead("text").over(w))
    d = d.where("role = 'user' and next_role = 'assistant'")
    return d.select("conv_id", "turn", I.content_id("text", "reply", F.lit("chat")).alias("sample_id"), F.length("reply").cast("bigint").alias("lr"))
