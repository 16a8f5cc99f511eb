"""Sampling queries: budgets, sketches, label-acquisition phases, pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwork.functions import vectors as V
from siftwork.functions.ids import order_key
from siftwork.operators import sampling as S
from siftwork.operators import utility as U
from siftwork.operators.common import resolve_budget
from siftwork.plans import sqltext as T
from siftwork.plans import views as X
from siftwork.plans.catalog import query
from siftwork.plans.configurations import SPEC_VALUES
from siftwork.plans.utilities import LABELS, ULO, hi_labels, u_lo
from siftwork.session import cut_lineage
from siftwork.sources import registry as R

r = T.r


@query("d01_budgets", "WITH " + T.POOL_TEXT + ", g AS (SELECT source, count(*) AS n FROM pool_text GROUP BY 1) SELECT source, b AS budget, CASE WHEN b >= 1 THEN b::BIGINT ELSE greatest(1, round_even(b * n, 0))::BIGINT END AS k FROM g, (VALUES (0.05::DOUBLE), (0.1), (0.3), (1.0), (12.0)) AS t(b)")
def d01(spark, sf):
    g = X.pool_text(spark, sf).groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    g = g.withColumn("budget", F.explode(F.array(*[F.lit(x) for x in (0.05, 0.1, 0.3, 1.0, 12.0)])))
    share = F.greatest(F.lit(1.0), F.bround(F.col("budget") * F.col("n")))
    k = F.when(F.col("budget") >= 1, F.col("budget")).otherwise(share).cast("bigint")
    return g.select("source", "budget", k.alias("k"))


@query("d02_uniform_sample", "SELECT doc_id AS sample_id FROM documents ORDER BY md5('3:' || doc_id), doc_id LIMIT 100")
def d02(spark, sf):
    return S.uniform_sample(X.pool_text(spark, sf).select("sample_id"), 100, seed=3).select("sample_id")


@query("d03_stratified_sample", """WITH w AS (SELECT doc_id AS sample_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('1:' || doc_id), doc_id) AS draw FROM documents)
SELECT sample_id, source FROM w WHERE draw <= greatest(1, 150 // (SELECT count(DISTINCT source) FROM documents)) ORDER BY source, draw, sample_id LIMIT 150""")
def d03(spark, sf):
    return S.balanced_sample(X.pool_text(spark, sf).select("sample_id", "source"), 150, 1, "source").select("sample_id", "source")


@query("d03_stratified_fill", """WITH w AS (SELECT doc_id AS sample_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('1:' || doc_id), doc_id) AS draw FROM documents)
SELECT sample_id, source FROM w ORDER BY draw, source, sample_id LIMIT 150""")
def d03_fill(spark, sf):
    return S.balanced_sample(X.pool_text(spark, sf).select("sample_id", "source"), 150, 1, "source", fill=True).select("sample_id", "source")


@query("d04_sketch", "WITH " + T.SKETCH + " SELECT sample_id, stratum::BIGINT AS stratum FROM sketch")
def d04(spark, sf):
    return X.sketch(spark, sf).select("sample_id", F.col("stratum").cast("bigint").alias("stratum"))


@query(
    "d05_sketch_replicates",
    "WITH " + T.POOL + """, src AS (SELECT p.sample_id, row_number() OVER (ORDER BY length(response), sample_id) AS lr, count(*) OVER () AS n FROM pool p WHERE sample_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
g AS (SELECT seed, size, sample_id, n, CASE WHEN n < 3 * size THEN 0 WHEN lr <= n // 3 THEN 0 WHEN lr <= 2 * n // 3 THEN 1 ELSE 2 END AS stratum FROM src, (VALUES (0), (1), (2)) AS s(seed), (VALUES (0), (8), (16), (32), (64)) AS z(size)),
p AS (SELECT *, row_number() OVER (PARTITION BY seed, size, stratum ORDER BY md5(seed || ':' || sample_id), sample_id) AS pick FROM g)
SELECT seed::BIGINT AS seed, size::BIGINT AS size, sample_id FROM p WHERE pick <= CASE WHEN n < 3 * size THEN size ELSE size // 3 + (stratum < size % 3)::INT END""",
)
def d05(spark, sf):
    d = S.sketch_replicates(X.sketch_source(spark, sf), [0, 1, 2], [0, 8, 16, 32, 64])
    return d.select(F.col("seed").cast("bigint").alias("seed"), F.col("size").cast("bigint").alias("size"), "sample_id")


@query("d06_estimation_subset", "WITH " + T.TRUTH + " SELECT sample_id, u_hi FROM truth ORDER BY md5('7:' || sample_id), sample_id LIMIT 64")
def d06(spark, sf):
    return S.uniform_sample(X.truth(spark, sf), 64, seed=7).select("sample_id", "u_hi")


@query("d07_phase_split", "SELECT source, floor(count(*) * 0.5)::BIGINT AS phase1, floor(count(*) * 0.3::DOUBLE)::BIGINT AS phase2, (count(*) - floor(count(*) * 0.5)::BIGINT - floor(count(*) * 0.3::DOUBLE)::BIGINT)::BIGINT AS phase3 FROM documents GROUP BY 1")
def d07(spark, sf):
    g = X.pool_text(spark, sf).groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    first, second = F.floor(F.col("n") * 0.5), F.floor(F.col("n") * 0.3)
    return g.select("source", first.alias("phase1"), second.alias("phase2"), (F.col("n") - first - second).alias("phase3"))


COVER_TASKS = ["gsm8k", "mmlu"]


def _coverage(spark, sf, strata, pool):
    configs = R.specs(spark).select(F.col("name").alias("config"), "family", "rank", "bottleneck", "prefix_len")
    return S.coverage_triples(pool, configs, COVER_TASKS, 400, 0, strata)


def coverage_sql(strata: str, pool: str) -> str:
    return f"""kinds AS (SELECT name AS config, family, CASE WHEN sz < 8 THEN 'xs' WHEN sz < 16 THEN 's' WHEN sz < 32 THEN 'm' ELSE 'l' END AS capacity FROM (SELECT *, coalesce(nullif(rank, 0), nullif(bottleneck, 0), nullif(prefix_len, 0), 8) AS sz FROM specs)),
sh AS (SELECT {strata}, sample_id, row_number() OVER (PARTITION BY {strata} ORDER BY md5('0:' || sample_id), sample_id) AS rs FROM {pool}),
tr AS (SELECT {strata}, sample_id, rs, config, family, capacity, task FROM sh, kinds, (VALUES ('gsm8k'), ('mmlu')) AS t(task)),
rd AS (SELECT *, row_number() OVER (PARTITION BY {strata}, family, capacity, task ORDER BY rs, md5('0:' || rs || ':' || config || ':' || task)) AS round FROM tr),
cov AS (SELECT *, md5('0:' || {" || ':' || ".join(s.strip() for s in strata.split(","))} || ':' || family || ':' || capacity || ':' || task) AS hs FROM rd)
SELECT {strata}, family, capacity, task, config, sample_id, round::BIGINT AS round FROM cov ORDER BY cov.round, hs, sample_id, config LIMIT 400"""


@query("d08_coverage_triples", "WITH " + T.POOL + ", " + SPEC_VALUES + ", " + coverage_sql("cluster_id", "pool"))
def d08(spark, sf):
    out = _coverage(spark, sf, ["cluster_id"], X.pool_vectors(spark, sf))
    return out.drop("position").withColumn("round", F.col("round").cast("bigint"))


@query("d13_rich_coverage_triples", "WITH " + T.POOL + ", p2 AS (SELECT sample_id, cluster_id, source, CASE WHEN length(response) < 500 THEN 'easy' WHEN length(response) < 2000 THEN 'mid' ELSE 'hard' END AS band FROM pool), " + SPEC_VALUES + ", " + coverage_sql("cluster_id, source, band", "p2"))
def d13(spark, sf):
    n = F.length("response")
    band = F.when(n < 500, "easy").when(n < 2000, "mid").otherwise("hard")
    p = X.pool(spark, sf).select("sample_id", "cluster_id", "source", band.alias("band"))
    out = _coverage(spark, sf, ["cluster_id", "source", "band"], p)
    return out.drop("position").withColumn("round", F.col("round").cast("bigint"))


@query("d09_capacity_buckets", "WITH " + SPEC_VALUES + " SELECT p_partkey AS config, CASE WHEN sz < 8 THEN 'xs' WHEN sz < 16 THEN 's' WHEN sz < 32 THEN 'm' ELSE 'l' END AS capacity FROM (SELECT p_partkey, coalesce(nullif(rank, 0), nullif(bottleneck, 0), nullif(prefix_len, 0), 8) AS sz FROM part JOIN specs ON spec_no = p_partkey % 17)")
def d09(spark, sf):
    from siftwork.plans.configurations import instances

    return instances(spark, sf).select("config", S.capacity_bucket("rank", "bottleneck", "prefix_len").alias("capacity"))


@query(
    "d10_uncertainty_triples",
    "WITH " + LABELS + f""", op AS (SELECT *, sigma_est * (1 + 0.5 * greatest(u_hi, 0)) AS score FROM hi WHERE (sample_id, peft_id, task_id) NOT IN (SELECT (l_partkey, l_returnflag, l_linestatus) FROM lineitem WHERE l_quantity > 40))
SELECT sample_id, peft_id, task_id, {r('score')} AS score FROM op ORDER BY op.score DESC, sample_id, peft_id, task_id LIMIT 200""",
)
def d10(spark, sf):
    cand = cut_lineage(hi_labels(spark, sf)).withColumnsRenamed({"u_hi": "u_lo", "sigma_est": "sigma"})
    done = X.table(spark, sf, "lineitem").where("l_quantity > 40").select(
        F.col("l_partkey").alias("sample_id"), F.col("l_returnflag").alias("peft_id"), F.col("l_linestatus").alias("task_id")
    )
    out = S.uncertainty_triples(cand, done, 200)
    return out.select("sample_id", "peft_id", "task_id", F.round("score", 6).alias("score"))


@query(
    "d11_boundary_triples",
    "WITH " + LABELS + f""", rk AS (SELECT sample_id, peft_id, task_id, row_number() OVER (PARTITION BY peft_id, task_id ORDER BY round(delta_raw, 4) DESC, sample_id) AS sr, row_number() OVER (PARTITION BY peft_id, task_id ORDER BY round(u_hi, 9) DESC, sample_id) AS tr FROM hi),
b AS (SELECT *, abs(sr - tr)::DOUBLE / greatest(1.0::DOUBLE, tr) AS score FROM rk) SELECT sample_id, peft_id, task_id, {r('score')} AS score FROM b ORDER BY b.score DESC, sample_id, peft_id, task_id LIMIT 200""",
)
def d11(spark, sf):
    from siftwork.functions.ranks import ranked

    h = hi_labels(spark, sf).withColumn("d", F.round("delta_raw", 4)).withColumn("u", F.round("u_hi", 9))
    h = cut_lineage(h.select("sample_id", "peft_id", "task_id", "d", "u"))
    a = ranked(h, ["peft_id", "task_id"], ["-d", "sample_id"], name="scorer_rank")
    b = ranked(a, ["peft_id", "task_id"], ["-u", "sample_id"], name="true_rank")
    out = S.boundary_triples(cut_lineage(b), 200)
    return out.select("sample_id", "peft_id", "task_id", F.round("score", 6).alias("score"))


@query(
    "d12_rank_pairs",
    "WITH " + LABELS + """, s AS (SELECT *, row_number() OVER (PARTITION BY peft_id, task_id ORDER BY md5('0:' || peft_id || ':' || task_id || ':' || sample_id), sample_id) AS rn FROM hi)
SELECT a.peft_id, a.task_id, a.sample_id AS left_id, b.sample_id AS right_id FROM s a JOIN s b ON a.peft_id = b.peft_id AND a.task_id = b.task_id AND b.rn = a.rn + 1 WHERE a.rn % 2 = 1 AND a.rn <= 127""",
)
def d12(spark, sf):
    p = S.rank_pairs(hi_labels(spark, sf), "u_hi", ["peft_id", "task_id"], 64)
    return p.select("peft_id", "task_id", "left_id", "right_id")
