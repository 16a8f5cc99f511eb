"""Configuration queries: one configuration instance per row of ``part``."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwork.functions import vectors as V
from siftwork.operators import configs as C
from siftwork.plans import sqltext as T
from siftwork.plans import views as X
from siftwork.plans.catalog import query
from siftwork.sources import registry as R

r = T.r


def instances(spark, sf):
    """Configurations instantiated by the part table: spec, backbone and recipe by its columns."""
    p = X.dealt(X.table(spark, sf, "part").select("p_partkey", "p_size")).select(
        F.col("p_partkey").alias("config"),
        (F.col("p_partkey") % 17).alias("spec_no"),
        (F.col("p_size") % 4).cast("bigint").alias("model_no"),
        F.pow(F.lit(2), F.col("p_size") % 6).cast("int").alias("batch_size"),
        (F.col("p_size") / 1000.0).alias("dropout"),
        F.element_at(F.array(*[F.lit(x) for x in C.SCHEDULERS]), (F.col("p_size") % 4 + 1).cast("int")).alias("scheduler"),
        F.element_at(F.array(*[F.lit(x) for x in C.OPTIMIZERS]), (F.col("p_size") % 3 + 1).cast("int")).alias("optimizer"),
        F.element_at(F.array(*[F.lit(x) for x in C.INITS]), (F.col("p_size") % 3 + 1).cast("int")).alias("init_method"),
    )
    d = p.join(F.broadcast(R.specs(spark)), "spec_no").join(F.broadcast(R.models(spark)), "model_no")
    return C.with_recipe(C.with_layers(d))


# fixed values: the registry once more, as the SQL twins need it
SPEC_VALUES = """specs(spec_no, name, family, modules, modules_key, grp, layer_range, rank, alpha, bottleneck, prefix_len, lr) AS (VALUES
(0, 'L-r8-qv', 'lora', ['q_proj','v_proj'], 'qv', 'seen', 'all', 8, 16, NULL, NULL, 0.0002::DOUBLE),
(1, 'L-r16-qkvo', 'lora', ['q_proj','k_proj','v_proj','o_proj'], 'qkvo', 'seen', 'all', 16, 32, NULL, NULL, 0.0002),
(2, 'L-r8-mlp', 'lora', ['up_proj','down_proj'], 'mlp', 'seen', 'all', 8, 16, NULL, NULL, 0.0002),
(3, 'IA3-attnmlp', 'ia3', ['k_proj','v_proj','down_proj'], 'ia3_attnffn', 'seen', 'all', NULL, NULL, NULL, NULL, 0.0005),
(4, 'AD-b64', 'adapter', ['o_proj','down_proj'], 'adapter_sites', 'seen', 'all', NULL, NULL, 64, NULL, 0.0003),
(5, 'L-r4-qv', 'lora', ['q_proj','v_proj'], 'qv', 'unseen_config', 'all', 4, 8, NULL, NULL, 0.0002),
(6, 'L-r32-qkvo', 'lora', ['q_proj','k_proj','v_proj','o_proj'], 'qkvo', 'unseen_config', 'all', 32, 64, NULL, NULL, 0.0002),
(7, 'L-r64-all', 'lora', ['q_proj','k_proj','v_proj','o_proj','up_proj','down_proj','gate_proj'], 'all_linear', 'unseen_config', 'all', 64, 128, NULL, NULL, 0.0001),
(8, 'L-r8-lowlayers', 'lora', ['q_proj','v_proj'], 'qv', 'unseen_config', 'low', 8, 16, NULL, NULL, 0.0002),
(9, 'L-r8-highlayers', 'lora', ['q_proj','v_proj'], 'qv', 'unseen_config', 'high', 8, 16, NULL, NULL, 0.0002),
(10, 'L-r16-hlr', 'lora', ['q_proj','k_proj','v_proj','o_proj'], 'qkvo', 'unseen_config', 'all', 16, 32, NULL, NULL, 0.0005),
(11, 'AD-b16', 'adapter', ['o_proj','down_proj'], 'adapter_sites', 'unseen_config', 'all', NULL, NULL, 16, NULL, 0.0003),
(12, 'AD-b256', 'adapter', ['o_proj','down_proj'], 'adapter_sites', 'unseen_config', 'all', NULL, NULL, 256, NULL, 0.0003),
(13, 'IA3-attnonly', 'ia3', ['k_proj','v_proj'], 'ia3_attn', 'unseen_config', 'all', NULL, NULL, NULL, NULL, 0.0005),
(14, 'PRE-l16', 'prefix', ['q_proj','k_proj','v_proj','o_proj'], 'qkvo', 'ood_family', 'all', NULL, NULL, NULL, 16, 0.0002),
(15, 'PT-l32', 'ptuning', ['q_proj','k_proj','v_proj','o_proj'], 'qkvo', 'ood_family', 'all', NULL, NULL, NULL, 32, 0.0002),
(16, 'BF', 'bitfit', ['q_proj','k_proj','v_proj','o_proj'], 'qkvo', 'ood_family', 'all', NULL, NULL, NULL, NULL, 0.0002)),
models(model_no, model, n_layers, backbone_params) AS (VALUES (0, 'llama2-7b', 32, 6.738e9::DOUBLE), (1, 'llama2-13b', 40, 13.02e9), (2, 'qwen2.5-7b', 28, 7.62e9), (3, 'qwen2.5-14b', 48, 14.77e9))"""

ENCODED = """c1 AS (SELECT *, CASE layer_range WHEN 'low' THEN range(0, greatest(1, n_layers // 3))
    WHEN 'mid' THEN range(greatest(1, n_layers // 3), 2 * greatest(1, n_layers // 3))
    WHEN 'high' THEN range(n_layers - greatest(1, n_layers // 3), n_layers) ELSE range(0, n_layers) END AS target_layers FROM c0),
c2 AS (SELECT *, CASE family WHEN 'lora' THEN len(target_layers) * len(modules) * 2 * coalesce(rank, 8) * 4096
    WHEN 'adapter' THEN len(target_layers) * 2 * coalesce(bottleneck, 64) * 4096
    WHEN 'prefix' THEN coalesce(prefix_len, 8) * len(target_layers) * 4096
    WHEN 'ptuning' THEN coalesce(prefix_len, 8) * 4096
    ELSE len(target_layers) * len(modules) * 4096 END::BIGINT AS n_params,
  CASE family WHEN 'lora' THEN 'additive_low_rank' WHEN 'ia3' THEN 'multiplicative' WHEN 'adapter' THEN 'additive_bottleneck'
    WHEN 'bitfit' THEN 'bias_shift' ELSE 'prefix' END AS op FROM c1),
c3 AS (SELECT c2.*, (3 * k.i + b.j)::INT AS site, (round_even((k.i + 1) * n_layers / 8.0, 0) - 1)::INT AS layer, b.m AS module
  FROM c2, range(0, 8) AS k(i), (VALUES (0, 'attn_out'), (1, 'mlp_out'), (2, 'block_residual')) AS b(j, m)),
c4 AS (SELECT *, list_contains(target_layers, layer) AND CASE module
    WHEN 'attn_out' THEN list_has_any(modules, ['q_proj','k_proj','v_proj','o_proj','qkv_proj','attn','attention'])
    WHEN 'mlp_out' THEN list_has_any(modules, ['up_proj','down_proj','gate_proj','mlp','fc1','fc2'])
    ELSE family = 'adapter' END AS active FROM c3),
c5 AS (SELECT *, count(*) FILTER (WHERE active) OVER (PARTITION BY config) AS n_active FROM c4),
c6 AS (SELECT *, CASE WHEN active THEN tanh(ln(1 + n_params / greatest(1, n_active) / 4096.0)) ELSE 0 END AS weight FROM c5),
weights AS (SELECT *, CASE WHEN sum(weight) OVER (PARTITION BY config) <= 1e-6 THEN 0 ELSE weight / sum(weight) OVER (PARTITION BY config) END AS a FROM c6)"""

CFG = (
    SPEC_VALUES
    + """, c0 AS (SELECT p_partkey AS config, s.*, m.model, m.n_layers, m.backbone_params, 2 ** (p_size % 6) AS batch_size, p_size / 1000.0 AS dropout,
  p_size % 4 AS sch, p_size % 3 AS opt FROM part JOIN specs s ON s.spec_no = p_partkey % 17 JOIN models m ON m.model_no = p_size % 4), """
    + ENCODED
)
# the plain registry on one backbone
REGISTRY = SPEC_VALUES + ", c0 AS (SELECT name AS config, specs.*, 32 AS n_layers FROM specs), " + ENCODED


@query("e01_layer_ranges", "WITH " + CFG + " SELECT config, name, model, target_layers[1]::BIGINT AS first_layer, target_layers[-1]::BIGINT AS last_layer, len(target_layers)::BIGINT AS n FROM c1")
def e01(spark, sf):
    return instances(spark, sf).select(
        "config",
        "name",
        "model",
        F.element_at("target_layers", 1).cast("bigint").alias("first_layer"),
        F.element_at("target_layers", -1).cast("bigint").alias("last_layer"),
        F.size("target_layers").cast("bigint").alias("n"),
    )


@query("e02_registry_filter", "WITH " + CFG + " SELECT config, name FROM c1 WHERE grp = 'ood_family'")
def e02(spark, sf):
    return instances(spark, sf).where(F.col("group") == "ood_family").select("config", "name")


@query("e03_trainable_params", "WITH " + CFG + " SELECT config, n_params FROM c2")
def e03(spark, sf):
    return instances(spark, sf).select("config", C.trainable_params().alias("n_params"))


@query("e04_site_grid", "WITH " + CFG + " SELECT config, site::BIGINT AS site, layer::BIGINT AS layer, module FROM c3")
def e04(spark, sf):
    d = C.with_sites(instances(spark, sf)).select("config", F.posexplode("sites").alias("site", "s"))
    return d.select("config", F.col("site").cast("bigint").alias("site"), F.col("s.layer").cast("bigint").alias("layer"), "s.module")


@query("e05_operator_type", "WITH " + CFG + " SELECT config, op AS operator FROM c2")
def e05(spark, sf):
    return instances(spark, sf).select("config", C.operator_type().alias("operator"))


@query("e06_active_sites", "WITH " + CFG + " SELECT config, site::BIGINT AS site FROM c4 WHERE active")
def e06(spark, sf):
    d = C.with_site_weights(instances(spark, sf)).select("config", F.posexplode("active").alias("site", "a"))
    return d.where("a").select("config", F.col("site").cast("bigint").alias("site"))


@query("e07_site_weights", "WITH " + CFG + f" SELECT config, site::BIGINT AS site, {r('weight')} AS weight, {r('a')} AS alpha FROM weights")
def e07(spark, sf):
    d = C.with_site_weights(instances(spark, sf))
    d = d.select("config", F.posexplode(F.arrays_zip("site_weight", "site_alpha")).alias("site", "w"))
    return d.select(
        "config",
        F.col("site").cast("bigint").alias("site"),
        F.round("w.site_weight", 6).alias("weight"),
        F.round("w.site_alpha", 6).alias("alpha"),
    )


query("e08_normalised_weights", "WITH " + CFG + f" SELECT config, {r('sum(a)')} AS total, {r('max(a)')} AS largest FROM weights GROUP BY 1")(
    lambda spark, sf: C.with_site_weights(instances(spark, sf)).select(
        "config",
        F.round(V.total("site_alpha"), 6).alias("total"),
        F.round(F.array_max("site_alpha"), 6).alias("largest"),
    )
)


def _vector_rows(df, vec):
    d = df.select("config", F.posexplode(vec).alias("slot", "v"))
    return d.select("config", F.col("slot").cast("bigint").alias("slot"), F.round("v", 6).alias("v"))


MASK = "mask AS (SELECT config, site * 4 + f.k AS slot, CASE WHEN active AND (f.k = 0 OR (f.k = 1 AND op LIKE 'additive%') OR (f.k = 2 AND op = 'multiplicative') OR (f.k = 3 AND op = 'prefix')) THEN 1.0 ELSE 0.0 END::DOUBLE AS v FROM c4, range(0, 4) AS f(k))"
CAP = """cap AS (SELECT config, unnest(v) AS v, generate_subscripts(v, 1) - 1 AS slot FROM (SELECT config, [ln(1 + n_params), n_params / 1e6,
  coalesce(rank, 0) / 64, coalesce(alpha, 0) / 64, coalesce(bottleneck, 0) / 256, coalesce(prefix_len, 0) / 64, ln(1 + n_params),
  ln(1 + n_params * 4 / 1048576), (family IN ('prefix', 'ptuning'))::INT, (family = 'lora')::INT, (family = 'ia3')::INT, (family = 'adapter')::INT,
  (family IN ('prefix', 'ptuning'))::INT, (family = 'bitfit')::INT, len(target_layers) / 32, len(modules) / 8]::DOUBLE[] AS v FROM c2))"""
REC = """rec AS (SELECT config, unnest(v) AS v, generate_subscripts(v, 1) - 1 AS slot FROM (SELECT config, [log10(lr), 0.03, 0, (sch = 0)::INT, (sch = 1)::INT,
  (sch = 2)::INT, (sch = 3)::INT, (opt = 0)::INT, (opt = 1)::INT, (opt = 2)::INT, log2(batch_size), dropout, 3, 1, (opt = 0)::INT, (opt = 1)::INT]::DOUBLE[] AS v FROM c2))"""


@query("e09_site_indicators", "WITH " + CFG + ", " + MASK + " SELECT config, slot::BIGINT AS slot, v FROM mask")
def e09(spark, sf):
    return _vector_rows(C.with_site_weights(instances(spark, sf)).withColumn("m", C.site_indicators()), "m")


@query("e10_capacity_vector", "WITH " + CFG + ", " + CAP + f" SELECT config, slot::BIGINT AS slot, {r('v')} AS v FROM cap")
def e10(spark, sf):
    return _vector_rows(instances(spark, sf).withColumn("m", C.capacity_vector()), "m")


@query("e11_recipe_vector", "WITH " + CFG + ", " + REC + f" SELECT config, slot::BIGINT AS slot, {r('v')} AS v FROM rec")
def e11(spark, sf):
    return _vector_rows(instances(spark, sf).withColumn("m", C.recipe_vector()), "m")


@query(
    "e12_condition_vector",
    "WITH " + CFG + ", " + MASK + ", " + CAP + ", " + REC + f" SELECT config, slot::BIGINT AS slot, {r('v')} AS v FROM (SELECT * FROM mask UNION ALL BY NAME SELECT config, slot + 96 AS slot, v FROM cap UNION ALL BY NAME SELECT config, slot + 112 AS slot, v FROM rec)",
)
def e12(spark, sf):
    return _vector_rows(C.encode(instances(spark, sf)), "z_p")


@query(
    "e13_config_table",
    "WITH "
    + CFG
    + f""" SELECT DISTINCT config, name, family, model, array_to_string(modules, ',') AS inserted_into,
  CASE WHEN len(target_layers) = n_layers THEN 'all (' || n_layers || ')' WHEN layer_range = 'low' THEN 'low ⅓ (' || len(target_layers) || ')' ELSE 'high ⅓ (' || len(target_layers) || ')' END AS layers,
  CASE op WHEN 'additive_low_rank' THEN 'add. low-rank' WHEN 'additive_bottleneck' THEN 'add. bottleneck' WHEN 'bias_shift' THEN 'bias shift' ELSE op END AS operator,
  CASE WHEN family = 'lora' THEN 'r=' || rank WHEN family = 'adapter' THEN 'b=' || bottleneck WHEN family IN ('prefix', 'ptuning') THEN 'len=' || prefix_len ELSE '—' END AS capacity,
  n_params AS n_trainable, {r('100.0 * n_params / backbone_params')} AS pct_backbone, n_active || '/24' AS touched_sites, grp AS "group" FROM c5""",
)
def e13(spark, sf):
    return C.summary(instances(spark, sf)).withColumn("pct_backbone", F.round("pct_backbone", 6))


def _present(spark, sf):
    """Registry rows that occur in the data, with their counts."""
    return instances(spark, sf).groupBy("name", "family", "modules_key", "layer_range").agg(F.count(F.lit(1)).alias("n"))


@query(
    "e14_structural_buckets",
    "WITH "
    + CFG
    + """, pr AS (SELECT name, family, modules_key, layer_range, count(*) AS n FROM c0 GROUP BY ALL)
SELECT a.name AS left_name, b.name AS right_name, a.n * b.n AS n_pairs, CASE WHEN a.family <> b.family THEN 'cross-family'
  WHEN a.modules_key = b.modules_key AND a.layer_range = b.layer_range THEN 'same-fam-capacity' ELSE 'same-fam-placement' END AS bucket
FROM pr a JOIN pr b ON a.name < b.name""",
)
def e14(spark, sf):
    p = C.pairs(_present(spark, sf))
    return p.select(
        F.col("a.name").alias("left_name"),
        F.col("b.name").alias("right_name"),
        (F.col("a.n") * F.col("b.n")).alias("n_pairs"),
        C.structural_bucket().alias("bucket"),
    )


NAME_FEATURES = """CASE WHEN name LIKE '%low%' THEN 'low' WHEN name LIKE '%high%' THEN 'high' ELSE 'all' END AS place,
  CASE WHEN name LIKE '%all%' THEN 'all' WHEN name LIKE '%qkvo%' THEN 'qkvo' ELSE 'qv' END AS mods,
  log2(greatest(coalesce(nullif(regexp_extract(name, 'r(\\d+)', 1), '')::DOUBLE, 0), 1)) AS lr2"""


@query(
    "e15_name_distance",
    "WITH "
    + CFG
    + f""", nf AS (SELECT DISTINCT name, {NAME_FEATURES} FROM c0)
SELECT a.name AS left_name, b.name AS right_name, {r('abs(a.lr2 - b.lr2) + (a.place <> b.place)::INT + (a.mods <> b.mods)::INT')} AS distance FROM nf a JOIN nf b ON a.name < b.name""",
)
def e15(spark, sf):
    p = C.pairs(_present(spark, sf).select("name"))
    return p.select(
        F.col("a.name").alias("left_name"),
        F.col("b.name").alias("right_name"),
        F.round(C.name_distance(F.col("a.name"), F.col("b.name")), 6).alias("distance"),
    )


# fixed values: tiers of configurations, as above
TIER_SQL = """CASE WHEN name IN ('L-r32-qkvo', 'AD-b16') THEN 'L0' WHEN name IN ('L-r64-all', 'AD-b256', 'L-r8-highlayers') THEN 'L1'
  WHEN name IN ('PRE-l16', 'PT-l32', 'BF') THEN 'L2' ELSE '?' END"""


@query("e16_support_tier", "WITH " + CFG + f" SELECT config, {TIER_SQL} AS tier FROM c0")
def e16(spark, sf):
    return instances(spark, sf).select("config", C.tier(F.col("name"), R.TIERS).alias("tier"))


@query(
    "e17_recommended_action",
    "WITH " + CFG + f""", t AS (SELECT config, {TIER_SQL} AS tier, config IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') AS has_labels FROM c0)
SELECT config, CASE WHEN tier = 'L0' THEN 'zero-shot' WHEN tier = 'L1' OR (tier = 'L2' AND has_labels) THEN 'calibrate' WHEN tier = 'L2' THEN 'per-target selector' ELSE 'in support' END AS action FROM t""",
)
def e17(spark, sf):
    labelled = X.table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("config")).distinct()
    d = instances(spark, sf).join(labelled.withColumn("has_labels", F.lit(True)), "config", "left")
    t = C.tier(F.col("name"), R.TIERS)
    return d.select("config", C.action(t, F.coalesce("has_labels", F.lit(False))).alias("action"))


@query(
    "a12_config_ids",
    "WITH "
    + CFG
    + """ SELECT config, substr(sha256(concat_ws(chr(31), family, array_to_string(modules, ','), array_to_string(target_layers, ','), coalesce(rank::VARCHAR, ''), coalesce(alpha::VARCHAR, ''),
  coalesce(bottleneck::VARCHAR, ''), coalesce(prefix_len::VARCHAR, ''), round(lr * 1e6)::BIGINT::VARCHAR)), 1, 16) AS peft_id FROM c1""",
)
def a12(spark, sf):
    return instances(spark, sf).select("config", C.config_id().alias("peft_id"))
