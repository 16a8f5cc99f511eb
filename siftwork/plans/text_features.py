"""Feature queries: text statistics, tokens, embeddings, vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwork.functions import text as TX
from siftwork.functions import vectors as V
from siftwork.operators import selectors as S
from siftwork.operators import tokens as K
from siftwork.operators.common import attach, resolve_budget
from siftwork.plans import sqltext as T
from siftwork.plans import views as X
from siftwork.plans.catalog import query
from siftwork.session import cut_lineage, stored

r = T.r

STATS = """st AS (SELECT sample_id, ln(1 + length(instruction)) AS len_instr, ln(1 + length(response)) AS len_resp, ln(1 + length(instruction) + length(response)) AS len_total,
  length(response) / greatest(length(instruction), 1) AS ratio,
  (contains(lower(response), 'step') OR contains(lower(response), 'let''s think'))::INT::DOUBLE AS has_steps,
  (contains(response, '```') OR contains(response, 'def '))::INT::DOUBLE AS has_code,
  contains(instruction, '?')::INT::DOUBLE AS has_question,
  (NOT regexp_matches((instruction || ' ' || response), '[\\x{4e00}-\\x{9fff}]') AND regexp_full_match((instruction || ' ' || response), '(?s)[\\x00-\\x7F]*'))::INT::DOUBLE AS lang_en,
  regexp_matches((instruction || ' ' || response), '[\\x{4e00}-\\x{9fff}]')::INT::DOUBLE AS lang_zh FROM pool_text)"""
NAMES = "len_instr len_resp len_total ratio has_steps has_code has_question lang_en lang_zh".split()


def stats(spark, sf):
    return X.pool_text(spark, sf).select("sample_id", *[c.alias(n) for n, c in TX.text_stats().items()])


def _register_stats(name, cols):
    sel = ", ".join(f"{r(c)} AS {c}" for c in cols)
    query(name, "WITH " + T.POOL_TEXT + ", " + STATS + f" SELECT sample_id, {sel} FROM st")(
        lambda spark, sf: stats(spark, sf).select("sample_id", *[F.round(c, 6).alias(c) for c in cols])
    )


_register_stats("c01_lengths", NAMES[:3])
_register_stats("c02_length_ratio", NAMES[3:4])
_register_stats("c03_steps_flag", NAMES[4:5])
_register_stats("c04_code_flag", NAMES[5:6])
_register_stats("c05_question_flag", NAMES[6:7])
_register_stats("c06_language_flags", NAMES[7:])

WORDS = "list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
TOKENS = (
    T.POOL_TEXT
    + f""", tk0 AS (SELECT sample_id, list_concat(['<s>'], {WORDS.format('instruction')}) AS i, list_concat({WORDS.format('response')}, ['</s>']) AS r FROM pool_text),
tk1 AS (SELECT sample_id, r, CASE WHEN len(r) >= 256 THEN [] ELSE list_slice(i, greatest(len(i) - (256 - len(r)) + 1, 1), len(i)) END AS k FROM tk0),
tk AS (SELECT sample_id, CASE WHEN len(r) >= 256 THEN list_slice(r, 1, 256) ELSE list_concat(k, r) END AS tokens, CASE WHEN len(r) >= 256 THEN 0 ELSE len(k) END AS n_instr FROM tk1)"""
)
WHOLE = (
    T.POOL_TEXT
    + f""", tk0 AS (SELECT sample_id, list_concat(['<s>'], {WORDS.format('instruction')}) AS i, list_concat({WORDS.format('response')}, ['</s>']) AS r FROM pool_text),
tk AS (SELECT sample_id, list_concat(i, r) AS tokens, len(i) AS n_instr FROM tk0)"""
)
BIGRAMS = WHOLE + """, bg AS (SELECT sample_id, tokens[j] AS prev, tokens[j + 1] AS nxt, (j + 1 > n_instr)::INT AS sup FROM (SELECT *, unnest(range(1, len(tokens))) AS j FROM tk)),
pc AS (SELECT prev, nxt, count(*) AS c FROM bg GROUP BY ALL), voc AS (SELECT count(*)::DOUBLE AS v FROM (SELECT prev FROM pc UNION SELECT nxt FROM pc)),
cx AS (SELECT prev, sum(c)::DOUBLE AS total, count(*) AS seen FROM pc GROUP BY 1),
pr AS (SELECT prev, nxt, (c + 0.5) / (total + 0.5 * v) AS p, total, seen, v FROM pc JOIN cx USING (prev), voc),
en AS (SELECT prev, -sum(p * ln(p)) - (any_value(v) - any_value(seen)) * (0.5 / (any_value(total) + 0.5 * any_value(v))) * ln(0.5 / (any_value(total) + 0.5 * any_value(v))) AS h FROM pr GROUP BY 1),
tok AS (SELECT bg.*, ln(p)::DOUBLE AS lp, h, max(sup) OVER (PARTITION BY sample_id) AS any_sup FROM bg JOIN pr USING (prev, nxt) JOIN en USING (prev)),
ms AS (SELECT sample_id, avg(-lp) AS loss_mean, stddev_pop(lp) AS loss_std, max(-lp) AS loss_max, exp(least(avg(-lp), 20)) AS ppl, avg(lp) AS avg_logprob, avg(h) AS entropy_mean, max(h) AS entropy_max
  FROM tok WHERE sup = 1 OR any_sup = 0 GROUP BY 1)"""


def tokenised(spark, sf, max_len=None):
    """Tokens of whole texts; only the token budget query itself sets a limit."""
    p = X.pool_text(spark, sf)
    return K.with_token_budget(p.select("sample_id", "instruction", "response"), TX.words("instruction"), TX.words("response"), max_len).select(
        "sample_id", "tokens", "mask"
    )


def model_stats(spark, sf):
    return cut_lineage(K.token_stats(tokenised(spark, sf)))


@query("c10_token_budget", "WITH " + TOKENS + " SELECT sample_id, len(tokens)::BIGINT AS n_tokens, (len(tokens) - n_instr)::BIGINT AS n_supervised, md5(array_to_string(tokens, ' ')) AS digest FROM tk")
def c10(spark, sf):
    return tokenised(spark, sf, 256).select(
        "sample_id",
        F.size("tokens").cast("bigint").alias("n_tokens"),
        F.size(F.filter("mask", lambda m: m == 1)).cast("bigint").alias("n_supervised"),
        F.md5(F.array_join("tokens", " ")).alias("digest"),
    )


@query("c11_bigram_logprobs", "WITH " + BIGRAMS + f" SELECT prev, nxt AS next, {r('ln(p)')} AS lp, {r('h')} AS entropy FROM pr JOIN en USING (prev)")
def c11(spark, sf):
    model, _ = K.bigram_model(stored(K.bigram_counts(tokenised(spark, sf)), "bigrams"))
    return model.select("prev", "next", F.round("lp", 6).alias("lp"), F.round("entropy", 6).alias("entropy"))


@query("c12_response_loss", "WITH " + BIGRAMS + f" SELECT p.sample_id, {r('coalesce(loss_mean, 0)')} AS loss FROM pool_text p LEFT JOIN ms USING (sample_id)")
def c12(spark, sf):
    p = X.pool_text(spark, sf).select("sample_id")
    return K.with_model_stats(p, model_stats(spark, sf)).select("sample_id", F.round("loss_mean", 6).alias("loss"))


@query("c13_model_stats", "WITH " + BIGRAMS + " SELECT sample_id, " + ", ".join(f"{r(c, 5)} AS {c}" for c in K.MODEL_STATS) + " FROM ms")
def c13(spark, sf):
    return model_stats(spark, sf).select("sample_id", *[F.round(c, 5).alias(c) for c in K.MODEL_STATS])


def difficulty(spark, sf):
    return K.with_model_stats(stats(spark, sf), model_stats(spark, sf)).select("sample_id", TX.difficulty_vector().alias("d_x"))


SLOTS = ", ".join(f"coalesce({s}, 0)" for s in TX.DIFFICULTY_SLOTS)


DIFFICULTY = "WITH " + BIGRAMS + ", " + STATS + f" SELECT sample_id, {r('d[i]', 5)} AS v, (i - 1)::BIGINT AS slot FROM (SELECT st.sample_id, [{SLOTS}]::DOUBLE[] AS d FROM st LEFT JOIN ms USING (sample_id)), range(1, 17) AS x(i)"


@query("c07_difficulty_vector", DIFFICULTY)
def c07(spark, sf):
    d = difficulty(spark, sf).select("sample_id", F.posexplode("d_x").alias("slot", "v"))
    return d.select("sample_id", F.col("slot").cast("bigint").alias("slot"), F.round("v", 5).alias("v"))


@query("c19_named_slots", "WITH " + BIGRAMS + ", " + STATS + f" SELECT st.sample_id, {r('len_total', 5)} AS length, {r('coalesce(loss_mean, 0)', 5)} AS loss, {r('coalesce(loss_std, 0)', 5)} AS loss_std, {r('coalesce(ppl, 0)', 5)} AS ppl, {r('coalesce(avg_logprob, 0)', 5)} AS avg_logprob FROM st LEFT JOIN ms USING (sample_id)")
def c19(spark, sf):
    at = {"length": 2, "loss": 4, "loss_std": 5, "ppl": 7, "avg_logprob": 8}
    return difficulty(spark, sf).select("sample_id", *[F.round(F.get("d_x", i), 5).alias(n) for n, i in at.items()])


for _n, _c in (("k04_loss", "loss_mean"), ("k05_perplexity", "ppl")):
    query(
        _n,
        "WITH " + BIGRAMS + f", pc2 AS (SELECT p.sample_id, round(coalesce({_c}, 0), 5) AS score FROM pool_text p LEFT JOIN ms USING (sample_id)) SELECT sample_id, {r('score', 5)} AS score FROM pc2 ORDER BY pc2.score DESC, sample_id LIMIT (SELECT greatest(1, round_even(0.1 * count(*), 0))::BIGINT FROM pc2)",
    )(
        lambda spark, sf, n=_n, c=_c: S.select(
            n[4:],
            {"pool": K.with_model_stats(X.pool_text(spark, sf).select("sample_id"), model_stats(spark, sf)).withColumn(c, F.round(c, 5))},
            resolve_budget(X.pool_text(spark, sf), 0.10),
        ).select("sample_id", "score")
    )


@query("c09_text_embedding")
def c09(spark, sf):
    """TF-IDF text vectors, L2-normalised; reports counts and norms per language."""
    from siftwork.operators.embeddings import hashed_tfidf

    e = hashed_tfidf(X.pool_text(spark, sf).select("sample_id", "language", F.concat_ws("\n", "instruction", "response").alias("text")), "text", 512)
    norm = V.norm(F.col("embedding"))
    return e.groupBy("language").agg(F.count(F.lit(1)).alias("n"), F.round(F.max(norm), 6).alias("norm"))


@query("c09_given_embedding", "WITH " + T.POOL + f" SELECT sample_id, {r('sqrt(list_dot_product(joint, joint))')} AS norm, {r('joint[1]')} AS head FROM pool")
def c09_given(spark, sf):
    p = X.pool_vectors(spark, sf).withColumn("joint", V.doubles("joint"))
    return p.select("sample_id", F.round(V.norm("joint"), 6).alias("norm"), F.round(F.col("joint")[0], 6).alias("head"))


# token vectors: eight tokens of eight dimensions per embedding, two layers
TOKVEC = T.POOL + """, tv AS (SELECT sample_id, l AS layer, p AS pos, (p >= 3 AND cluster_id <> 0)::INT AS mask, list_slice(joint, 8 * p + 1, 8 * p + 8) AS attn,
  list_slice(joint, 8 * ((p + l) % 8) + 1, 8 * ((p + l) % 8) + 8) AS mlp FROM pool, range(0, 8) AS a(p), (VALUES (3), (7)) AS b(l)),
tw AS (SELECT *, list_transform(list_zip(attn, mlp), lambda z: z[1] + z[2]) AS resid, max(mask) OVER (PARTITION BY sample_id, layer) AS any_on FROM tv)"""


def token_vectors(spark, sf):
    p = X.pool_vectors(spark, sf)
    d = p.select("sample_id", "cluster_id", "joint", F.explode(F.array(F.lit(3), F.lit(7))).alias("layer"))
    d = d.select("*", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("pos"))
    d = d.select(
        "sample_id",
        "layer",
        "pos",
        F.when((F.col("pos") >= 3) & (F.col("cluster_id") != 0), 1).otherwise(0).alias("mask"),
        F.slice("joint", F.col("pos") * 8 + 1, 8).alias("attn"),
        F.slice("joint", ((F.col("pos") + F.col("layer")) % 8) * 8 + 1, 8).alias("mlp"),
    )
    return d.withColumn("resid", F.zip_with("attn", "mlp", lambda x, y: x + y))


LAYER_STATS = (
    "WITH "
    + TOKVEC
    + f""", t1 AS (SELECT *, sqrt(list_dot_product(attn, attn)) AS na, list_transform([0, 1, 2, 3], lambda b: sqrt(attn[2 * b + 1] ** 2 + attn[2 * b + 2] ** 2)) AS bn FROM tw WHERE mask = 1 OR any_on = 0),
t2 AS (SELECT *, sum(na) OVER (PARTITION BY sample_id, layer) AS tn FROM t1),
mv AS (SELECT sample_id, layer, avg(v) AS token_var FROM (SELECT sample_id, layer, i, var_pop(resid[i]) AS v FROM t1, range(1, 9) AS d(i) GROUP BY ALL) GROUP BY ALL),
fl AS (SELECT sample_id, layer, min_by(resid, pos) AS f, max_by(resid, pos) AS l FROM tw GROUP BY ALL),
ag AS (SELECT sample_id, layer, avg(na) AS norm_attn, avg(sqrt(list_dot_product(mlp, mlp))) AS norm_mlp, avg(sqrt(list_dot_product(resid, resid))) AS norm_resid,
  -sum(na / greatest(tn, 1e-8) * ln(na / greatest(tn, 1e-8) + 1e-12)) AS attn_entropy, avg(list_var_pop(bn)) AS head_norm_var, avg(list_avg(list_transform(mlp, lambda x: abs(x)))) AS mlp_mean_abs FROM t2 GROUP BY ALL)
SELECT ag.sample_id, ag.layer::BIGINT AS layer, {r('norm_attn')} AS norm_attn, {r('norm_mlp')} AS norm_mlp, {r('norm_resid')} AS norm_resid, {r('attn_entropy')} AS attn_entropy, {r('head_norm_var')} AS head_norm_var,
  {r('mlp_mean_abs')} AS mlp_mean_abs, {r('token_var')} AS token_var, {r('list_dot_product(f, l) / greatest(sqrt(list_dot_product(f, f)) * sqrt(list_dot_product(l, l)), 1e-8)')} AS first_last
FROM ag JOIN mv USING (sample_id, layer) JOIN fl USING (sample_id, layer)"""
)


@query("c14_layer_stats", LAYER_STATS)
def c14(spark, sf):
    s = K.layer_stats(token_vectors(spark, sf), ["sample_id", "layer"], head_blocks=4)
    cols = [c for c in s.columns if c not in ("sample_id", "layer")]
    return s.select("sample_id", F.col("layer").cast("bigint").alias("layer"), *[F.round(c, 6).alias(c) for c in cols])


LAYERS = (3, 7)


@query(
    "c08_feature_vector",
    f"""SELECT sample_id, (64 + 16 + 8 * {len(LAYERS)})::BIGINT AS width, round(j + d + a, 5) + 0.0::DOUBLE AS total, round(d, 5) + 0.0::DOUBLE AS difficulty, round(a, 6) + 0.0::DOUBLE AS layers
FROM (WITH {T.POOL} SELECT sample_id, list_sum(joint) AS j FROM pool) JOIN (SELECT sample_id, sum(v) AS d FROM ({DIFFICULTY}) GROUP BY 1) USING (sample_id)
JOIN (SELECT sample_id, sum(norm_attn + norm_mlp + norm_resid + attn_entropy + head_norm_var + mlp_mean_abs + token_var + first_last) AS a FROM ({LAYER_STATS}) GROUP BY 1) USING (sample_id)""",
)
def c08(spark, sf):
    """z_x: the joint vector, the 16 difficulty slots, and eight statistics of every layer."""
    s = c14(spark, sf)
    names = [c for c in s.columns if c not in ("sample_id", "layer")]
    a = s.groupBy("sample_id").agg(F.sort_array(F.collect_list(F.struct("layer", F.array(*names).alias("v")))).alias("r"))
    a = a.select("sample_id", F.flatten(F.transform("r", lambda x: x.v)).alias("a_x"))
    d = difficulty(spark, sf).select("sample_id", F.transform("d_x", lambda x: F.round(x, 5)).alias("d_x"))
    z = X.pool_vectors(spark, sf).join(d, "sample_id").join(a, "sample_id").withColumn("z", F.concat("joint", "d_x", "a_x"))
    total = [F.round(V.total(c), n).alias(name) for c, n, name in (("z", 5, "total"), ("d_x", 5, "difficulty"), ("a_x", 6, "layers"))]
    return z.select("sample_id", F.size("z").cast("bigint").alias("width"), *total)


@query("c15_masked_pooling", "WITH " + TOKVEC + f" SELECT sample_id, layer::BIGINT AS layer, (i - 1)::BIGINT AS slot, {r('avg(attn[i])')} AS v FROM tw, range(1, 9) AS d(i) WHERE mask = 1 OR any_on = 0 GROUP BY ALL")
def c15(spark, sf):
    m = K.pool_mean(token_vectors(spark, sf), ["sample_id", "layer"], "attn").select("sample_id", "layer", F.posexplode("pooled").alias("slot", "v"))
    return m.select("sample_id", F.col("layer").cast("bigint").alias("layer"), F.col("slot").cast("bigint").alias("slot"), F.round("v", 6).alias("v"))


@query(
    "c24_other_pooling",
    "WITH " + TOKVEC + f""" SELECT sample_id, layer::BIGINT AS layer, 'last' AS kind, {r('max_by(attn[1], pos)')} AS head FROM tw GROUP BY ALL
UNION ALL SELECT sample_id, layer::BIGINT, 'weighted', {r('sum(attn[1] * (pos + 1)) / sum(pos + 1)')} FROM tw GROUP BY ALL""",
)
def c24(spark, sf):
    t = token_vectors(spark, sf).withColumn("layer", F.col("layer").cast("bigint"))
    by = ["sample_id", "layer"]
    last = K.pool_last(t, by, "attn").select(*by, F.lit("last").alias("kind"), F.round(F.col("pooled")[0], 6).alias("head"))
    w = K.pool_weighted(t.withColumn("w", F.col("pos") + 1), by, "w", "attn")
    return last.unionByName(w.select(*by, F.lit("weighted").alias("kind"), F.round(F.col("pooled")[0], 6).alias("head")))


@query(
    "c17_standardise",
    "WITH " + T.POOL + f""", s AS (SELECT i, avg(joint[i]) AS m, stddev_pop(joint[i]) AS s FROM pool, range(1, 65) AS d(i) GROUP BY i)
SELECT sample_id, {r('sum((joint[i] - m) / (s + 1e-6))', 5)} AS total, {r('max((joint[i] - m) / (s + 1e-6))', 5)} AS largest FROM pool, s GROUP BY 1""",
)
def c17(spark, sf):
    p = X.pool_vectors(spark, sf)
    d = attach(p, V.vector_stats(p, "joint").select("mean", "sd")).withColumn("z", V.standardize("joint", "mean", "sd"))
    return d.select("sample_id", F.round(V.total("z"), 5).alias("total"), F.round(F.array_max("z"), 5).alias("largest"))


@query("c18_cosine_to_label_mean", "WITH " + T.POOL + f", m AS (SELECT cluster_id, list(v ORDER BY i) AS c FROM (SELECT cluster_id, i, avg(joint[i]) AS v FROM pool, range(1, 65) AS d(i) GROUP BY ALL) GROUP BY 1) SELECT sample_id, {r('list_dot_product(joint, c) / ((sqrt(list_dot_product(joint, joint)) + 1e-8) * (sqrt(list_dot_product(c, c)) + 1e-8))')} AS cosine FROM pool JOIN m USING (cluster_id)")
def c18(spark, sf):
    p = X.pool_vectors(spark, sf)
    m = V.vector_mean(p, "joint", ["cluster_id"], "c")
    V.register_vector_functions(spark)
    d = p.join(m, "cluster_id")
    cos = F.expr("vec_dot(joint, c) / ((vec_norm(joint) + 1e-8D) * (vec_norm(c) + 1e-8D))")
    return d.select("sample_id", F.round(cos, 6).alias("cosine"))


@query("c20_predicates", "WITH " + T.RESULTS + " SELECT run_no FROM results WHERE method IN ('click', 'view') AND task = 1 AND starts_with(method, 'c') AND abs(budget - 0.1) <= 1e-8 + 1e-5 * 0.1")
def c20(spark, sf):
    from siftwork.operators.reports import near

    d = X.results(spark, sf)
    return d.where(F.col("method").isin("click", "view") & (F.col("task") == 1) & F.col("method").startswith("c") & near("budget", 0.1)).select("run_no")


@query("c21_string_scalars", "WITH " + T.RESULTS + """, m AS (SELECT run_no, 'sel_alpha=' || budget::DECIMAL(4,2) || '_r' || seed AS tag FROM results)
SELECT run_no, regexp_extract(tag, 'alpha=([0-9.]+)', 1)::DOUBLE AS alpha, regexp_extract(tag, 'r(\\d+)', 1) AS rank, regexp_replace(tag, '^sel_', '') AS bare FROM m""")
def c21(spark, sf):
    tag = F.concat(F.lit("sel_alpha="), F.col("budget").cast("decimal(4,2)").cast("string"), F.lit("_r"), F.col("seed").cast("string"))
    d = X.results(spark, sf).select("run_no", tag.alias("tag"))
    return d.select(
        "run_no",
        F.regexp_extract("tag", r"alpha=([0-9.]+)", 1).cast("double").alias("alpha"),
        F.regexp_extract("tag", r"r(\d+)", 1).alias("rank"),
        F.regexp_replace("tag", "^sel_", "").alias("bare"),
    )


@query("c22_math_scalars", f"SELECT event_id, {r('ln(1 + value)')} AS log1p, {r('tanh(value)')} AS tanh, {r('ln(1 + exp(least(value, 30)))')} AS softplus, round_even(value, 0) AS even, {r('log2(greatest(value, 1))')} AS l2, sign(value - 10)::DOUBLE AS sgn, {r('sqrt(value)')} AS root FROM events")
def c22(spark, sf):
    v = F.col("value")
    return X.table(spark, sf, "events").select(
        "event_id",
        F.round(F.log1p(v), 6).alias("log1p"),
        F.round(F.tanh(v), 6).alias("tanh"),
        F.round(F.log1p(F.exp(F.least(v, F.lit(30.0)))), 6).alias("softplus"),
        F.bround(v).alias("even"),
        F.round(F.log2(F.greatest(v, F.lit(1.0))), 6).alias("l2"),
        F.signum(v - 10).alias("sgn"),
        F.round(F.sqrt(v), 6).alias("root"),
    )


@query("c23_source_one_hot", "WITH " + T.POOL_TEXT + ", s AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS slot, count(*) OVER () AS width FROM (SELECT DISTINCT source FROM pool_text)) SELECT sample_id, slot::BIGINT AS slot, width::BIGINT AS width FROM pool_text JOIN s USING (source)")
def c23(spark, sf):
    from siftwork.operators.embeddings import one_hot

    d = one_hot(X.pool_text(spark, sf).select("sample_id", "source"), "source")
    return d.select("sample_id", (F.array_position("source_onehot", 1.0) - 1).alias("slot"), F.size("source_onehot").cast("bigint").alias("width"))
