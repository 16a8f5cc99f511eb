"""Pool preparation queries: dedup, decontamination, backfill, provenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwork.functions import text as TX
from siftwork.operators import dedup as D
from siftwork.operators import neighbours as N
from siftwork.plans import sqltext as T
from siftwork.plans import views as X
from siftwork.plans.catalog import query

r = T.r
HASH = "sha256(instruction || chr(31) || response || chr(31) || coalesce(source, ''))"
NORM = "regexp_replace(lower(instruction || ' ' || response), '[^\\p{L}\\p{N}]+', '', 'g')"


@query("b01_exact_dedup", "WITH " + T.POOL_TEXT + f" SELECT min(sample_id) AS sample_id FROM pool_text GROUP BY {HASH}")
def b01(spark, sf):
    p = X.pool_text(spark, sf)
    key = F.sha2(F.concat_ws("\u001f", "instruction", "response", F.coalesce("source", F.lit(""))), 256)
    return D.drop_equal(p, key).select("sample_id")


@query("b02_normalised_dedup", "WITH " + T.POOL_TEXT + f" SELECT min(sample_id) AS sample_id FROM pool_text GROUP BY {NORM}")
def b02(spark, sf):
    p = X.pool_text(spark, sf)
    return D.drop_equal(p, F.md5(TX.normal_form(F.concat_ws(" ", "instruction", "response")))).select("sample_id")


def grams_cte(name, source, id_col, text, n):
    return f"""{name}_w AS (
  SELECT {id_col}, list_filter(regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') AS w FROM {source}),
{name} AS (
  SELECT {id_col}, list_distinct(list_transform(range(1, greatest(len(w) - {n}, 0) + 2), lambda i: array_to_string(list_slice(w, i, i + {n - 1}), ' '))) AS grams
  FROM {name}_w WHERE len(w) > 0)"""


def near_cte(sets, out):
    """Rows that are not the first of their component of links of exact Jaccard >= 0.8 (needs WITH RECURSIVE)."""
    return f"""{out}_g AS (SELECT sample_id, len(grams) AS n, unnest(grams) AS g FROM {sets}),
{out}_p AS (SELECT a.sample_id AS y, b.sample_id AS x, any_value(a.n) AS ny, any_value(b.n) AS nx, count(*) AS inter
  FROM {out}_g a JOIN {out}_g b ON a.g = b.g AND b.sample_id <> a.sample_id GROUP BY 1, 2),
{out}_l AS (SELECT y, x FROM {out}_p WHERE inter::DOUBLE / (ny + nx - inter) >= 0.8),
{out}_r AS (SELECT DISTINCT y AS a, y AS b FROM {out}_l UNION SELECT r.a, l.x FROM {out}_r r JOIN {out}_l l ON l.y = r.b),
{out}_c AS (SELECT a AS sample_id, min(b) AS component FROM {out}_r GROUP BY 1),
{out} AS (SELECT sample_id FROM {out}_c WHERE component <> sample_id)"""


@query(
    "b03_near_duplicates",
    "WITH RECURSIVE " + grams_cte("sets", "(SELECT doc_id AS sample_id, text FROM documents)", "sample_id", "text", 5) + ", " + near_cte("sets", "near") + " SELECT sample_id FROM near",
)
def b03(spark, sf):
    docs = X.table(spark, sf, "documents").select(F.col("doc_id").alias("sample_id"), "text")
    return D.near_duplicates(docs, "text")


@query(
    "b03_near_components",
    "WITH RECURSIVE "
    + grams_cte("sets", "(SELECT doc_id AS sample_id, text FROM documents)", "sample_id", "text", 5)
    + ", "
    + near_cte("sets", "near")
    + " SELECT s.sample_id, coalesce(c.component, s.sample_id) AS component FROM sets s LEFT JOIN near_c c ON c.sample_id = s.sample_id",
)
def b03_components(spark, sf):
    return D.near_components(_docs(spark, sf), "text")


@query(
    "b04_dedup_statistics",
    "WITH RECURSIVE "
    + T.POOL_TEXT
    + f""", s0 AS (SELECT sample_id, {HASH} AS h, {NORM} AS nf, instruction || ' ' || response AS text FROM pool_text),
s1 AS (SELECT * FROM s0 QUALIFY row_number() OVER (PARTITION BY h ORDER BY sample_id) = 1),
s2 AS (SELECT * FROM s1 QUALIFY row_number() OVER (PARTITION BY nf ORDER BY sample_id) = 1), """
    + grams_cte("sets", "s2", "sample_id", "text", 5)
    + ", "
    + near_cte("sets", "near")
    + """ SELECT 'exact' AS stage, ((SELECT count(*) FROM s0) - (SELECT count(*) FROM s1))::BIGINT AS n_rows
UNION ALL SELECT 'normalised', (SELECT count(*) FROM s1) - (SELECT count(*) FROM s2)
UNION ALL SELECT 'near', (SELECT count(*) FROM near)
UNION ALL SELECT 'kept', (SELECT count(*) FROM s2) - (SELECT count(*) FROM near)""",
)
def b04(spark, sf):
    return D.dedup_stages(X.pool_text(spark, sf)).groupBy("stage").agg(F.count(F.lit(1)).alias("n_rows"))


def _docs(spark, sf):
    return X.table(spark, sf, "documents").select(F.col("doc_id").alias("sample_id"), "text")


# windows of as many lines as some item has, so that an item is found wherever its lines lie
WINDOWS = """item_lines AS (SELECT DISTINCT len(string_split(text, chr(10)))::BIGINT AS n_lines FROM benchmark),
windows AS (SELECT doc_id AS sample_id, first_line::BIGINT AS first_line, n_lines, array_to_string(list_slice(ls, first_line, first_line + n_lines - 1), chr(10)) AS line
  FROM (SELECT doc_id, ls, n_lines, unnest(range(1, len(ls) - n_lines + 2)) AS first_line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), item_lines))"""


@query(
    "b05_exact_decontamination",
    "WITH " + WINDOWS + """, parts AS (SELECT sample_id, line FROM windows),
hit AS (SELECT DISTINCT sample_id, 'exact' AS kind FROM parts WHERE line IN (SELECT text FROM benchmark)
  UNION ALL SELECT DISTINCT sample_id, 'normalised' FROM parts WHERE regexp_replace(lower(line), '[^\\p{L}\\p{N}]+', '', 'g') IN
    (SELECT regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', '', 'g') FROM benchmark))
SELECT sample_id, kind FROM hit""",
)
def b05(spark, sf):
    items = X.table(spark, sf, "benchmark")
    windows = D.line_windows(_docs(spark, sf), items)
    return D.matching_items(windows, items).distinct()


@query(
    "b06_gram_overlap",
    "WITH "
    + grams_cte("dg", "(SELECT doc_id AS sample_id, text FROM documents)", "sample_id", "text", 13)
    + ", "
    + grams_cte("ig", "benchmark", "item_id", "text", 13)
    + """, d AS (SELECT sample_id, len(grams) AS nd, unnest(grams) AS g FROM dg), i AS (SELECT item_id, len(grams) AS ni, unnest(grams) AS g FROM ig),
h AS (SELECT sample_id, item_id, nd, ni, count(*) AS c FROM d JOIN i USING (g) GROUP BY ALL)
SELECT sample_id, item_id, round(c::DOUBLE / (nd + ni - c), 6) AS jaccard FROM h WHERE c::DOUBLE / (nd + ni - c) >= 0.05""",
)
def b06(spark, sf):
    # 0.05 here also shows passages inside long rows; removal uses the default 0.5
    hits = D.gram_overlap(_docs(spark, sf), X.table(spark, sf, "benchmark"), threshold=0.05)
    return hits.select("sample_id", "item_id", F.round("jaccard", 6).alias("jaccard"))


@query(
    "b06_gram_decontaminated_pool",
    "WITH "
    + grams_cte("dg", "(SELECT doc_id AS sample_id, text FROM documents)", "sample_id", "text", 13)
    + ", "
    + grams_cte("ig", "benchmark", "item_id", "text", 13)
    + """, d AS (SELECT sample_id, len(grams) AS nd, unnest(grams) AS g FROM dg), i AS (SELECT item_id, len(grams) AS ni, unnest(grams) AS g FROM ig),
h AS (SELECT sample_id, item_id, nd, ni, count(*) AS c FROM d JOIN i USING (g) GROUP BY ALL)
SELECT doc_id AS sample_id FROM documents WHERE doc_id NOT IN (SELECT sample_id FROM h WHERE c::DOUBLE / (nd + ni - c) >= 0.5)""",
)
def b06_pool(spark, sf):
    docs = _docs(spark, sf)
    return docs.select("sample_id").join(D.gram_overlap(docs, X.table(spark, sf, "benchmark")), "sample_id", "left_anti")


@query(
    "b07_near_benchmark_rows",
    "WITH "
    + WINDOWS
    + ", "
    + grams_cte("dg", "(SELECT {'sample_id': sample_id, 'first_line': first_line, 'n_lines': n_lines} AS spot, line FROM windows)", "spot", "line", 5)
    + ", "
    + grams_cte("ig", "benchmark", "item_id", "text", 5)
    + """, d AS (SELECT spot, len(grams) AS nd, unnest(grams) AS g FROM dg), i AS (SELECT item_id, len(grams) AS ni, unnest(grams) AS g FROM ig),
h AS (SELECT spot, item_id, nd, ni, count(*) AS c FROM d JOIN i USING (g) GROUP BY ALL)
SELECT spot.sample_id AS sample_id, spot.first_line AS first_line, spot.n_lines AS n_lines, item_id FROM h WHERE c::DOUBLE / (nd + ni - c) >= 0.8""",
)
def b07(spark, sf):
    return D.near_windows(_docs(spark, sf), X.table(spark, sf, "benchmark"))


@query(
    "b08_backfill",
    "WITH "
    + T.POOL_TEXT
    + f""", lab AS (SELECT * FROM pool_text WHERE sample_id IN (SELECT doc_id FROM labels)),
removed AS (SELECT * FROM lab WHERE sample_id NOT IN (SELECT min(sample_id) FROM lab GROUP BY {NORM})),
need AS (SELECT source, count(*) AS need FROM removed GROUP BY 1),
res AS (SELECT p.sample_id, source, need, row_number() OVER (PARTITION BY source ORDER BY md5('0:' || sample_id), sample_id) AS fill
  FROM pool_text p JOIN need USING (source) WHERE p.sample_id NOT IN (SELECT doc_id FROM labels))
SELECT sample_id, source, fill::BIGINT AS fill FROM res WHERE fill <= need""",
)
def b08(spark, sf):
    p = X.pool_text(spark, sf)
    lab = X.table(spark, sf, "labels").select(F.col("doc_id").alias("sample_id"))
    candidates = p.join(lab, "sample_id", "left_semi")
    key = F.md5(TX.normal_form(F.concat_ws(" ", "instruction", "response")))
    removed = D.removed_equal(candidates, key)
    reserve = p.join(lab, "sample_id", "left_anti").select("sample_id", "source")
    return D.backfill(removed, reserve).select("sample_id", "source", F.col("fill").cast("bigint").alias("fill"))


TEST_SPLIT = T.POOL + """, items AS (SELECT sample_id AS item_id, joint FROM pool WHERE sample_id IN (SELECT doc_id FROM labels WHERE toxic = 1)),
cand AS (SELECT sample_id, joint FROM pool WHERE sample_id NOT IN (SELECT item_id FROM items)),
cs AS (SELECT item_id, sample_id, round(list_dot_product(c.joint, i.joint) / ((sqrt(list_dot_product(c.joint, c.joint)) + 1e-8) * (sqrt(list_dot_product(i.joint, i.joint)) + 1e-8)), 9) AS cosine FROM cand c, items i)"""


def _test_split(spark, sf):
    """Held-out rows stand for test items, the other rows are the pool."""
    held = X.table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("sample_id"))
    p = X.pool_vectors(spark, sf).select("sample_id", "joint")
    items = p.join(held, "sample_id", "left_semi").withColumnRenamed("sample_id", "item_id")
    return p.join(held, "sample_id", "left_anti"), items


@query(
    "b09_nearest_neighbours",
    "WITH " + TEST_SPLIT + """ SELECT item_id, sample_id, row_number() OVER (PARTITION BY item_id ORDER BY cosine DESC, sample_id)::BIGINT AS rank FROM cs
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY cosine DESC, sample_id) <= 20""",
)
def b09(spark, sf):
    p, items = _test_split(spark, sf)
    return N.nearest_rows(p, items, 20).select("item_id", "sample_id", F.col("rank").cast("bigint").alias("rank"))


@query("b10_embedding_near_rows", "WITH " + TEST_SPLIT + f" SELECT sample_id, {r('max(cosine)')} AS cosine FROM cs GROUP BY 1 HAVING max(cosine) >= 0.35")
def b10(spark, sf):
    p, items = _test_split(spark, sf)
    return N.rows_near_items(p, items, 0.35).select("sample_id", F.round("cosine", 6).alias("cosine"))


@query(
    "b11_disjoint_pool",
    "WITH "
    + T.SKETCH
    + """, h AS (SELECT sample_id, md5(instruction || chr(31) || response) AS content FROM pool_text)
SELECT sample_id FROM h WHERE content NOT IN (SELECT content FROM h WHERE sample_id IN (SELECT sample_id FROM sketch))
  AND content NOT IN (SELECT content FROM h WHERE sample_id IN (SELECT doc_id FROM labels WHERE toxic = 1))""",
)
def b11(spark, sf):
    h = X.pool_text(spark, sf).select("sample_id", F.md5(F.concat_ws("\u001f", "instruction", "response")).alias("content"))
    sk = h.join(X.sketch(spark, sf).select("sample_id"), "sample_id", "left_semi")
    test = X.table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("sample_id"))
    return D.disjoint(h, sk, h.join(test, "sample_id", "left_semi")).select("sample_id")


@query(
    "b12_manifest",
    "WITH " + T.POOL_TEXT + " SELECT source, count(*) AS n_rows, bit_xor(('0x' || substr(sha256(instruction || chr(31) || response), 1, 15))::BIGINT) AS checksum FROM pool_text GROUP BY 1",
)
def b12(spark, sf):
    return D.manifest(X.pool_text(spark, sf))
