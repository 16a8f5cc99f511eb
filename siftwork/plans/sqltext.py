"""The same inputs as SQL text for the twins. Written apart from the Spark views."""

from __future__ import annotations


def r(expr: str, digits: int = 6) -> str:
    """Rounded double without a negative zero."""
    return f"(round(({expr})::DOUBLE, {digits}) + 0.0::DOUBLE)"


POOL_TEXT = """pool_text AS (
  SELECT doc_id AS sample_id, split_part(text, chr(10), 1) AS instruction,
         CASE WHEN strpos(text, chr(10)) > 0 THEN substr(text, strpos(text, chr(10)) + 1) ELSE '' END AS response,
         source, lang AS language
  FROM documents)"""

POOL = (
    POOL_TEXT
    + """, pool AS (
  SELECT t.*, e.embedding::DOUBLE[] AS joint, e.label AS cluster_id
  FROM pool_text t JOIN embeddings e ON e.vec_id = t.sample_id)"""
)

# sketch: 32 good pool rows, by thirds of response length when there are enough
SKETCH = (
    POOL
    + """, src AS (
  SELECT p.*, row_number() OVER (ORDER BY length(response), sample_id) AS lr, count(*) OVER () AS n
  FROM pool p WHERE sample_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
strat AS (
  SELECT *, CASE WHEN n < 96 THEN 0 WHEN lr <= n // 3 THEN 0 WHEN lr <= 2 * n // 3 THEN 1 ELSE 2 END AS stratum FROM src),
srt AS (
  SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('0:' || sample_id), sample_id) AS pick FROM strat),
sketch AS (
  SELECT * FROM srt WHERE pick <= CASE WHEN n < 96 THEN 32 WHEN stratum < 2 THEN 11 ELSE 10 END)"""
)

# element-wise mean of the sketch embeddings as one row
QUERY_VECTOR = """qv AS (
  SELECT list(m ORDER BY i) AS q FROM (
    SELECT i, avg(joint[i]) AS m FROM sketch, range(1, 65) AS d(i) GROUP BY i))"""

TRUTH = "truth AS (SELECT doc_id AS sample_id, (quality - 0.5 * toxic)::DOUBLE AS u_hi FROM labels)"

DELTAS = """deltas AS (
  SELECT l_partkey AS sample_id, l_returnflag AS peft_id, l_linestatus AS task_id,
         (l_suppkey % 2)::BIGINT AS anchor_idx,
         (CASE WHEN l_linenumber % 2 = 1 THEN 1 ELSE 4 END)::BIGINT AS horizon,
         sum(round(l_extendedprice * 100)::BIGINT)::DOUBLE / (count(*) * 100.0::DOUBLE) AS delta_raw
  FROM lineitem GROUP BY ALL)"""

EVENTS = """ev AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"""

RESULTS = (
    EVENTS
    + """, results AS (
  SELECT event_id AS run_no, event_type AS method, user_id % 5 AS config, k % 4 AS task, event_id % 3 AS seed,
         CASE user_id % 3 WHEN 0 THEN 0.05 WHEN 1 THEN 0.10 ELSE 0.30 END::DOUBLE AS budget,
         CASE WHEN event_type = 'error' AND value < 1 THEN NULL ELSE value END AS metric
  FROM ev)"""
)

COST = """cost_events AS (
  SELECT event_id AS run_no, event_type AS stage, ts, value AS wall_time_sec, 8 AS gpu_count, user_id AS run_id
  FROM events)"""

SITES = """sites AS (
  SELECT (3 * i + j)::INT AS site, (4 * i + 3)::INT AS layer, m AS module
  FROM range(0, 8) AS a(i), (VALUES (0, 'attn_out'), (1, 'mlp_out'), (2, 'block_residual')) AS b(j, m))"""

SIGNATURES = (
    SITES
    + """, sig0 AS (
  SELECT p.sample_id, s.site, s.layer, s.module, list_slice(p.joint, 3 * s.site + 1 - greatest(0, s.site - 16), 3 * s.site + 1 - greatest(0, s.site - 16) + CASE WHEN s.site < 16 THEN 2 ELSE 1 END) AS v
  FROM pool p, sites s),
signatures AS (
  SELECT sample_id, site, layer, module,
         list_transform(v, lambda x: x / greatest(sqrt(list_dot_product(v, v)), 1e-8)) AS g FROM sig0)"""
)

TASK_SIGNATURES = """tsig AS (
  SELECT site, list_transform(m, lambda x: x / greatest(sqrt(list_dot_product(m, m)), 1e-8)) AS t FROM (
    SELECT site, list(v ORDER BY i) AS m FROM (
      SELECT site, i, avg(g[i]) AS v FROM signatures, range(1, 4) AS d(i)
      WHERE i <= len(g) AND sample_id IN (SELECT sample_id FROM sketch) GROUP BY ALL) GROUP BY site))"""

SCALE = """scale_rows AS (
  SELECT line || '-' || row_number() OVER (PARTITION BY line ORDER BY l_shipdate, l_quantity, l_discount, l_tax) AS sample_id,
         l_suppkey AS cluster_id, l_extendedprice AS q
  FROM (SELECT *, md5(l_orderkey || '|' || l_partkey || '|' || l_suppkey || '|' || l_linenumber || '|'
                      || round(l_extendedprice * 100)::BIGINT) AS line FROM lineitem))"""


def budgets_sql(source: str, alpha: str = "0.6", floor: str = "0", keys: str = "") -> str:
    """Allocation over clusters as CTEs; ``source`` has (keys.., cluster_id, size, value, budget)."""
    part = f"PARTITION BY {keys}" if keys else ""
    k = f"{keys}, " if keys else ""
    return f"""b1 AS (
  SELECT *, value - least(min(value) OVER ({part}), 0) AS shifted FROM {source}),
b2 AS (
  SELECT *, (CASE WHEN {alpha} = 0 OR max(shifted) OVER ({part}) <= 1e-12 THEN 1.0
             ELSE power(greatest(shifted, 0), {alpha}) END) * power(size::DOUBLE, 1 - {alpha}) AS w,
         least({floor}, size) AS floor0 FROM b1),
b3 AS (
  SELECT *, floor0 - least(floor0, greatest(0, greatest(sum(floor0) OVER ({part}) - budget, 0)
             - coalesce(sum(floor0) OVER ({part} ORDER BY w, cluster_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS fl FROM b2),
b4 AS (
  SELECT *, least(fl + round_even(greatest(budget - sum(fl) OVER ({part}), 0) * w / greatest(sum(w) OVER ({part}), 1e-12), 0), size) AS b0 FROM b3),
b5 AS (
  SELECT *, budget - sum(b0) OVER ({part}) AS rem,
         coalesce(sum(size - b0) OVER ({part} ORDER BY w DESC, cluster_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS slack_before,
         coalesce(sum(b0 - fl) OVER ({part} ORDER BY w, cluster_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cut_before FROM b4),
budgets AS (
  SELECT {k}cluster_id, size, value,
         (CASE WHEN rem > 0 THEN b0 + least(size - b0, greatest(0, rem - slack_before))
               WHEN rem < 0 THEN b0 - least(b0 - fl, greatest(0, -rem - cut_before)) ELSE b0 END)::BIGINT AS b FROM b5)"""
