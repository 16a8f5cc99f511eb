"""Queries over single documents and lines: personal data, line dedup, mixing."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwork.llm.common import table
from siftwork.llm.edit_fingerprints import edit_fingerprints
from siftwork.llm.line_dedup import line_dedup
from siftwork.llm.mixing import mix_sources
from siftwork.llm.pii import KINDS, find_pii
from siftwork.llm.queries import query


@query("op2_pii")
def op2_pii(spark, sf_dir):
    found = find_pii(table(spark, sf_dir, "documents"))
    base = KINDS[:4]

    def listed(kinds):
        some = F.filter("spans", lambda s: s.kind.isin(*kinds))
        return F.array_join(F.transform(some, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s.kind == kind)).cast("bigint").alias(f"n_{kind}")

    counts = [*[count(k) for k in KINDS[4:]], F.size("spans").cast("bigint").alias("n_spans")]
    return found.select("doc_id", *[count(k) for k in base], F.sha2(listed(base), 256).alias("base_sha256"), listed(KINDS).alias("spans"), *counts)


OP4 = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
s AS (
  SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (
  SELECT k.doc_id, k.pos, k.line, s.first IS NOT NULL AND k.doc_id > s.first AS gone
  FROM k LEFT JOIN s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


@query("op4_line_dedup", OP4)
def op4_line_dedup(spark, sf_dir):
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


OP10 = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         (('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5)
           / 4503599627370496.0 AS u
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w,
         source_size * 2.0::DOUBLE AS full_
  FROM s),
v AS (
  SELECT *, ((sum(source_size) OVER ())::BIGINT * 1.5::DOUBLE
             - coalesce(sum(full_) OVER (ORDER BY full_ / w, source ASC NULLS LAST
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / (sum(w) OVER (ORDER BY full_ / w, source ASC NULLS LAST
                        ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM w),
c AS (SELECT *, full_ <= level * w AS capped FROM v),
t AS (
  SELECT source, source_size,
         CASE WHEN capped THEN full_ ELSE max(CASE WHEN NOT capped THEN level END) OVER () * w END AS target
  FROM c),
p AS (
  SELECT *, coalesce(floor(target / nullif(source_size, 0)), 0)::BIGINT AS copies,
         round(target)::BIGINT - coalesce(floor(target / nullif(source_size, 0)), 0)::BIGINT * source_size AS due
  FROM t),
r AS (
  SELECT d.doc_id, d.size, p.source_size, p.target, p.copies, p.due,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.u, d.doc_id
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS sofar
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (copies * size + greatest(0, least(size, due - sofar)))::BIGINT AS taken
FROM r
"""


@query("op10_mixing", OP10)
def op10_mixing(spark, sf_dir):
    out = mix_sources(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


@query("op8_edit_fingerprints")
def op8_edit_fingerprints(spark, sf_dir):
    return edit_fingerprints(table(spark, sf_dir, "documents"))
