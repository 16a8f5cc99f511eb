"""Queries that audit a whole table: divergence of sources and the manifest of all rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwork.llm.common import table
from siftwork.llm.merkle import check_proofs, encoded, merkle_manifest
from siftwork.llm.queries import query
from siftwork.llm.source_divergence import source_divergence

OP11 = r"""
WITH d AS (
  SELECT row_number() OVER () AS row_no, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
t AS (SELECT row_no, lang, source, unnest(words) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY ALL HAVING count(DISTINCT row_no) >= 30),
v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang),
c AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN k ON t.lang = k.lang AND t.term = k.term GROUP BY ALL),
s AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (coalesce(s.total, 0) + 5 * v.v) AS p,
         1 + (1000000000::HUGEINT * (k.n + 5)) // (v.total + 5 * v.v) AS q
  FROM g JOIN k ON g.lang = k.lang JOIN v ON g.lang = v.lang
  LEFT JOIN c ON g.lang = c.lang AND g.source = c.source AND k.term = c.term
  LEFT JOIN s ON g.lang = s.lang AND g.source = s.source),
x AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
u AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM u)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 50
"""


@query("op11_source_divergence", OP11)
def op11_source_divergence(spark, sf_dir):
    return source_divergence(table(spark, sf_dir, "documents"))


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _hashed(n_chars: str) -> str:
    values = [n_chars if c == "n_chars" else c for c in FIELDS]
    return "sha256(" + " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END" for c in values) + ")"


# crc32 of the decimal id, bit by bit
_CRC = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
    lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
      lambda h, z: CASE WHEN h % 2 = 1 THEN xor(h // 2, 3988292384::BIGINT) ELSE h // 2 END))"""

OP13 = f"""
WITH RECURSIVE d AS (
  SELECT *, {_hashed("n_chars")} AS leaf, {_hashed("(n_chars + 1)")} AS other, xor({_CRC}, 4294967295::BIGINT) AS crc FROM documents),
e AS (
  SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, leaf) AS row_no, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM d),
low AS (
  SELECT lang, 0 AS level, pos, n, leaf AS h FROM e
  UNION ALL
  SELECT lang, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM low WHERE n > 1 GROUP BY lang, level, pos // 2, n),
subroots AS (
  SELECT lang, h AS subroot, level AS height, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1),
high AS (
  SELECT 0 AS level, pos, n, subroot AS h FROM subroots
  UNION ALL
  SELECT level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM high WHERE n > 1 GROUP BY level, pos // 2, n),
top AS (SELECT h AS root FROM high WHERE n = 1),
steps AS (
  SELECT e.row_no, p.level AS step, (e.pos >> p.level) % 2 = 1 AS after, s.h
  FROM e JOIN (SELECT DISTINCT lang, level FROM low WHERE n > 1) p ON e.lang IS NOT DISTINCT FROM p.lang
  LEFT JOIN low s ON s.lang IS NOT DISTINCT FROM e.lang AND s.level = p.level AND s.pos = xor(e.pos >> p.level, 1)
  UNION ALL
  SELECT e.row_no, r.height + p.level, (r.pos >> p.level) % 2 = 1, s.h
  FROM e JOIN subroots r ON e.lang IS NOT DISTINCT FROM r.lang JOIN (SELECT DISTINCT level FROM high WHERE n > 1) p ON true
  LEFT JOIN high s ON s.level = p.level AND s.pos = xor(r.pos >> p.level, 1)),
proofs AS (SELECT row_no, sha256(coalesce(string_agg(h, '' ORDER BY step), '')) AS proof_sha256, count(*) AS n_steps FROM steps GROUP BY row_no),
folds AS (
  SELECT row_no, 0 AS step, CASE WHEN crc % 7 = 0 AND n_chars IS NOT NULL THEN other ELSE leaf END AS h FROM e
  UNION ALL
  SELECT f.row_no, f.step + 1, sha256(CASE WHEN s.h IS NULL THEN f.h WHEN s.after THEN s.h || f.h ELSE f.h || s.h END)
  FROM folds f JOIN steps s ON s.row_no = f.row_no AND s.step = f.step)
SELECT e.doc_id, e.leaf, r.subroot, top.root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256, f.h AS folded_root, f.h = top.root AS verified
FROM e JOIN subroots r ON e.lang IS NOT DISTINCT FROM r.lang JOIN top ON true
LEFT JOIN proofs p ON p.row_no = e.row_no JOIN folds f ON f.row_no = e.row_no AND f.step = coalesce(p.n_steps, 0)
"""


@query("op13_merkle_manifest", OP13)
def op13_merkle_manifest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    changed = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 0
    leaves = docs.select("doc_id", "lang", F.sha2(encoded(*FIELDS), 256).alias("leaf"), changed.alias("changed"), *FIELDS[1:2], *FIELDS[3:])
    tampered = leaves.withColumn("n_chars", F.col("n_chars") + 1).withColumn("tampered", F.when(F.col("changed"), F.sha2(encoded(*FIELDS), 256)))
    manifest = merkle_manifest(tampered.select("doc_id", "lang", "leaf", "tampered"))
    shown = manifest.withColumn("shown", F.coalesce("tampered", "leaf"))
    return check_proofs(shown, "shown").select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
