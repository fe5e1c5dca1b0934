"""DuckDB SQL for the queries that SQL can express, written from their contracts by plain joins of windows, shingles and
lines."""

from __future__ import annotations

LOW = "TRANSLATE(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SPACED = r"[^\x20\x09-\x0D]+"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

LINES = rf"""WITH t AS (SELECT doc_id, COALESCE(text, '') AS text, STRING_SPLIT(COALESCE(text, ''), CHR(10)) AS parts FROM documents),
  n AS (SELECT *, CASE WHEN text = '' THEN 0 ELSE LEN(parts) - CASE WHEN ENDS_WITH(text, CHR(10)) THEN 1 ELSE 0 END END AS n_lines FROM t),
  l AS (SELECT doc_id, i AS line, REGEXP_EXTRACT_ALL(parts[i + 1], '{SPACED}') AS ws FROM n, UNNEST(RANGE(n_lines)) u(i)),
  w AS (SELECT doc_id, line, ARRAY_TO_STRING(ws, ' ') AS whole, ws FROM l WHERE LEN(ws) > 0),
  same AS (SELECT doc_id, line, ROW_NUMBER() OVER (PARTITION BY whole ORDER BY doc_id, line) > 1 AS gone FROM w),
  far AS (SELECT doc_id, line, whole, ws FROM w WHERE LEN(ws) >= 8),
  v AS (SELECT doc_id, line, i, ARRAY_TO_STRING(LIST_CONCAT(ws[1:i - 1], ws[i + 1:]), ' ') AS v FROM far, UNNEST(RANGE(1, LEN(ws) + 1)) u(i)),
  swapped AS (SELECT doc_id, line FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY v, i ORDER BY doc_id, line) AS r FROM v) WHERE r > 1),
  lead_v AS (SELECT v, MIN((doc_id, line)) AS at FROM v GROUP BY v), lead_w AS (SELECT whole, MIN((doc_id, line)) AS at FROM far GROUP BY whole),
  shorter AS (SELECT v.doc_id, v.line FROM v JOIN lead_w ON v.v = lead_w.whole WHERE lead_w.at < (v.doc_id, v.line)),
  longer AS (SELECT far.doc_id, far.line FROM far JOIN lead_v ON far.whole = lead_v.v WHERE lead_v.at < (far.doc_id, far.line)),
  gone AS (SELECT doc_id, line FROM same WHERE gone UNION SELECT * FROM swapped UNION SELECT * FROM shorter UNION SELECT * FROM longer),
  kept AS (SELECT n.doc_id, STRING_AGG(parts[i], CHR(10) ORDER BY i) AS kept FROM n, UNNEST(RANGE(1, LEN(parts) + 1)) u(i) WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = n.doc_id AND g.line = i - 1) GROUP BY n.doc_id),
  r AS (SELECT doc_id, COUNT(*) AS n_removed, STRING_AGG(line::VARCHAR, ',' ORDER BY line) AS removed FROM gone GROUP BY doc_id)
  SELECT n.doc_id, CAST(n_lines AS INTEGER) AS n_lines, CAST(COALESCE(n_removed, 0) AS INTEGER) AS n_removed, COALESCE(removed, '') AS removed, SHA256(COALESCE(kept, '')) AS kept_sha256 FROM n LEFT JOIN r USING (doc_id) LEFT JOIN kept USING (doc_id)"""

SUBSTRINGS = rf"""WITH d AS (SELECT doc_id, REGEXP_EXTRACT_ALL(COALESCE(text, ''), '{SPACED}') AS ws FROM documents),
  g AS (SELECT doc_id, i, ARRAY_TO_STRING(ws[i:i + 19], ' ') AS g FROM d, UNNEST(RANGE(1, LEN(ws) - 18)) u(i)),
  late AS (SELECT doc_id, i FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY g ORDER BY doc_id, i) AS r FROM g) WHERE r > 1),
  gone AS (SELECT DISTINCT doc_id, UNNEST(RANGE(i, i + 20)) AS p FROM late),
  kept AS (SELECT d.doc_id, STRING_AGG(ws[p], ' ' ORDER BY p) AS kept FROM d, UNNEST(RANGE(1, LEN(ws) + 1)) u(p) WHERE NOT EXISTS (SELECT 1 FROM gone x WHERE x.doc_id = d.doc_id AND x.p = u.p) GROUP BY d.doc_id),
  c AS (SELECT doc_id, COUNT(*) AS n FROM gone GROUP BY doc_id)
  SELECT d.doc_id, LEN(ws) AS n_words, COALESCE(n, 0) AS n_removed, SHA256(COALESCE(kept, '')) AS kept_sha256 FROM d LEFT JOIN c USING (doc_id) LEFT JOIN kept USING (doc_id)"""

GROUPS_OF = rf"""WITH RECURSIVE d AS (SELECT doc_id, REGEXP_EXTRACT_ALL({LOW}, '{SPACED}') AS ws FROM documents),
  s AS (SELECT DISTINCT doc_id, ARRAY_TO_STRING(ws[i:i + SPAN], ' ') AS s FROM d, UNNEST(RANGE(1, GREATEST(LEN(ws) - LESS, CASE WHEN LEN(ws) > 0 THEN 2 ELSE 0 END))) u(i)),
  n AS (SELECT doc_id, COUNT(*) AS n FROM s GROUP BY doc_id),
  p AS (SELECT a.doc_id AS a, b.doc_id AS b, COUNT(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
  e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= PERCENT * (x.n + y.n - k)),
  reach AS (SELECT a AS node, a AS label FROM e UNION SELECT e.b, r.label FROM reach r JOIN e ON e.a = r.node),
  c AS (SELECT node, MIN(label) AS label FROM reach GROUP BY node)
  SELECT d.doc_id, COALESCE(n, 0) AS n_shingles, COALESCE(label, d.doc_id) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.node = d.doc_id"""



def groups(n: int, percent: int) -> str:
    """Components of documents whose sets of n-word shingles are similar."""
    return GROUPS_OF.replace("SPAN", str(n - 1)).replace("LESS", str(n - 2)).replace("PERCENT", str(percent))


GROUPS = groups(5, 80)
NEAR = f"SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM ({groups(3, 85)})"

CONTAMINATION = rf"""WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, REGEXP_EXTRACT_ALL({LOW}, '{ALNUM}') AS ws FROM benchmark),
  k AS (SELECT item, ws, LEAST(13, LEN(ws)) AS k FROM b WHERE LEN(ws) > 0),
  g AS (SELECT DISTINCT item, k, ARRAY_TO_STRING(ws[i:i + k - 1], ' ') AS g FROM k, UNNEST(RANGE(1, LEN(ws) - k + 2)) u(i)),
  d AS (SELECT doc_id, REGEXP_EXTRACT_ALL({LOW}, '{ALNUM}') AS ws FROM documents),
  f AS (SELECT doc_id, i, k, ARRAY_TO_STRING(ws[i:i + k - 1], ' ') AS g FROM d, (SELECT DISTINCT k FROM g) q, UNNEST(RANGE(1, LEN(ws) - k + 2)) u(i)),
  m AS (SELECT f.doc_id, f.i, f.k, g.item FROM f JOIN g ON f.g = g.g AND f.k = g.k),
  h AS (SELECT doc_id, COUNT(*) AS n FROM (SELECT DISTINCT doc_id, UNNEST(RANGE(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM m)) GROUP BY doc_id),
  t AS (SELECT doc_id, COUNT(*) AS n, STRING_AGG(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM m WHERE item IS NOT NULL) GROUP BY doc_id)
  SELECT d.doc_id, LEN(ws) AS n_words, COALESCE(h.n, 0) AS n_hit, COALESCE(t.n, 0) AS n_items, SHA256(COALESCE(ids, '')) AS items_sha256, COALESCE(h.n, 0) > 0 AND 20 * COALESCE(h.n, 0) >= LEN(ws) AS contaminated
  FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)"""



def codes(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """Lloyd rounds over integer parts, one CTE for each assignment and each codebook."""
    rows = f"""WITH v AS (SELECT vec_id, label, LIST_TRANSFORM(embedding, lambda x: CAST(FLOOR({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND LEN(LIST_FILTER(embedding, lambda x: x IS NULL OR NOT ISFINITE(x))) = 0),
  x AS MATERIALIZED (SELECT vec_id, i // (LEN(v) // {parts}) AS part, i % (LEN(v) // {parts}) AS pos, v[i + 1] AS x FROM v, UNNEST(RANGE(LEN(v))) u(i)),
  b0 AS MATERIALIZED (SELECT part, entry, pos, x AS c FROM x JOIN (SELECT vec_id, ROW_NUMBER() OVER (ORDER BY vec_id) - 1 AS entry FROM v ORDER BY vec_id LIMIT {entries}) USING (vec_id))"""
    for k in range(rounds + 1):
        rows += f""",
  d{k} AS (SELECT vec_id, x.part, entry, SUM((x - c) * (x - c)) AS d FROM x JOIN b{k} b ON x.part = b.part AND x.pos = b.pos GROUP BY ALL),
  a{k} AS MATERIALIZED (SELECT vec_id, part, MIN(STRUCT_PACK(d := d, entry := entry)).entry AS entry, MIN(d) AS d FROM d{k} GROUP BY vec_id, part)"""
        if k < rounds:
            rows += f""",
  m{k} AS (SELECT x.part, entry, pos, SUM(x) AS s, COUNT(*) AS n FROM x JOIN a{k} a ON x.vec_id = a.vec_id AND x.part = a.part GROUP BY ALL),
  b{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, b.pos, CAST(CASE WHEN n IS NULL THEN c ELSE (s - ((s % n) + n) % n) // n END AS BIGINT) AS c FROM b{k} b LEFT JOIN m{k} m ON b.part = m.part AND b.entry = m.entry AND b.pos = m.pos)"""
    return rows + f""",
  r AS (SELECT vec_id, STRING_AGG(PRINTF('%02x', CAST(entry AS INTEGER)), '' ORDER BY part) AS code, CAST(SUM(d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id),
  h AS (SELECT SHA256(STRING_AGG(c::VARCHAR, ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM b{rounds})
  SELECT vec_id, code, error, CAST(SUM(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM r JOIN v USING (vec_id), h"""


ORACLES = {"op4_line_dedup": LINES, "op5_substring_dedup": SUBSTRINGS, "op6_ngram_join": GROUPS, "op8_decontamination": CONTAMINATION, "op12_minhash_dedup": NEAR, "op13_vector_codes": codes()}
