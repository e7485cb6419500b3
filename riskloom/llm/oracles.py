"""DuckDB SQL for the operators that SQL can express."""

_BYTE_HEX = "SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents"

OP1 = f"""
WITH d AS ({_BYTE_HEX}),
w AS (SELECT doc_id, p, substring(h, 2 * p + 1, 100) AS k FROM d, unnest(range(greatest(strlen(h) // 2 - 49, 0))) AS t(p)),
f AS (SELECT k, min(doc_id) AS first_id FROM w GROUP BY k HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT doc_id, p FROM w JOIN f USING (k) WHERE first_id < doc_id),
runs AS (SELECT doc_id, p, p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 AS gap FROM hit),
spans AS (SELECT doc_id, p, sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM runs),
cuts AS (SELECT doc_id, g, min(p) AS a, max(p) + 50 AS b FROM spans GROUP BY doc_id, g),
parts AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS prev FROM cuts),
agg AS (
  SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last,
         string_agg(substring(h, 2 * prev + 1, 2 * (a - prev)), '' ORDER BY a) AS head
  FROM parts JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, CAST(strlen(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(head || substring(h, 2 * last + 1), h))) AS kept_sha256
FROM d LEFT JOIN agg USING (doc_id)
"""

OP7 = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
w AS (SELECT doc_id, p, array_to_string(ws[p : p + 12], ' ') AS k FROM d, unnest(range(1, greatest(len(ws) - 11, 1))) AS t(p)),
f AS (SELECT k, min(doc_id) AS first_id FROM w GROUP BY k HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, p + o AS p FROM w JOIN f USING (k), unnest(range(13)) AS t(o) WHERE first_id < doc_id),
per_doc AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id),
kept AS (
  SELECT doc_id, ws, coalesce(len(ps), 0) AS n_removed,
         CASE WHEN ps IS NULL THEN ws ELSE list_filter(ws, lambda x, i: NOT list_contains(ps, i)) END AS left_over
  FROM d LEFT JOIN per_doc USING (doc_id))
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed, sha256(array_to_string(left_over, ' ')) AS kept_sha256 FROM kept
"""

OP8 = r"""
WITH words AS (
  SELECT 0 AS kind, doc_id AS id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents
  UNION ALL
  SELECT 1, item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') FROM benchmark),
item AS (SELECT id AS item_id, ws, least(len(ws), 10) AS n FROM words WHERE kind = 1 AND len(ws) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(ws[p : p + n - 1], ' ') AS k FROM item, unnest(range(1, len(ws) - n + 2)) AS t(p)),
sizes AS (SELECT DISTINCT n FROM win),
own AS (SELECT id AS doc_id, p, n, array_to_string(ws[p : p + n - 1], ' ') AS k FROM words, sizes, unnest(range(1, greatest(len(ws) - n + 2, 1))) AS t(p) WHERE kind = 0),
met AS (SELECT own.doc_id, own.p, own.n, win.item_id FROM own JOIN win USING (k, n)),
hit AS (SELECT doc_id, count(DISTINCT p + o) AS n_hit FROM met, unnest(range(n)) AS t(o) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM met) GROUP BY doc_id)
SELECT w.id AS doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words w LEFT JOIN hit ON hit.doc_id = w.id LEFT JOIN ids ON ids.doc_id = w.id WHERE kind = 0
"""

OP10 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
k AS (SELECT t, max(page_id) AS m FROM p WHERE strlen(t) >= 1000 GROUP BY t)
SELECT page_id, CAST(strlen(t) AS BIGINT) AS payload_bytes, sha1(t) AS payload_digest,
       CASE WHEN m <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN m <> page_id THEN m END AS refers_to
FROM p LEFT JOIN k USING (t)
"""

ORACLES = {"op1_suffix_array": OP1, "op7_substring": OP7, "op8_decontaminate": OP8, "op10_warc": OP10}
