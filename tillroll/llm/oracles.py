"""The same results in DuckDB's SQL, where SQL can say them."""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

CONTAMINATION = r"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all({doc_text}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM {documents}),
item AS (
  SELECT item_id, regexp_extract_all({item_text}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, list_slice(w, i, least(i + 12, len(w))) AS g, least(13, len(w)) AS size
  FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 11))) AS i FROM item WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM win),
place AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM doc),
gram AS (
  SELECT doc_id, p, size, list_slice(w, p, p + size - 1) AS g FROM place, sizes WHERE p + size - 1 <= len(w)),
hit AS (SELECT gram.doc_id, gram.p, gram.size, win.item_id FROM gram JOIN win USING (size, g)),
covered AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit
  FROM (SELECT doc_id, unnest(range(p, p + size)) AS q FROM (SELECT DISTINCT doc_id, p, size FROM hit)) GROUP BY 1),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY 1)
SELECT doc_id, coalesce(len(w), 0) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= coalesce(len(w), 0) AS contaminated
FROM doc LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
""".replace("{doc_text}", _LOWER.format("text")).replace("{item_text}", _LOWER.format("text"))

WARC = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS payload_bytes FROM pages),
m AS (SELECT h, max(page_id) AS largest FROM p WHERE payload_bytes >= 1000 GROUP BY h)
SELECT page_id, payload_bytes, sha1(p.h) AS payload_digest,
  CASE WHEN largest <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN largest <> page_id THEN largest END AS refers_to
FROM p LEFT JOIN m ON p.h = m.h
"""

VECTORS = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE label IS NOT NULL),
u AS (SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v),
good AS (SELECT * FROM u WHERE n > 0 AND isfinite(n)),
link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
comp AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY 1),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM link GROUP BY 1)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM comp LEFT JOIN n USING (vec_id)
"""

ORACLES = {"op3_embedding_dedup": VECTORS, "op2_decontamination": CONTAMINATION.replace("{documents}", "documents"), "op8_warc": WARC}
