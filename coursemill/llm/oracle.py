"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

SQL: dict[str, str] = {}

SQL["op10_urls"] = """
WITH placed AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
  FROM pages
), rules(rule_host, rule_path, verdict) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
         ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), best AS (
  SELECT DISTINCT p.host, p.path,
    first_value(rule_host || rule_path) OVER w AS rule, first_value(verdict) OVER w AS verdict
  FROM (SELECT DISTINCT host, path FROM placed) p JOIN rules r
    ON (p.host = r.rule_host OR ends_with(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.rule_path)
  WINDOW w AS (PARTITION BY p.host, p.path ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC)
)
SELECT page_id, p.host, p.path, rule, coalesce(verdict, 'allow') AS verdict
FROM placed p LEFT JOIN best b ON p.host = b.host AND p.path = b.path
"""

SQL["op2_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

SQL["op11_lexical"] = r"""
WITH found AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents WHERE text IS NOT NULL
), sizes AS (
  SELECT r, doc_id, len(ts) AS n FROM found WHERE len(ts) > 0
), total AS (
  SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM sizes
), items AS (
  SELECT row_number() OVER () AS i, item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
  FROM benchmark
), asked AS (
  SELECT i, item_id, t, count(*) AS times FROM items GROUP BY i, item_id, t
), tfs AS (
  SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(ts) AS t FROM found) x
  WHERE t IN (SELECT t FROM asked) GROUP BY r, t
), weights AS (
  SELECT t, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w
  FROM tfs, total GROUP BY t, n_docs
), parts AS (
  SELECT s.r, s.doc_id, f.t, w.w * ((1000000000 * f.tf) // (1000 * f.tf + 8 * (100 - 75 + (75 * s.n * n_docs) // n_terms))) AS part
  FROM tfs f JOIN sizes s ON s.r = f.r JOIN weights w ON w.t = f.t, total
), scores AS (
  SELECT a.i, a.item_id, p.r, p.doc_id, CAST(sum(a.times * p.part) AS BIGINT) AS score
  FROM asked a JOIN parts p ON p.t = a.t GROUP BY a.i, a.item_id, p.r, p.doc_id
), ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
  FROM scores WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
