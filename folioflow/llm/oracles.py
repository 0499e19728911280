"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

OP4 = r"""
WITH sizes AS (SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid, sum(source_size) OVER () AS total, count(*) OVER () AS n FROM s0),
s2 AS (SELECT *, sid % 3 + 1 AS weight, source_size * 3 AS cap FROM s1),
s3 AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY cap / weight, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS own FROM s2),
s4 AS (SELECT *, max(CASE WHEN own * weight < cap THEN own END) OVER () AS level FROM s3),
s5 AS (SELECT *, coalesce(least(level * weight, cap::DOUBLE), cap::DOUBLE) AS target, greatest(1, least(2048, floor(total / (n * 2000)))) AS block FROM s4),
s6 AS (SELECT *, greatest(1, ceil(source_size / block))::BIGINT AS blocks FROM s5),
s7 AS (SELECT *, CASE WHEN source_size > 0 THEN least(round(target * blocks / source_size), blocks * 3) ELSE 0 END::BIGINT AS quota FROM s6),
s8 AS (SELECT *, CASE WHEN quota > 0 THEN quota + ceil(log2(sum(quota) OVER () + 2)) + 4 ELSE 0 END::BIGINT AS points FROM s7),
plan AS (SELECT *, (sum(points) OVER (ORDER BY sid))::DOUBLE / sum(points) OVER () AS high, (sum(points) OVER (ORDER BY sid) - points)::DOUBLE / sum(points) OVER () AS low, sum(points) OVER () AS all_points FROM s8),
spots AS (SELECT i, x - floor(x) AS u FROM (SELECT i, (i >> 20) * 0.6077874097973108::DOUBLE + (i % 1048576) * 0.6180339887498949::DOUBLE AS x FROM range((SELECT max(all_points)::BIGINT FROM plan)) AS t(i))),
served AS (SELECT sid, blocks, quota, row_number() OVER (PARTITION BY sid ORDER BY i) - 1 AS rank FROM spots JOIN plan ON u >= low AND u < high),
times AS (SELECT sid, rank % blocks AS block, count(*) AS times FROM served WHERE rank < quota GROUP BY ALL),
placed AS (
  SELECT d.doc_id, d.size, p.source_size, p.target, p.sid, p.source_size // p.blocks AS len, p.source_size % p.blocks AS longer, p.blocks, row_number() OVER () AS k,
    coalesce(sum(d.size) OVER (PARTITION BY p.sid ORDER BY md5(coalesce(d.doc_id::VARCHAR, '')), d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM sizes d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source),
taken AS (
  SELECT k, sum(times * (least(start + size, (block + 1) * len + least(block + 1, longer)) - greatest(start, block * len + least(block, longer)))) AS taken
  FROM placed JOIN times USING (sid) WHERE block * len + least(block, longer) < start + size AND (block + 1) * len + least(block + 1, longer) > start GROUP BY k)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM placed LEFT JOIN taken USING (k)
"""

OP8 = r"""
WITH parts AS (SELECT page_id, translate(regexp_extract(coalesce(regexp_extract(url, '(?s)^.*?://(.*)$', 1), ''), '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(regexp_extract(url, '(?s)^.*?://(.*)$', 1), ''), '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM pages),
rules AS (SELECT * FROM (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')) AS t(v, h, p)),
best AS (SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v FROM parts, rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN starts_with(host || path, 'm.') OR contains(host || path, '/print/') THEN 'block' ELSE 'allow' END) AS verdict FROM parts LEFT JOIN best USING (page_id)
"""

OP9 = """
WITH w AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score FROM w q, w c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""
