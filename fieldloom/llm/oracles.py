"""SQL, in DuckDB's dialect, for the text queries that SQL can express on whole tables."""

from __future__ import annotations

import string

_LOWER = f"translate(coalesce(text,''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"

TOP_K = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x : CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x : x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(coalesce(list_sum(list_transform(list_zip(a.q, b.q), lambda p : p[1] * p[2])), 0) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 10
"""

DECONTAMINATE = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
t AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark),
m AS (SELECT item_id, ws, least(10, len(ws)) AS n FROM t WHERE len(ws) > 0),
iw AS (SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS g FROM (SELECT item_id, n, ws, unnest(range(1, len(ws) - n + 2)) AS i FROM m)),
dw AS (SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM iw))),
h AS (SELECT DISTINCT doc_id, i, n, item_id FROM dw JOIN iw USING (n, g)),
w AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
f AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM h GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN w USING (doc_id) LEFT JOIN f USING (doc_id)
"""

JACCARD = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + least(3, len(ws)) - 1], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM o JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * o >= 90 * (a.n + b.n - o)),
r AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT r.doc_id, l.y FROM r JOIN l ON l.x = r.c)
SELECT doc_id, CAST(coalesce(max(n.n), 0) AS BIGINT) AS n_shingles, min(r.c) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS n, regexp_replace(regexp_replace(coalesce(url, ''), '[\\r\\n]', '', 'g'), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS u FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY h),
k AS (SELECT p.*, first, regexp_replace(lower(regexp_extract(u, '^([^/?#:]*)', 1)), '^www\\d*\\.', '') AS host, regexp_extract(u, '^[^/?#]*([^#]*)', 1) AS path FROM p LEFT JOIN f ON p.h = f.h AND p.n >= 100)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest, CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
 CASE WHEN first <> page_id THEN first END AS refers_to, array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || CASE WHEN path = '' THEN '/' ELSE path END AS url_key, CAST(1700000000 + page_id AS BIGINT) AS captured
FROM k
"""

AUDIT = """
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
  (CASE WHEN len(ws) < 100 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 2 ELSE 0 END)
  + (CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t) THEN 4 ELSE 0 END) + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END)
  + (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END) AS mask FROM d LEFT JOIN l USING (doc_id)),
m AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, mask),
s AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(c, b)),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits FROM s a, s b, s c, s d, s e WHERE a.b + b.b + c.b + d.b + e.b = 31 AND a.b | b.b | c.b | d.b | e.b = 31),
p AS (SELECT filter_order, i AS step, bits[i] AS b, CASE WHEN i = 1 THEN 0 ELSE CAST(list_sum(bits[1:i - 1]) AS BIGINT) END AS before FROM o, (SELECT unnest(range(1, 6)) AS i) r),
r AS (SELECT part, filter_order, step, b,
  sum(CASE WHEN mask & (before | b) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & before = 0 AND mask & b <> 0 THEN n ELSE 0 END) AS removed, sum(CASE WHEN mask & before <> 0 AND mask & b <> 0 THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN mask = b THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN mask & before = 0 AND mask & b <> 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & before = 0 AND mask & b <> 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM m, p GROUP BY part, filter_order, step, b)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
 CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, b) AS BIGINT) AS shapley FROM r
"""

NEAR_VECTORS = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x : CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x : x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x : x <> 0)) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT vec_id, vec_id AS c FROM embeddings UNION SELECT r.vec_id, l.y FROM r JOIN l ON l.x = r.c),
n AS (SELECT x AS vec_id, count(*) AS n FROM l GROUP BY x)
SELECT vec_id, CAST(coalesce(max(n), 0) AS BIGINT) AS n_links, min(c) AS component_id, vec_id = min(c) AS kept FROM r LEFT JOIN n USING (vec_id) GROUP BY vec_id
"""

COLLOCATIONS = f"""
WITH p AS (SELECT doc_id, coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM p),
g AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS g FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3]) AS k) s WHERE len(ws) >= k)),
f AS (SELECT lang, k, g, count(*) AS a FROM g GROUP BY lang, k, g),
t AS (SELECT lang, sum(a) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, g, a, string_split(g, ' ') AS ws FROM f WHERE k > 1 AND a >= 10),
x AS (SELECT lang, k, g, a, j, array_to_string(ws[1:j], ' ') AS lg, array_to_string(ws[j + 1:k], ' ') AS rg FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
y AS (SELECT x.lang, x.k, x.g, x.a, j, l.a AS l, r.a AS r, CAST((CAST(1000000 AS HUGEINT) * x.a * x.a) // (CAST(l.a AS HUGEINT) * r.a) AS BIGINT) AS score
  FROM x JOIN f l ON l.lang = x.lang AND l.k = j AND l.g = lg JOIN f r ON r.lang = x.lang AND r.k = x.k - j AND r.g = rg),
z AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, j) AS o FROM y) q WHERE o = 1),
u AS (SELECT lang, part AS g, max(a) AS most FROM (SELECT lang, a, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS part FROM c WHERE k = 3) q GROUP BY 1, 2),
e AS (SELECT z.lang, z.g AS phrase, z.a, l, r, n, score FROM z JOIN t ON t.lang = z.lang LEFT JOIN u ON u.lang = z.lang AND u.g = z.g AND z.k = 2 WHERE NOT coalesce(100 * most >= 50 * z.a, false)),
k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM e)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, score FROM k WHERE rank <= 2000
"""

ORACLE_SQL: dict[str, str] = {"op3_topk": TOP_K, "op4_decontaminate": DECONTAMINATE, "op6_jaccard": JACCARD, "op7_warc": WARC, "op11_collocations": COLLOCATIONS, "op12_near_vectors": NEAR_VECTORS, "op13_filter_audit": AUDIT}
