"""DuckDB SQL for those queries that SQL can express on whole tables."""

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SPACE_WORDS = r"[^\x20\x09-\x0D]+"
ALNUM_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP1 = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER}, '{SPACE_WORDS}') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, md5(array_to_string(list_slice(ws, i + 1, i + 3), ' ')) AS k FROM w, unnest(range(greatest(len(ws) - 2, 1))) r(i) WHERE len(ws) > 0
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
pairs AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
link AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach(id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.id, link.b FROM reach JOIN link ON link.a = reach.r)
SELECT id AS doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r) AS component_id FROM reach LEFT JOIN n ON n.doc_id = id GROUP BY id
"""

OP4 = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS size, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM p)
SELECT page_id, size::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN size >= 100 AND first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN size >= 100 AND first < page_id THEN first END AS refers_to FROM f
"""

OP6 = f"""
WITH i AS (SELECT item_id, regexp_extract_all({LOWER}, '{ALNUM_WORDS}') AS ws FROM benchmark),
k AS (SELECT DISTINCT item_id, array_to_string(list_slice(ws, s + 1, s + 10), ' ') AS k, least(len(ws), 10) AS size FROM i, unnest(range(greatest(len(ws) - 9, 1))) r(s) WHERE len(ws) > 0),
d AS (SELECT doc_id, regexp_extract_all({LOWER}, '{ALNUM_WORDS}') AS ws FROM documents),
t AS (SELECT doc_id, s, z.size, array_to_string(list_slice(ws, s + 1, s + z.size), ' ') AS k FROM d, (SELECT DISTINCT size FROM k) z, unnest(range(len(ws) - z.size + 1)) r(s)),
h AS (SELECT t.doc_id, t.s, t.size, k.item_id FROM t JOIN k ON k.k = t.k AND k.size = t.size),
c AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(s, s + size)) AS p FROM h) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id)
"""

OP7 = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
u AS (SELECT vec_id, label, e, sqrt(list_inner_product(e, e)) AS n FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id < b.vec_id AND len(a.e) = len(b.e) WHERE list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.98),
link AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach(id, r) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.id, link.b FROM reach JOIN link ON link.a = reach.r),
c AS (SELECT a AS id, count(*) AS n FROM link GROUP BY a)
SELECT id AS vec_id, coalesce(any_value(c.n), 0)::BIGINT AS n_links, min(r) AS component_id, id = min(r) AS kept FROM reach LEFT JOIN c USING (id) GROUP BY id
"""

OP10 = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{SPACE_WORDS}') AS ws FROM documents),
t AS (SELECT doc_id, s, md5(array_to_string(list_slice(ws, s + 1, s + 20), ' ')) AS k FROM w, unnest(range(greatest(len(ws) - 19, 0))) r(s)),
late AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS n FROM t) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM late),
each AS (SELECT doc_id, p, ws[p + 1] AS word FROM w, unnest(range(len(ws))) r(p)),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text FROM each ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""

SEARCH_TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
OP12 = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS id, regexp_extract_all({LOWER}, '{SEARCH_TERMS}') AS ws FROM documents),
q AS (SELECT item_id, row_number() OVER () AS item, regexp_extract_all({LOWER}, '{SEARCH_TERMS}') AS ws FROM benchmark),
s AS (SELECT count(*)::BIGINT AS n, sum(len(ws))::BIGINT AS l FROM d WHERE len(ws) > 0),
qt AS (SELECT item, item_id, term, count(*) AS times FROM (SELECT item, item_id, unnest(ws) AS term FROM q) GROUP BY ALL),
tf AS (SELECT id, doc_id, term, size, count(*) AS tf FROM (SELECT id, doc_id, len(ws) AS size, unnest(ws) AS term FROM d) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * any_value(s.n) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, s GROUP BY term),
hit AS (SELECT item, item_id, id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * size * s.n) // s.l))))::BIGINT AS score FROM tf JOIN w USING (term) JOIN qt USING (term), s GROUP BY ALL),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id, id)::INT AS rank, doc_id, score FROM hit WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20
"""

LETTERS = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
OP13 = f"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({LOWER}, '{LETTERS}') AS ws FROM documents),
t AS (SELECT id, lang, source, unnest(ws) AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM t GROUP BY ALL HAVING count(DISTINCT id) >= 3),
l AS (SELECT lang, count(*) AS v, sum(total) AS n FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source, coalesce(sum(c.n), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 1))::HUGEINT // (g.n + l.v) AS p, 1 + (1000000000 * (k.total + 1))::HUGEINT // (l.n + l.v) AS q
  FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
),
f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
o AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (((p - q) * (p - q)) // q)::BIGINT FROM p WHERE n > 0 AND p > q
),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM o)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 200
"""
