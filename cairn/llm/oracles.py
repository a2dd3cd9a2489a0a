"""DuckDB SQL of the corpus queries that SQL can express."""

ORACLES: dict[str, str] = {}

#: Shards take turns claiming slots, one row of the recursion per claim.
ORACLES["op10_sharding"] = """
WITH RECURSIVE shards AS (
  SELECT i, ('0x' || substr(md5('offset:shard-' || lpad(i::VARCHAR, 2, '0')), 1, 15))::BIGINT % 2039 AS off,
         ('0x' || substr(md5('skip:shard-' || lpad(i::VARCHAR, 2, '0')), 1, 15))::BIGINT % 2038 + 1 AS skip
  FROM range(16) t(i)
), orders AS (
  SELECT i, list((off + j * skip) % 2039 ORDER BY j) AS slots FROM shards, range(2039) r(j) GROUP BY i
), fill(claim, slot, free) AS (
  SELECT -1::BIGINT, NULL::BIGINT, list_transform(range(2039), lambda x: true)
  UNION ALL
  SELECT claim + 1, picked, list_transform(free, lambda f, p: f AND p - 1 <> picked)
  FROM (SELECT claim, free, list_filter(slots, lambda s: free[s + 1])[1] AS picked
        FROM fill JOIN orders ON i = (claim + 1) % 16 WHERE claim < 2038)
)
SELECT d.doc_id, d.source, d.n_chars, k.slot::INTEGER AS slot, (f.claim % 16)::INTEGER AS shard
FROM (SELECT *, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % 2039 AS slot FROM documents) k
JOIN documents d USING (doc_id) JOIN fill f ON f.slot = k.slot
"""

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Pairs of line classes are counted by the shingles they share.
ORACLES["op9_line_dedup"] = f"""
WITH lines AS (
  SELECT doc_id, line_no - 1 AS line_no, line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL),
       unnest(parts) WITH ORDINALITY AS u(line, line_no)
), worded AS (
  SELECT doc_id, line_no, list_filter(string_split_regex({_LOWER.format('line')}, '[ \\t\\n\\x0b\\f\\r]+'), lambda w: w <> '') AS words FROM lines
), shingled AS (
  SELECT doc_id, line_no, list_sort(list_distinct(list_transform(range(1, greatest(len(words) - 3, 2)), lambda i: array_to_string(words[i:i + 4], ' ')))) AS tokens
  FROM worded WHERE len(words) >= 1
), classes AS (
  SELECT tokens, min({{'doc_id': doc_id, 'line_no': line_no}}) AS first FROM shingled GROUP BY tokens
), flat AS (
  SELECT first, len(tokens) AS n, unnest(tokens) AS token FROM classes
), late AS (
  SELECT DISTINCT b.first FROM flat a JOIN flat b ON a.token = b.token AND a.first < b.first
  GROUP BY a.first, b.first, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), gone AS (
  SELECT s.doc_id, s.line_no FROM shingled s JOIN classes c ON s.tokens = c.tokens LEFT JOIN late l ON l.first = c.first
  WHERE l.first IS NOT NULL OR {{'doc_id': s.doc_id, 'line_no': s.line_no}} > c.first
), told AS (
  SELECT l.doc_id, count(*)::INTEGER AS n_lines, count(g.doc_id)::INTEGER AS n_removed,
         md5(coalesce(string_agg(CASE WHEN g.doc_id IS NULL THEN l.line END, chr(10) ORDER BY l.line_no), '')) AS kept_md5
  FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.line_no = l.line_no GROUP BY l.doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0)::INTEGER AS n_lines, coalesce(n_removed, 0)::INTEGER AS n_removed, coalesce(kept_md5, md5('')) AS kept_md5
FROM documents d LEFT JOIN told USING (doc_id)
"""

ORACLES["op6_decontamination"] = f"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents
), b AS (
  SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(10, len(words)) AS m, unnest(list_transform(range(1, greatest(len(words) - 9, 1) + 1), lambda i: array_to_string(words[i:i + 9], ' '))) AS w
  FROM b WHERE len(words) > 0
), dw AS (
  SELECT doc_id, m, u.i, array_to_string(words[u.i:u.i + m - 1], ' ') AS w
  FROM d, (SELECT DISTINCT m FROM bw), unnest(range(1, greatest(len(words) - m + 2, 1))) AS u(i)
), hit AS (
  SELECT dw.doc_id, dw.i, dw.m, bw.item_id FROM dw JOIN bw ON dw.w = bw.w AND dw.m = bw.m
), told AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',') AS items FROM hit GROUP BY doc_id
), words_hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, len(d.words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN told USING (doc_id) LEFT JOIN words_hit USING (doc_id)
"""

_ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PLAIN = f"regexp_replace({_ASCII_LOWER.format('path')}, '[0-9]+', '0', 'g')"

ORACLES["op12_url_filters"] = f"""
WITH cut AS (
  SELECT page_id, row_number() OVER () AS r, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parsed AS (
  SELECT page_id, r, {_ASCII_LOWER.format("regexp_extract(rest, '^([^/?#]*)', 1)")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), tokened AS (
  SELECT *, list_distinct(
    list_transform(list_filter(string_split(host, '.'), lambda t: t <> ''), lambda t: 'h:' || t)
    || list_transform(list_filter(string_split({_PLAIN}, '/'), lambda t: t <> ''), lambda t: 'p:' || t)
    || list_transform(list_filter(regexp_split_to_array(host || '/' || {_PLAIN}, '[^a-z0-9\\x{{80}}-\\x{{10FFFF}}]+'), lambda t: t <> ''), lambda t: 'w:' || t)) AS tokens
  FROM parsed
), said AS (
  SELECT doc_id, max((coalesce(toxic, 0) = 1 OR coalesce(quality, 1) = 0)::INT) AS blocked
  FROM labels WHERE doc_id IS NOT NULL AND (toxic IS NOT NULL OR quality IS NOT NULL) GROUP BY doc_id
), known AS (
  SELECT r, tokens, blocked FROM tokened JOIN said ON page_id = doc_id
), counts AS (
  SELECT token, count(*) AS n, sum(blocked) AS b FROM (SELECT unnest(tokens) AS token, blocked FROM known) GROUP BY token HAVING sum(blocked) >= 10
), telling AS (
  SELECT token, -abs(b - n * (SELECT sum(blocked)::DOUBLE / count(*) FROM known)) / sqrt(n) AS less FROM counts
), chosen AS (
  SELECT r, blocked, (list(token ORDER BY less, token))[1:8] AS items
  FROM (SELECT r, blocked, unnest(tokens) AS token FROM known) JOIN telling USING (token) GROUP BY r, blocked
), sets AS (
  SELECT list_sort(list_filter(items, lambda x, i: (mask >> (i - 1)) & 1 = 1)) AS antecedent, blocked
  FROM (SELECT items, blocked, unnest(range(1, (1 << len(items))::BIGINT)) AS mask FROM chosen)
), rules AS (
  SELECT antecedent, sum(blocked) / count(*) AS confidence FROM sets GROUP BY antecedent HAVING sum(blocked) >= 10 AND sum(blocked) / count(*) >= 0.5
), kept AS (
  SELECT * FROM rules a WHERE NOT EXISTS (SELECT 1 FROM rules b WHERE len(b.antecedent) < len(a.antecedent) AND list_has_all(a.antecedent, b.antecedent))
), fixed(host, path, verdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), ruled AS (
  SELECT t.*, f.host || f.path AS rule, f.verdict FROM tokened t
  LEFT JOIN fixed f ON (t.host = f.host OR ends_with(t.host, '.' || f.host)) AND starts_with(t.path, f.path)
  QUALIFY row_number() OVER (PARTITION BY t.r ORDER BY length(f.host || f.path) DESC NULLS LAST) = 1
), mined AS (
  SELECT u.r, max(k.confidence) AS confidence FROM ruled u JOIN kept k ON list_has_all(u.tokens, k.antecedent) WHERE u.rule IS NULL GROUP BY u.r
)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN confidence IS NULL THEN 'allow' ELSE 'block' END) AS verdict, confidence
FROM ruled LEFT JOIN mined USING (r)
"""
