"""SQL twins of the corpus queries that SQL can express, over whole tables."""

from __future__ import annotations

GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

OP1 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) >= 5 THEN array_to_string(w[i:i + 4], ' ') ELSE array_to_string(w, ' ') END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT p.a, p.b FROM p JOIN n x ON p.a = x.doc_id JOIN n y ON p.b = y.doc_id WHERE 100 * c >= 85 * (x.n + y.n - c)),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(v, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.v WHERE r.root < u.b),
c AS (SELECT v, min(root) AS component_id FROM r GROUP BY v)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, (c.component_id = d.doc_id) AS kept FROM documents d LEFT JOIN n USING (doc_id) JOIN c ON c.v = d.doc_id
"""

OP2 = """
WITH d AS (SELECT page_id, coalesce(url, '') AS url, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT h, max(page_id) AS first FROM d GROUP BY h),
b AS (SELECT *, list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, (i // 4) * 5 + 1, 5))::INTEGER >> (15 - 5 * (i % 4))::INTEGER) & 31) + 1)::INTEGER, 1)) AS letters FROM d)
SELECT page_id, payload_bytes, array_to_string(letters, '') AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to, url FROM b JOIN g USING (h)
"""

OP6 = rf"""
WITH w AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
k AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)),
t AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM k) WHERE c > 1),
v AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM t, (SELECT unnest(range(8)) AS o) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS lines, count(*) - count(DISTINCT x) AS dup FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM w) WHERE regexp_matches(x, '{WORD}') GROUP BY doc_id),
m AS (SELECT w.doc_id, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(v.n, 0)::BIGINT AS n_repeat_words, coalesce(lines, 0) AS lines FROM w LEFT JOIN v USING (doc_id) LEFT JOIN l USING (doc_id)),
f AS (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM m),
q AS (SELECT *, (base_failed::INTEGER + (100 * n_symbols > 10 * word_chars)::INTEGER + (100 * n_dup_lines > 30 * lines)::INTEGER) AS rules_failed FROM f),
h AS (SELECT source, count(*) AS n, count(*) FILTER (rules_failed > 0) AS bad FROM q GROUP BY source),
z AS (SELECT sum(bad)::DOUBLE / sum(n) AS mean, var_pop(bad::DOUBLE / n) AS v, avg(1.0::DOUBLE / n) AS noise FROM h),
y AS (SELECT mean, CASE WHEN mean > 0 AND mean < 1 AND noise < 1 THEN 1 / greatest(least((v / (mean * (1 - mean)) - noise) / (1 - noise), 0.5), 1.0::DOUBLE / 10001) - 1 ELSE 20.0 END AS s FROM z),
x AS (SELECT source, (bad + mean * s) / (n + s) AS rate FROM h, y)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND NOT rate > 0.5) AS kept, rules_failed, round(rate, 9) AS host_rate FROM q JOIN x USING (source)
"""

ORACLES = {"op1_near_dup": OP1, "op2_warc": OP2, "op6_quality_rules": OP6}
