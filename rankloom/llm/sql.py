"""SQL of the training-data queries that SQL can express, for DuckDB."""

from __future__ import annotations

SPACE = r"[\x20\x09-\x0D]+"
SOLID = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP4 = f"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
c AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM (SELECT page_id, coalesce(rest, '') AS rest FROM u)),
r(verdict, h, p) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
fit AS (SELECT c.page_id, r.h || r.p AS rule, r.verdict FROM c JOIN r ON (c.host = r.h OR ends_with(c.host, '.' || r.h)) AND starts_with(c.path, r.p) QUALIFY row_number() OVER (PARTITION BY c.page_id ORDER BY length(r.h || r.p) DESC) = 1),
o AS (SELECT c.host, 1 - l.quality AS bad FROM (SELECT DISTINCT * FROM c) c JOIN labels l ON l.doc_id = TRY_CAST(nullif(regexp_extract(c.path, '^/[a-z]+/([0-9]{{1,18}})', 1), '') AS BIGINT)),
h0 AS (SELECT host, CAST(count(CASE WHEN bad = 1 THEN 1 END) AS DOUBLE) AS bad, CAST(count(CASE WHEN bad IN (0, 1) THEN 1 END) AS DOUBLE) AS n FROM o GROUP BY 1),
h1 AS (SELECT *, string_split(regexp_replace(host, ':.*$', ''), '.') AS a FROM h0),
h2 AS (SELECT *, CASE WHEN len(a) >= 3 AND length(a[-1]) = 2 AND a[-2] IN ('ac', 'co', 'com', 'edu', 'gov', 'net', 'org') THEN 2 ELSE 1 END AS k FROM h1),
hosts AS (SELECT host, bad, n, array_to_string(a[greatest(1, len(a) - k):], '.') AS domain, array_to_string(a[greatest(1, len(a) - k + 1):], '.') AS suffix FROM h2),
sx AS (SELECT suffix, sum(bad) AS bad, sum(n) AS n FROM hosts GROUP BY 1),
dm AS (SELECT domain, suffix, sum(bad) AS bad, sum(n) AS n FROM hosts GROUP BY 1, 2),
mo AS (SELECT lvl, sum(bad) / sum(n) AS m, sum(n) AS nn, count(*) AS mm, sum(bad * bad / n) AS sq, sum(n * n) AS n2 FROM (
  SELECT 's' AS lvl, bad, n FROM sx UNION ALL SELECT 'd', bad, n FROM dm UNION ALL SELECT 'h', bad, n FROM hosts) WHERE n > 0 GROUP BY 1),
st AS (SELECT lvl, m AS mean, least(1000.0, greatest(2.0, coalesce(1.0 / nullif(greatest(CASE WHEN nn - n2 / nn - (mm - 1) > 0 AND m * (1 - m) > 0
  THEN (sq - nn * m * m - m * (1 - m) * (mm - 1)) / (m * (1 - m) * (nn - n2 / nn - (mm - 1))) END, 0.0), 0.0) - 1, 1000.0))) AS strength FROM mo),
dr AS (SELECT dm.*, (sx.bad - dm.bad + st.mean * st.strength) / (sx.n - dm.n + st.strength) AS up FROM dm JOIN sx USING (suffix), st WHERE lvl = 's'),
hp AS (SELECT host, hosts.bad, hosts.n, (dr.bad - hosts.bad + up * st.strength) / (dr.n - hosts.n + st.strength) AS prior FROM hosts JOIN dr USING (domain), st WHERE lvl = 'd'),
hr AS (SELECT host, mean, bad + prior * strength AS a, n - bad + (1 - prior) * strength AS b FROM hp, st WHERE lvl = 'h'),
lb AS (SELECT host, mean, a / (a + b) - 1.64 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS bound FROM hr),
bl AS (SELECT host FROM lb WHERE bound * (1 - mean) > 2.0 * mean * (1 - bound))
SELECT c.page_id, c.host, c.path, fit.rule, coalesce(fit.verdict, CASE WHEN c.host IN (SELECT host FROM bl) THEN 'block' ELSE 'allow' END) AS verdict FROM c LEFT JOIN fit USING (page_id)"""

OP10 = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, source, text, regexp_extract_all(text, '{SOLID}') AS ws FROM d),
win AS (SELECT doc_id, k, array_to_string(ws[k:k + 4], ' ') AS g FROM w, unnest(range(1, len(ws) - 3)) AS t(k)),
rep AS (SELECT doc_id, k FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
cov AS (SELECT doc_id, CAST(sum(least(5, k - coalesce(before, k - 5))) AS BIGINT) AS n FROM (SELECT doc_id, k, lag(k) OVER (PARTITION BY doc_id ORDER BY k) AS before FROM rep) GROUP BY 1),
ln AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM d) WHERE regexp_matches(l, '{SOLID}') GROUP BY 1),
m AS (SELECT w.doc_id, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(coalesce(ln.n, 0) AS BIGINT) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words
  FROM w LEFT JOIN cov USING (doc_id) LEFT JOIN ln USING (doc_id)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
k AS (SELECT source, rule, CAST(count(CASE WHEN bad THEN 1 END) AS DOUBLE) AS k, count(*) AS n FROM (
  SELECT source, 1 AS rule, n_words < 10 AS bad FROM f UNION ALL SELECT source, 2, 100 * n_repeat_words > 20 * n_words FROM f UNION ALL SELECT source, 3, n_symbols > n_words FROM f
  UNION ALL SELECT source, 4, 10 * n_dup_lines > n_words FROM f UNION ALL SELECT source, 5, word_chars > 40 * n_words FROM f) GROUP BY 1, 2),
mo AS (SELECT rule, sum(k) / sum(n) AS m, CAST(sum(n) AS DOUBLE) AS nn, count(*) AS mm, sum(k * k / n) AS sq, CAST(sum(n * n) AS DOUBLE) AS n2 FROM k GROUP BY 1),
p AS (SELECT rule, m, least(1e6, greatest(1.0, coalesce(1.0 / nullif(greatest(CASE WHEN nn - n2 / nn - (mm - 1) > 0 AND m * (1 - m) > 0
  THEN (sq - nn * m * m - m * (1 - m) * (mm - 1)) / (m * (1 - m) * (nn - n2 / nn - (mm - 1))) END, 0.0), 0.0) - 1, 1e6))) AS t FROM mo),
b AS (SELECT source, rule, m, k + m * t AS a, n - k + (1 - m) * t AS b FROM k JOIN p USING (rule)),
lb AS (SELECT source, rule, m, a / (a + b) - 1.64 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS bound FROM b),
v AS (SELECT source, max(bound) > 0.5 AS rejected, list(rule) FILTER (bound * (1 - m) > 2.0 * m * (1 - bound)) AS suspect FROM lb GROUP BY 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(rejected
  OR list_contains(suspect, 1) AND n_words < 10 OR list_contains(suspect, 2) AND 100 * n_repeat_words > 20 * n_words OR list_contains(suspect, 3) AND n_symbols > n_words
  OR list_contains(suspect, 4) AND 10 * n_dup_lines > n_words OR list_contains(suspect, 5) AND word_chars > 40 * n_words, false) AS kept
FROM f LEFT JOIN v ON f.source IS NOT DISTINCT FROM v.source"""

OP6 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'UP', 'LOW'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'UP', 'LOW'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (SELECT item_id, least(len(ws), 10) AS n, array_to_string(ws[k:k + 9], ' ') AS g FROM b, unnest(range(1, greatest(2, len(ws) - 8))) AS t(k) WHERE len(ws) > 0),
dw AS (SELECT doc_id, k, s.n, array_to_string(ws[k:k + s.n - 1], ' ') AS g FROM d, (SELECT DISTINCT n FROM bw) s, unnest(range(1, len(ws) - s.n + 2)) AS t(k)),
o AS (SELECT DISTINCT dw.doc_id, dw.k, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
h AS (SELECT doc_id, count(DISTINCT w) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS w FROM o) GROUP BY 1),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM o) GROUP BY 1)
""".replace("'UP', 'LOW'", f"'{UPPER}', '{LOWER}'")
OP6 += """SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)"""

OP7 = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{SOLID}') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[k:k + 3], ' ') AS g FROM d, unnest(range(1, greatest(2, len(ws) - 2))) AS t(k) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM i JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM n UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y),
m AS (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)"""

#: CRC-32 goes by bytes and a table made by its rule. Near words are equal but for one place, or one is the other without a place.
OP11 = f"""
WITH RECURSIVE tb AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(CAST(i AS BIGINT), range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t),
o AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[a-zÀ-ÿ]+')) AS run FROM documents),
p AS (SELECT run, count(*) AS c, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS named FROM o GROUP BY doc_id, run),
h AS (SELECT run, c, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, 2 * strlen(named), 2), lambda k: CAST('0x' || hex(encode(named))[k:k + 1] AS BIGINT))), lambda x, b: xor(x >> 8, t[1 + (xor(x, b) & 255)])), 4294967295) AS h FROM p, tb),
a AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, c FROM h),
w AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM a WHERE length(word) >= 5 GROUP BY 1 HAVING sum(c) >= 3),
d AS (SELECT word, n, i, substr(word, 1, CAST(i AS INT)) || substr(word, CAST(i AS INT) + 2) AS rest FROM w, unnest(range(length(word))) AS r(i)),
near AS (SELECT x.word, y.word AS other, y.n AS m FROM d x JOIN d y ON x.i = y.i AND x.rest = y.rest AND x.word <> y.word
  UNION SELECT d.word, w.word, w.n FROM d JOIN w ON w.word = d.rest UNION SELECT w.word, d.word, d.n FROM d JOIN w ON w.word = d.rest),
f AS (SELECT w.word, w.n, count(near.other) AS n_near, first(near.other ORDER BY near.m DESC, near.other) AS best, max(near.m) AS best_n FROM w LEFT JOIN near USING (word) GROUP BY 1, 2),
g AS (SELECT word, n, n_near, CASE WHEN best_n >= 2 * n THEN best END AS form, CASE WHEN best_n >= 2 * n THEN best_n END AS form_n FROM f),
r AS (SELECT word, word AS root, form AS next FROM g UNION ALL SELECT r.word, g.word, g.form FROM r JOIN g ON g.word = r.next)
SELECT g.word, g.form, r.root, g.n, g.n_near, g.form_n FROM g JOIN r ON r.word = g.word AND r.next IS NULL"""

SQL = {"op4_urls": OP4, "op6_decontaminate": OP6, "op7_jaccard": OP7, "op10_quality": OP10, "op11_spelling": OP11}
