"""DuckDB SQL for the operators that SQL can express.

Quality rules: the whole operator. URL filters: the rules, and the default of pages that no
link joins to others (page tables whose html has links need the component search, which the
tests hold against brute force). The rest has no SQL form.
"""

from __future__ import annotations

_QUALITY = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
         len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(t) - len(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper
  FROM d
), p AS (
  SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w
), g AS (
  SELECT r, i, word, lead(word, 1) OVER o AS w2, lead(word, 2) OVER o AS w3 FROM p WINDOW o AS (PARTITION BY r ORDER BY i)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, word, w2, w3) AS n FROM g WHERE w3 IS NOT NULL) WHERE n > 1
), again AS (
  SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM twice, (VALUES (0), (1), (2)) AS v(k) GROUP BY r
), m AS (
  SELECT d.r, doc_id, lang, source, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: len(x))), 0)::BIGINT AS word_chars,
         n_symbols::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         n_upper, len(ls) AS n_lines
  FROM d JOIN w USING (r) LEFT JOIN again USING (r)
), f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         CASE WHEN word_chars > 0 THEN 1000 * n_symbols // word_chars ELSE 0 END AS symbols,
         CASE WHEN word_chars > 0 THEN 1000 * n_upper // word_chars ELSE 0 END AS upper_,
         CASE WHEN n_words > 0 THEN 1000 * n_repeat_words // n_words ELSE 0 END AS repeats,
         CASE WHEN n_lines > 0 THEN 1000 * n_dup_lines // n_lines ELSE 0 END AS dup_lines,
         CASE WHEN word_chars > 0 THEN 1000 * n_words // word_chars ELSE 0 END AS density
  FROM m
), long AS (
  SELECT lang, source, unnest(['symbols', 'upper', 'repeats', 'dup_lines', 'density']) AS rule, unnest([symbols, upper_, repeats, dup_lines, density]) AS v
  FROM f WHERE NOT base_failed
), own AS (
  SELECT lang, source, rule, count(*) AS n, quantile_disc(v, 0.25) AS q1, quantile_disc(v, 0.75) AS q3 FROM long GROUP BY ALL
), wide AS (
  SELECT lang, rule, count(*) AS n, quantile_disc(v, 0.25) AS q1, quantile_disc(v, 0.75) AS q3 FROM long GROUP BY ALL
), whole AS (
  SELECT rule, quantile_disc(v, 0.25) AS q1, quantile_disc(v, 0.75) AS q3 FROM long GROUP BY ALL
), q AS (
  SELECT o.lang, o.source, o.rule,
         CASE WHEN o.n >= 100 THEN o.q1 WHEN w.n >= 100 THEN w.q1 ELSE a.q1 END AS q1,
         CASE WHEN o.n >= 100 THEN o.q3 WHEN w.n >= 100 THEN w.q3 ELSE a.q3 END AS q3
  FROM own o JOIN wide w ON o.lang IS NOT DISTINCT FROM w.lang AND o.rule = w.rule JOIN whole a ON a.rule = o.rule
), lim AS (
  SELECT lang, source, rule, q3 + 6 * greatest(q3 - q1, least) AS hi, CASE WHEN rule = 'density' THEN q1 - 6 * greatest(q3 - q1, least) ELSE -1 END AS lo
  FROM q JOIN (VALUES ('symbols', 5), ('upper', 10), ('repeats', 80), ('dup_lines', 100), ('density', 10)) AS s(name, least) ON name = rule
), bad AS (
  SELECT DISTINCT r FROM (
    SELECT r, lang, source, unnest(['symbols', 'upper', 'repeats', 'dup_lines', 'density']) AS rule, unnest([symbols, upper_, repeats, dup_lines, density]) AS v FROM f
  ) x JOIN lim ON x.lang IS NOT DISTINCT FROM lim.lang AND x.source IS NOT DISTINCT FROM lim.source AND x.rule = lim.rule
  WHERE v > hi OR v < lo
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND r NOT IN (SELECT r FROM bad) AS kept FROM f
"""

_URLS = r"""
WITH p AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), fits AS (
  SELECT page_id, host, path, rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC NULLS LAST) AS k
  FROM p LEFT JOIN (VALUES ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'), ('example.org/en/1', 'example.org', '/en/1', 'block'),
    ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')) AS v(rule, rhost, rpath, verdict)
    ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits WHERE k = 1
"""

# crc32 byte by byte from its table; letters of runs take one or two UTF-8 bytes
_VARIANTS = r"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce(range(8), lambda c, _: CASE WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) ORDER BY b) AS t FROM range(256) AS v(b)
), d AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS doc, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents WHERE text IS NOT NULL
), runs AS (
  SELECT doc, run, count(*) AS n FROM (SELECT doc, unnest(regexp_extract_all(t, '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM d) GROUP BY doc, run
), bytes AS (
  SELECT run, n, flatten(list_transform(string_split(doc || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [192 + unicode(c) // 64, 128 + unicode(c) % 64] END)) AS bs FROM runs
), hashed AS (
  SELECT run, n, xor(list_reduce(bs, lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295), 4294967295) AS h FROM bytes, crc
), typed AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM hashed
), w AS (
  SELECT word, sum(n)::BIGINT AS n FROM typed WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), cut AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1))::INT AS i FROM w)
), near AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b USING (i, rest) WHERE a.word <> b.word
  UNION SELECT c.word, w.word, w.n FROM cut c JOIN w ON w.word = c.rest
  UNION SELECT w.word, c.word, c.n FROM cut c JOIN w ON w.word = c.rest
), best AS (
  SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near COLLATE "C") AS near, max(near_n) AS near_n FROM near GROUP BY word
), f AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * w.n THEN near END AS form, CASE WHEN near_n >= 2 * w.n THEN near_n END AS form_n FROM w LEFT JOIN best USING (word)
), walk AS (
  SELECT word, word AS root, form AS next FROM f
  UNION ALL SELECT walk.word, walk.next, f.form FROM walk JOIN f ON f.word = walk.next
)
SELECT f.word, f.form, walk.root, f.n, f.n_near, f.form_n FROM f JOIN walk USING (word) WHERE walk.next IS NULL
"""

_AUDIT = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d
), smallest AS (
  SELECT t, min(doc_id) AS first FROM d GROUP BY t
), marks AS (
  SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id
), fails AS (
  SELECT part, quality = 1 AS good, toxic = 1 AS bad,
    CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END
    || CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN first < w.doc_id THEN 'E' ELSE '' END AS failed
  FROM w JOIN smallest USING (t) LEFT JOIN marks USING (doc_id)
), sums AS (
  SELECT part, failed, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (bad) AS bad FROM fails GROUP BY part, failed
), l(c) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')
), orders AS (
  SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM l a, l b, l c, l d, l e
  WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5
), steps AS (
  SELECT filter_order, k::INT AS step, substr(filter_order, k::INT, 1) AS own, substr(filter_order, 1, k::INT - 1) AS before FROM orders, range(1, 6) AS r(k)
), rows_ AS (
  SELECT part, filter_order, step, own, n, good, bad, failed = own AS alone, contains(failed, own) AS fails,
         len(list_intersect(string_split(failed, ''), string_split(before, ''))) > 0 AND before <> '' AS gone
  FROM sums, steps
), told AS (
  SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (fails AND NOT gone), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (fails AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (alone), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (fails AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(bad) FILTER (fails AND NOT gone), 0)::BIGINT AS toxic_lost
  FROM rows_ GROUP BY part, filter_order, step, own
)
SELECT * EXCLUDE (own), (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM told
"""

SQL = {"op3_quality_rules": _QUALITY, "op9_url_filters": _URLS, "op11_spelling_variants": _VARIANTS, "op12_filter_audit": _AUDIT}
