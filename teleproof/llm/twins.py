"""SQL for the operators of this package that SQL can express."""

# Sets of words with the same prefix rule, by the frequency of each word among different sets, on whole tables.
LINES = r"""
WITH l AS (
  SELECT doc_id, text, unnest(range(len(string_split(text, chr(10))))) AS pos,
         unnest(list_transform(string_split(text, chr(10)), lambda x: list_sort(list_distinct(list_filter(string_split_regex(x, '[ \t\v\f\r]+'), lambda w: w <> ''))))) AS words
  FROM documents WHERE text IS NOT NULL),
c AS (SELECT words, len(words) AS n, row_number() OVER (ORDER BY min(struct_pack(doc_id, pos))) AS seq, min(struct_pack(doc_id, pos)) AS kept FROM l WHERE len(words) > 0 GROUP BY words),
t AS (SELECT seq, n, unnest(words) AS w FROM c),
f AS (SELECT w, count(*) AS m FROM t GROUP BY w),
p AS (SELECT seq, n, w FROM (SELECT seq, n, w, row_number() OVER (PARTITION BY seq ORDER BY m, w) AS k FROM t JOIN f USING (w)) WHERE k <= n - ceil(0.8 * n - 1e-9) + 1),
pairs AS (SELECT DISTINCT a.seq AS a, b.seq AS b FROM p a JOIN p b ON a.w = b.w AND b.seq < a.seq AND b.n >= 0.8 * a.n - 1e-9 AND a.n >= 0.8 * b.n - 1e-9),
sets AS (SELECT a, x.n + y.n AS sizes, len(list_intersect(x.words, y.words)) AS i FROM pairs JOIN c x ON x.seq = a JOIN c y ON y.seq = b),
alike AS (SELECT DISTINCT a FROM sets WHERE i / (sizes - i) >= 0.8),
g AS (SELECT l.doc_id, l.pos FROM l JOIN c ON l.words = c.words LEFT JOIN alike ON a = seq WHERE a IS NOT NULL OR struct_pack(doc_id := l.doc_id, pos := l.pos) <> c.kept),
r AS (SELECT doc_id, list_sort(list(pos)) AS gone FROM g GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(string_split(d.text, chr(10))), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  coalesce(array_to_string(gone, ','), '') AS removed,
  sha256(CASE WHEN gone IS NULL THEN d.text ELSE coalesce(array_to_string(list_transform(list_filter(range(len(string_split(d.text, chr(10)))),
    lambda k: NOT list_contains(gone, k)), lambda k: string_split(d.text, chr(10))[k + 1]), chr(10)), '') END) AS text_sha256
FROM documents d LEFT JOIN r USING (doc_id)
"""

# Whole tables; terms are maximal runs of ASCII letters, digits and all other characters, only A-Z lower-cased.
SEARCH = r"""
WITH fold AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS upper, 'abcdefghijklmnopqrstuvwxyz' AS lower, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+' AS term),
d AS (SELECT doc_id, regexp_extract_all(translate(text, upper, lower), term) AS ws FROM documents, fold WHERE text IS NOT NULL),
p AS (SELECT doc_id, w, count(*) AS tf FROM (SELECT doc_id, unnest(ws) AS w FROM d) GROUP BY ALL),
s AS (SELECT count(*) AS nd, CAST(sum(len(ws)) AS BIGINT) AS nt FROM d WHERE len(ws) > 0),
m AS (SELECT doc_id, 10 + (90 * len(ws) * nd) // nt AS m FROM d, s WHERE len(ws) > 0),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, upper, lower), term)) AS w FROM benchmark, fold),
f AS (SELECT w, CAST(floor(1000 * ln((2.0::DOUBLE * nd + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM p, s GROUP BY w, nd),
r AS (SELECT item_id, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM q JOIN f USING (w) JOIN p USING (w) JOIN m USING (doc_id) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS "rank", doc_id, score FROM r WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""

COLLOCATIONS = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\v\f\r]')) AS piece FROM documents),
t AS (SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS ws FROM pieces),
n AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM t GROUP BY lang),
g AS (SELECT lang, k, array_to_string(ws[i : i + k - 1], ' ') AS phrase FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM t, (VALUES (1), (2), (3), (4)) v(k))),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
cuts AS (SELECT lang, phrase, a, array_to_string(ws[1 : j], ' ') AS fst, array_to_string(ws[j + 1 :], ' ') AS rest, j FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
scored AS (SELECT c.lang, c.phrase, a, x.f AS l, y.f AS r, j, CAST((2000000::HUGEINT * a) // (x.f + y.f) AS BIGINT) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.fst JOIN f y ON y.lang = c.lang AND y.phrase = c.rest),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
subs AS (SELECT lang, array_to_string(ws[i : i + size - 1], ' ') AS phrase, a FROM (SELECT *, unnest(range(1, k - size + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS size FROM c))),
wide AS (SELECT lang, phrase, max(a) AS longer FROM subs GROUP BY ALL),
kept AS (SELECT w.* FROM weakest w LEFT JOIN wide USING (lang, phrase) WHERE longer IS NULL OR 100::HUGEINT * longer < 80 * a)
SELECT lang, row_number() OVER o AS "rank", phrase, a, l, r, n, score FROM kept JOIN n USING (lang)
WINDOW o AS (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) QUALIFY row_number() OVER o <= 2000
"""
