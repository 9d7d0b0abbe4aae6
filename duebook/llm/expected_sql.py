"""DuckDB SQL for the queries that SQL can express."""

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

WORDS = (r"list_filter(string_split_regex(" + LOWER.format("coalesce(text, '')")
         + r", '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')")

OP5 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents),
i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {WORDS} AS w FROM benchmark),
g AS (SELECT DISTINCT item, least(len(w), 13) AS n,
             unnest(list_transform(range(1, len(w) - least(len(w), 13) + 2),
                    lambda k: array_to_string(w[k:k + least(len(w), 13) - 1], ' '))) AS gram
      FROM i WHERE len(w) > 0),
v AS (SELECT d.r, l.n, unnest(range(1, len(d.w) - l.n + 2)) AS k
      FROM d JOIN (SELECT DISTINCT n FROM g) l ON len(d.w) >= l.n),
h AS (SELECT v.r, v.n, v.k, g.item
      FROM v JOIN d ON d.r = v.r
             JOIN g ON g.n = v.n AND g.gram = array_to_string(d.w[v.k:v.k + v.n - 1], ' ')),
p AS (SELECT r, count(DISTINCT pos) AS n_hit
      FROM (SELECT r, unnest(range(k, k + n)) AS pos FROM h) GROUP BY r),
q AS (SELECT r, count(DISTINCT item) AS n_items,
             string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words,
       CAST(coalesce(p.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(q.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(q.items, '')) AS items_sha256,
       coalesce(p.n_hit, 0) > 0 AND 20 * coalesce(p.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN p USING (r) LEFT JOIN q USING (r)
"""

OP6 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
s AS (SELECT html, max(page_id) AS last FROM p WHERE strlen(html) >= 1000
      GROUP BY html HAVING count(*) > 1)
SELECT p.page_id, CAST(strlen(p.html) AS BIGINT) AS payload_bytes, sha1(p.html) AS payload_digest,
       CASE WHEN s.last IS NULL OR s.last IS NOT DISTINCT FROM p.page_id
            THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN s.last IS DISTINCT FROM p.page_id THEN s.last END AS refers_to
FROM p LEFT JOIN s ON s.html = p.html
"""

OP10 = f"""
WITH l AS (SELECT r, doc_id, unnest(range(1, len(parts) + 1)) AS pos, unnest(parts) AS line
           FROM (SELECT row_number() OVER () AS r, doc_id,
                        string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)),
k AS (SELECT *, {LOWER.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")}
             AS key FROM l),
s AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20
      GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, s.last IS NOT NULL AND s.last <> k.doc_id AS dropped
      FROM k LEFT JOIN s ON s.key = k.key)
SELECT any_value(doc_id) AS doc_id, CAST(count(*) AS BIGINT) AS n_lines,
       CAST(count(*) FILTER (WHERE dropped) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), ''))
           AS kept_sha256
FROM m GROUP BY r
"""

OP12 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(
               coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
v AS (SELECT r, doc_id, unnest(range(1, len(w) - 18)) AS k FROM d WHERE len(w) >= 20),
s AS (SELECT r, k, row_number() OVER (PARTITION BY gram ORDER BY doc_id, k) > 1 AS again
      FROM (SELECT v.r, v.doc_id, v.k, array_to_string(d.w[v.k:v.k + 19], ' ') AS gram
            FROM v JOIN d ON d.r = v.r)),
g AS (SELECT DISTINCT r, unnest(range(k, k + 20)) AS pos FROM s WHERE again),
p AS (SELECT r, unnest(range(1, len(w) + 1)) AS pos, unnest(w) AS word FROM d),
q AS (SELECT p.r, count(g.pos) AS n_removed,
             string_agg(p.word, ' ' ORDER BY p.pos) FILTER (WHERE g.pos IS NULL) AS kept
      FROM p LEFT JOIN g ON g.r = p.r AND g.pos = p.pos GROUP BY p.r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words,
       CAST(coalesce(q.n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(q.kept, '')) AS kept_sha256
FROM d LEFT JOIN q USING (r)
"""

OP13 = r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(LOWER_TEXT,
               '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'),
                               lambda x: x <> '') AS w FROM t),
m AS (SELECT lang, w, unnest([1, 2, 3, 4]) AS size FROM w),
o AS (SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2),
             lambda k: array_to_string(w[k:k + size - 1], ' '))) AS phrase
      FROM m WHERE len(w) >= size),
c AS (SELECT lang, size, phrase, count(*) AS f FROM o GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM c WHERE size = 1 GROUP BY lang),
a AS (SELECT lang, size, phrase, string_split(phrase, ' ') AS w, f FROM c
      WHERE size >= 2 AND f >= 30),
x AS (SELECT lang, f, w, size, unnest(range(2, size)) AS part FROM a WHERE size > 2),
y AS (SELECT lang, f, unnest(list_transform(range(1, size - part + 2),
             lambda k: array_to_string(w[k:k + part - 1], ' '))) AS phrase FROM x),
z AS (SELECT lang, phrase, max(f) AS longer FROM y GROUP BY ALL),
k AS (SELECT a.*, unnest(range(1, a.size)) AS k FROM a LEFT JOIN z USING (lang, phrase)
      WHERE z.longer IS NULL OR 100 * z.longer < 80 * a.f),
s AS (SELECT k.lang, k.phrase, k.f AS a, l.f AS l, r.f AS r, k.k,
             CAST(2000000 * CAST(k.f AS HUGEINT) // (l.f + r.f) AS BIGINT) AS score
      FROM k JOIN c l ON l.lang = k.lang AND l.phrase = array_to_string(k.w[1:k.k], ' ')
             JOIN c r ON r.lang = k.lang AND r.phrase = array_to_string(k.w[k.k + 1:], ' ')),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS pick FROM s),
e AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
      FROM b WHERE pick = 1)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, a, l, r, CAST(n.n AS BIGINT) AS n, score
FROM e JOIN n USING (lang) WHERE rank <= 2000
""".replace("LOWER_TEXT", LOWER.format("coalesce(text, '')"))

EXPECTED = {"op5_decontaminate": OP5, "op6_warc": OP6, "op10_lines": OP10, "op12_spans": OP12,
            "op13_collocations": OP13}
