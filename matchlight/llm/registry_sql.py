"""DuckDB SQL of the text operators that SQL can express."""

from __future__ import annotations

OP4 = r"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents
), g AS (
  SELECT doc_id, i, list_slice(ws, i, i + 7) AS win
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)
), hit AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM g) WHERE n > 1
), rep AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM hit) GROUP BY doc_id
), m AS (
  SELECT w.doc_id, source, len(ws)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(list_filter(ws, lambda x, i: i > 1 AND x = ws[i - 1])) AS n_stutter
  FROM w LEFT JOIN rep ON w.doc_id = rep.doc_id
), j AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
         n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 4 * n_symbols > n_words OR 100 * n_stutter > 30 * n_words AS failed
  FROM m
), h AS (
  SELECT source, count(*) AS n, sum(failed::INT) AS f FROM j GROUP BY source
), p AS (
  SELECT m, CASE WHEN v > 0 THEN greatest(m * (1 - m) / v - 1, 0.001) ELSE 100.0 END AS k
  FROM (SELECT avg(f / n) AS m, var_pop(f / n) AS v FROM h)
), bad AS (
  SELECT source, (f + m * k) / (n + m * k + (1 - m) * k) >= 0.5 AS bad FROM h, p
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT failed AND NOT bad AS kept
FROM j JOIN bad ON j.source IS NOT DISTINCT FROM bad.source
"""

OP6 = r"""
WITH l AS (
  SELECT doc_id, i - 1 AS place, ls[i] AS line
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL))
), t AS (
  SELECT doc_id, place, line, list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS raw
  FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), m AS (
  SELECT *, list_transform(raw, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS masked FROM t
), k AS (
  SELECT doc_id, place, unnest(CASE
    WHEN 2 * len(list_filter(masked, lambda x: x = '<*>')) > len(masked) THEN [to_json(['line', to_json(raw)::VARCHAR])::VARCHAR]
    WHEN len(masked) < 8 THEN [to_json(['short', to_json(masked)::VARCHAR])::VARCHAR]
    ELSE [@KEYS] END) AS template
  FROM m
), r AS (
  SELECT template, min((doc_id, place)) AS first_at FROM k GROUP BY template HAVING count(DISTINCT doc_id) >= 5
), d AS (
  SELECT DISTINCT doc_id, place FROM k JOIN r USING (template) WHERE (doc_id, place) <> first_at
), n AS (
  SELECT doc_id, count(*) AS n_lines FROM t GROUP BY doc_id
), kept AS (
  SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.place) AS txt
  FROM l LEFT JOIN d ON l.doc_id = d.doc_id AND l.place = d.place WHERE d.place IS NULL GROUP BY l.doc_id
), c AS (
  SELECT doc_id, count(*) AS n_dropped FROM d GROUP BY doc_id
)
SELECT documents.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dropped, 0)::BIGINT AS n_dropped, sha256(coalesce(txt, '')) AS kept_sha256
FROM documents LEFT JOIN n ON n.doc_id = documents.doc_id LEFT JOIN c ON c.doc_id = documents.doc_id LEFT JOIN kept ON kept.doc_id = documents.doc_id
"""

OP6 = OP6.replace(
    "@KEYS",
    ", ".join(
        f"to_json(['{a}{b}', len(masked)::VARCHAR, to_json(masked[1:1])::VARCHAR, to_json(list_filter(masked, lambda x, i: (i - 1) % 4 IN ({a}, {b})))::VARCHAR])::VARCHAR"
        for a in range(4) for b in range(a + 1, 4)
    ),
)

OP7 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, list_slice(ws, i, i + 4) AS sh FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 9 * c >= 4 * (na.n + nb.n)
), r AS (
  SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node
), k AS (
  SELECT a, count(*) AS n_links FROM l GROUP BY a
)
SELECT node AS doc_id, min(root) AS class_id, coalesce(any_value(n_links), 0)::BIGINT AS n_links FROM r LEFT JOIN k ON k.a = r.node GROUP BY node
"""

OP10 = r"""
WITH t AS (
  SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents
), g AS (
  SELECT doc_id, i, array_slice(b, i, i + 99) AS win FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - 98)) AS i FROM t WHERE octet_length(b) >= 100)
), m AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS r FROM g) WHERE r > 1
), o AS (
  SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS new FROM m
), k AS (
  SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM o
), runs AS (
  SELECT doc_id, run, min(i) AS a, max(i) + 99 AS z FROM k GROUP BY doc_id, run
), gaps AS (
  SELECT doc_id, a, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) + 1 AS s, a - 1 AS e FROM runs
  UNION ALL SELECT doc_id, 4000000000, max(z) + 1, 4000000000 FROM runs GROUP BY doc_id
), kept AS (
  SELECT gaps.doc_id, string_agg(CASE WHEN e < s OR s > octet_length(b) THEN '' ELSE hex(array_slice(b, s, least(e, octet_length(b)))) END, '' ORDER BY a) AS h FROM gaps JOIN t ON t.doc_id = gaps.doc_id GROUP BY gaps.doc_id
), c AS (
  SELECT doc_id, sum(z - a + 1) AS n_removed, count(*) AS n_spans FROM runs GROUP BY doc_id
)
SELECT t.doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, CASE WHEN h IS NULL THEN sha256(b) ELSE sha256(unhex(h)) END AS kept_sha256
FROM t LEFT JOIN c ON c.doc_id = t.doc_id LEFT JOIN kept ON kept.doc_id = t.doc_id
"""
