"""DuckDB SQL that gives the same rows as the queries of the same name."""

QUALITY_RULES = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, source, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
win AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
lines AS (SELECT DISTINCT coalesce(source, chr(0)) AS host, t, lower(trim(regexp_replace(u, '[\x20\x09-\x0D]+', ' ', 'g'))) AS line
          FROM (SELECT source, t, unnest(l) AS u FROM w)),
hosts AS (SELECT coalesce(source, chr(0)) AS host, count(DISTINCT t) AS n FROM w GROUP BY 1),
common AS (SELECT host, line FROM (SELECT host, line, count(*) AS docs FROM lines GROUP BY ALL) JOIN hosts USING (host)
           WHERE docs > greatest(5::DOUBLE, least(100::DOUBLE, 0.02::DOUBLE * n))),
gone AS (SELECT doc_id, sum(len(regexp_extract_all(u, '[^\x20\x09-\x0D]+'))) AS n
         FROM (SELECT doc_id, coalesce(source, chr(0)) AS host, unnest(l) AS u FROM w) AS x
         JOIN common AS c ON c.host = x.host AND c.line = lower(trim(regexp_replace(x.u, '[\x20\x09-\x0D]+', ' ', 'g')))
         GROUP BY doc_id),
f AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
             len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
             coalesce(covered.n, 0)::BIGINT AS n_repeat_words, coalesce(gone.n, 0)::BIGINT AS words_removed
      FROM w LEFT JOIN covered USING (doc_id) LEFT JOIN gone USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT *, NOT base_failed AND n_words - words_removed >= 0.5::DOUBLE * n_words AS kept FROM b
"""

LINE_DEDUP = r"""
WITH l AS (SELECT doc_id, text, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS line FROM documents),
n AS (SELECT doc_id, i, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS s,
             row_number() OVER (PARTITION BY doc_id ORDER BY i) AS p
      FROM l WHERE trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) <> ''),
w AS (SELECT a.doc_id, a.p, a.s || chr(10) || b.s || chr(10) || c.s AS g
      FROM n AS a JOIN n AS b ON b.doc_id = a.doc_id AND b.p = a.p + 1 JOIN n AS c ON c.doc_id = a.doc_id AND c.p = a.p + 2),
later AS (SELECT doc_id, p FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id, p) AS k FROM w) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, p + k AS p FROM later, (SELECT unnest([0, 1, 2]) AS k)),
lost AS (SELECT n.doc_id, n.i FROM n JOIN gone USING (doc_id, p)),
kept AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.i) AS text FROM l ANTI JOIN lost ON lost.doc_id = l.doc_id AND lost.i = l.i GROUP BY l.doc_id),
counts AS (SELECT doc_id, count(*) AS dedup_lines FROM n GROUP BY doc_id),
removed AS (SELECT doc_id, count(*) AS dedup_removed FROM gone GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text,
       coalesce(dedup_lines, 0)::BIGINT AS dedup_lines, coalesce(dedup_removed, 0)::BIGINT AS dedup_removed
FROM documents AS d LEFT JOIN kept USING (doc_id) LEFT JOIN counts USING (doc_id) LEFT JOIN removed USING (doc_id)
"""
