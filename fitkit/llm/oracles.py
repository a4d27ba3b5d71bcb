"""SQL twins of the corpus queries that DuckDB can express."""

from __future__ import annotations

OP3 = r"""
WITH base AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), words AS (
  SELECT rid, doc_id, t,
    list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM base
), windows AS (
  SELECT rid, i, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM words WHERE len(w) >= 5)
), twice AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT rid, count(DISTINCT i + k) AS n
  FROM (SELECT rid, i, unnest(range(0, 5)) AS k FROM twice) GROUP BY rid
), m AS (
  SELECT words.doc_id, len(w)::BIGINT AS n_words,
    length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
    coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
    len(l)::BIGINT AS n_lines,
    (length(t) - length(regexp_replace(t, '[0-9]', '', 'g')))::BIGINT AS n_digits
  FROM words LEFT JOIN covered USING (rid)
), f AS (
  SELECT *,
    (CASE WHEN n_words < 10 THEN 1 ELSE 0 END
      + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
      + CASE WHEN 10 * n_symbols > word_chars THEN 4 ELSE 0 END
      + CASE WHEN n_lines >= 4 AND 10 * n_dup_lines > 3 * n_lines THEN 8 ELSE 0 END
      + CASE WHEN 2 * n_words > word_chars THEN 16 ELSE 0 END
      + CASE WHEN word_chars > 16 * n_words THEN 32 ELSE 0 END
      + CASE WHEN 5 * n_digits > word_chars THEN 64 ELSE 0 END)::BIGINT AS failed
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  failed & 3 <> 0 AS base_failed, failed & 15 = 0 AS kept, failed
FROM f
"""

OP12 = r"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), w AS (SELECT lang, source, unnest(terms) AS term FROM d),
f AS (
  SELECT lang, term FROM (SELECT lang, unnest(list_distinct(terms)) AS term FROM d)
  GROUP BY lang, term HAVING count(*) >= 30
), c AS (SELECT w.lang, source, term, count(*) AS c FROM w JOIN f USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v FROM f GROUP BY lang),
every AS (
  SELECT g.lang, g.source, f.term, coalesce(c.c, 0)::HUGEINT AS c, v.v,
    sum(coalesce(c.c, 0)) OVER (PARTITION BY g.lang, g.source)::HUGEINT AS n
  FROM g JOIN f USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = f.term
), p AS (SELECT lang, source, term, c, 1 + (1000000000 * (c + 5)) // (n + 5 * v) AS p FROM every),
q AS (
  SELECT lang, term, 1 + (1000000000 * (c + 5)) // (n + 5 * v) AS q
  FROM (SELECT lang, term, c, v, sum(c) OVER (PARTITION BY lang) AS n
    FROM (SELECT lang, term, sum(c)::HUGEINT AS c, any_value(v) AS v FROM every GROUP BY lang, term))
), pair AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value
    FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
  ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), scored AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pair
  UNION ALL
  SELECT lang, source, 'term', term, p - q FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q
)
SELECT lang, source, part, item, value::BIGINT AS value,
  row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
FROM scored
QUALIFY part = 'pair' OR rank <= 50
"""

OP13 = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), size AS (SELECT rid, doc_id, len(terms)::BIGINT AS n FROM d WHERE len(terms) > 0),
total AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS ll FROM size),
uses AS (SELECT rid, term, count(*)::BIGINT AS tf FROM (SELECT rid, unnest(terms) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*)::BIGINT AS df FROM uses GROUP BY term),
asked AS (
  SELECT DISTINCT iid, item_id, term FROM (
    SELECT row_number() OVER () AS iid, item_id, unnest(
      regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
), weighed AS (
  SELECT iid, item_id, term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
  FROM asked JOIN df USING (term), total
), m AS (SELECT rid, doc_id, 10 + (90::HUGEINT * n * nn) // ll AS m FROM size, total),
scored AS (
  SELECT iid, item_id, rid, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM weighed JOIN uses USING (term) JOIN m USING (rid) GROUP BY ALL
)
SELECT item_id, row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id, rid)::INTEGER AS rank, doc_id, score
FROM scored WHERE score > 0
QUALIFY rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_quality_rules": OP3, "op12_source_audit": OP12, "op13_lexical_search": OP13}
