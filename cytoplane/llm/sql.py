"""DuckDB forms of the queries that SQL can express, worded apart from the operators."""

from __future__ import annotations

from cytoplane.llm.quality import LISTED, LISTED_RULES, NOT_KNOWN, RULES, STOP_RATIO, STOP_WORDS

_STOPS = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))


def _rule(r) -> str:
    unit = r.denominator or "1"
    tests = []
    if r.low is not None:
        tests.append(f"1000 * {r.numerator} >= {r.low} * {unit}")
    if r.high is not None:
        tests.append(f"1000 * {r.numerator} <= {r.high} * {unit}")
    if r.name in LISTED_RULES:  # only of languages whose stop words are listed
        return f"NOT listed OR ({' AND '.join(tests)})"
    return " AND ".join(tests)


_LANGS = ", ".join(f"'{x}'" for x in (*LISTED, *NOT_KNOWN))

QUALITY = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
         coalesce(regexp_extract(lower(lang), '^[^-_]*') IN ({_LANGS}), true) AS has_list FROM documents
), s AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d
), win AS (
  SELECT rid, i, array_to_string(ws[i : i + 7], ' ') AS k
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM s)
), twice AS (
  SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, k) > 1
), cover AS (
  SELECT rid, sum(n) AS n_repeat_words
  FROM (SELECT rid, least(8, i - coalesce(lag(i) OVER (PARTITION BY rid ORDER BY i), i - 8)) AS n FROM twice)
  GROUP BY rid
), m AS (
  SELECT doc_id, len(ws) AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words,
         len(list_distinct(list_filter(list_transform(ws, lambda x: lower(x)), lambda x: x IN ({_STOPS})))) AS n_stop,
         len(list_filter(ws, lambda x: lower(x) IN ({_STOPS}))) AS n_stop_words,
         has_list AND 2 * len(list_filter(ws, lambda x: regexp_matches(x, '^\P{{L}}*\p{{Latin}}'))) >= len(list_filter(ws, lambda x: regexp_matches(x, '\p{{L}}'))) AS listed,
         len(list_filter(ws, lambda x: regexp_matches(x, '\p{{L}}'))) AS n_letter_words,
         len(list_filter(ws, lambda x: regexp_matches(x, '^\P{{L}}*\p{{Lu}}{{2}}') AND x = upper(x))) AS n_capital_words,
         len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…)\s*$'))) AS n_ellipsis_lines,
         len(list_filter(ls, lambda x: regexp_matches(x, '^\s*[-*•‣·]'))) AS n_bullet_lines
  FROM s LEFT JOIN cover USING (rid)
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND {" AND ".join(f"({_rule(r)})" for r in (*RULES, STOP_RATIO))} AS kept
FROM m
"""

MIXING = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [3, 1, 2][1 + (row_number() OVER (ORDER BY source IS NULL, encode(coalesce(source, ''))) - 1) % 3] AS w
  FROM d GROUP BY source
), ranked AS (
  SELECT *, sum(w) OVER f AS w_open, coalesce(sum(2 * source_size) OVER p, 0) AS full_before,
         1.5::DOUBLE * (SELECT sum(size) FROM d)::DOUBLE AS total
  FROM src
  WINDOW f AS (ORDER BY source_size::DOUBLE / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
         p AS (ORDER BY source_size::DOUBLE / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), full_ AS (
  SELECT *, w * (total - full_before) / w_open > 2 * source_size AS above FROM ranked
), open_ AS (
  SELECT sum(w) FILTER (NOT above) AS w_open, coalesce(sum(2 * source_size) FILTER (above), 0)::DOUBLE AS spent FROM full_
), t AS (
  SELECT source, source_size,
         CASE WHEN above THEN (2 * source_size)::DOUBLE ELSE w * (total - spent) / open_.w_open END AS target
  FROM full_, open_
), q AS (
  SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS quota FROM t
), o AS (
  SELECT d.*, source_size, target, quota,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY md5('0:' || coalesce(doc_id::VARCHAR, '')), doc_id, size
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source
)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 0
                 ELSE (quota // source_size) * size + greatest(least(quota % source_size - before, size), 0) END AS BIGINT) AS taken
FROM o
"""

_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(('0x' || substr(h, {1 + 5 * g}, 5))::BIGINT >> {s} & 31 AS INTEGER), 1)"
    for g in range(8)
    for s in (15, 10, 5, 0)
)

WARC = f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM p
)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM f
"""

# the article element, cut at its block tags; holds for pages whose article has no other markup than these
HTML_TEXT = r"""
WITH a AS (
  SELECT page_id, url, regexp_extract(regexp_replace(coalesce(html, ''), '\s+', ' ', 'g'), '<article>(.*?)(</article>|$)', 1) AS x FROM pages
), b AS (
  SELECT page_id, url, regexp_replace(regexp_replace(x, '</?(p|h1|br)>', chr(10), 'g'), '<[^>]*(>|$)', '', 'g') AS x FROM a
), c AS (
  SELECT page_id, url, replace(replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'),
                       '&copy;', '©'), '&middot;', '·'), '&amp;', '&') AS x FROM b
), t AS (
  SELECT page_id, url,
         array_to_string(list_filter(list_transform(string_split(x, chr(10)), lambda l: trim(l)), lambda l: l <> ''), chr(10)) AS text
  FROM c
)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM t
"""

DIVERGENCE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT rid, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
  FROM d
), c AS (
  SELECT lang, source, term, count(*) AS n, count(DISTINCT rid) AS docs FROM w GROUP BY ALL
), kept AS (
  SELECT lang, term, CAST(sum(n) AS HUGEINT) AS n FROM c GROUP BY ALL HAVING sum(docs) >= 10
), langs AS (
  SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY ALL
), g AS (
  SELECT DISTINCT lang, source FROM d
), each AS (
  SELECT g.lang, g.source, kept.term, kept.n AS lang_n, CAST(coalesce(c.n, 0) AS HUGEINT) AS n
  FROM g JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)
), totals AS (
  SELECT lang, source, sum(n) AS total FROM each GROUP BY ALL
), priced AS (
  SELECT each.lang, each.source, term, n,
         CAST(1 + (1000000000 * (n + 2)) // (totals.total + 2 * v) AS BIGINT) AS p,
         CAST(1 + (1000000000 * (lang_n + 2)) // (langs.total + 2 * v) AS BIGINT) AS q
  FROM each JOIN totals USING (lang, source) JOIN langs USING (lang)
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS BIGINT) AS value
  FROM priced a JOIN priced b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), every AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(pairs.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
), terms AS (
  SELECT lang, source, term AS item, (p - q) * (p - q) // (p + q) AS value FROM priced WHERE n > 0 AND p > q
), ranked AS (
  SELECT lang, source, 'pair' AS part, item, value FROM every UNION ALL SELECT lang, source, 'term', item, value FROM terms
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
       CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM ranked QUALIFY part = 'pair' OR rank <= 10
"""

ORACLES = {"op13_divergence": DIVERGENCE, "op3_mixing": MIXING, "op4_warc": WARC, "op8_quality": QUALITY, "op9_html_text": HTML_TEXT}
