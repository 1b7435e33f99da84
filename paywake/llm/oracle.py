"""SQL of the registered queries that SQL can express, for DuckDB."""

from paywake.llm import secrets

#: op2: what the archives must give back for each page.
WARC = r"""
WITH sized AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes,
         sha256(coalesce(html, '')) AS payload_digest
  FROM pages),
first AS (
  SELECT payload_digest, min(page_id) AS first_id FROM sized WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM sized LEFT JOIN first USING (payload_digest)
"""

#: op9: dialogues by perspective, in parts of 64 messages with 8 before them and the first system message again.
PERSPECTIVES = r"""
WITH said AS (
  SELECT conv_id, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) AS no,
         count(*) OVER (PARTITION BY conv_id) AS size
  FROM conversations),
heads AS (
  SELECT conv_id, min(no) AS system_no FROM said WHERE speaker = 'system' GROUP BY conv_id),
parts AS (
  SELECT DISTINCT conv_id, unnest(range((size - 1) // 64 + 1)) AS part FROM said),
dealt AS (
  SELECT s.conv_id, p.part, s.no, s.speaker, s.text, s.no <= 64 * p.part AS again
  FROM parts p JOIN said s ON s.conv_id IS NOT DISTINCT FROM p.conv_id
  LEFT JOIN heads h ON h.conv_id IS NOT DISTINCT FROM p.conv_id
  WHERE (s.no > 64 * p.part - 8 AND s.no <= 64 * (p.part + 1)) OR (s.no = h.system_no AND s.no <= 64 * p.part)),
sides AS (
  SELECT DISTINCT conv_id, speaker AS perspective FROM said WHERE speaker <> 'system'),
every AS (
  SELECT dealt.*, sides.perspective, speaker = perspective AND NOT again AS trained,
         CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker = 'system' THEN 'system' ELSE 'user' END AS role
  FROM dealt LEFT JOIN sides ON dealt.conv_id IS NOT DISTINCT FROM sides.conv_id),
written AS (
  SELECT *, '<|start|>' || role || CASE WHEN role = 'user' THEN ' name=' || speaker ELSE '' END || chr(10) AS header
  FROM every),
placed AS (
  SELECT *, header || text || '<|end|>' || chr(10) AS rendered,
         sum(length(header || text || '<|end|>' || chr(10))) OVER (
           PARTITION BY conv_id, perspective, part ORDER BY no ROWS UNBOUNDED PRECEDING) AS upto
  FROM written)
SELECT conv_id, perspective, part, count(*) AS n_messages,
       string_agg(rendered, '' ORDER BY upto) AS rendered,
       coalesce(string_agg(CAST(upto - length(rendered) + length(header) AS VARCHAR) || ':' || CAST(upto AS VARCHAR), ','
                           ORDER BY upto) FILTER (WHERE trained), '') AS mask
FROM placed GROUP BY conv_id, perspective, part
"""

#: op5: windows of ten words, looked up at every word of every document.
DECONTAMINATION = r"""
WITH words AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, array_to_string(w[k + 1 : k + 10], ' ') AS phrase, least(len(w), 10) AS length
  FROM words, unnest(range(greatest(1, len(w) - 9))) AS u(k) WHERE len(w) > 0),
texts AS (
  SELECT row_number() OVER () AS n, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
places AS (
  SELECT n, k, length, array_to_string(w[k + 1 : k + length], ' ') AS phrase
  FROM texts, (SELECT DISTINCT length FROM windows) AS l, unnest(range(len(w) - length + 1)) AS u(k)
  WHERE len(w) >= length),
found AS (
  SELECT n, k, places.length, item_id FROM places JOIN windows USING (phrase, length)),
hit AS (
  SELECT n, count(DISTINCT k + j) AS n_hit FROM found, unnest(range(length)) AS u(j) GROUP BY n),
items AS (
  SELECT n, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT n, CAST(item_id AS VARCHAR) AS item FROM found WHERE item_id IS NOT NULL) GROUP BY n)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM texts LEFT JOIN hit USING (n) LEFT JOIN items USING (n)
"""

#: op13: every kept term at every group, and every two groups of a language.
DIVERGENCE = r"""
WITH texts AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
said AS (
  SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM texts),
kept AS (
  SELECT lang, term, count(*) AS total FROM said GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
langs AS (
  SELECT lang, count(*) AS kinds, sum(total)::HUGEINT AS all_n FROM kept GROUP BY lang),
sides AS (
  SELECT DISTINCT lang, source FROM texts),
counted AS (
  SELECT lang, source, term, count(*) AS n FROM said SEMI JOIN kept USING (lang, term) GROUP BY ALL),
sized AS (
  SELECT sides.lang, sides.source, coalesce(sum(n), 0)::HUGEINT AS group_n
  FROM sides LEFT JOIN counted USING (lang, source) GROUP BY ALL),
shares AS (
  SELECT lang, source, term, coalesce(n, 0) AS n,
         1 + 1000000000 * (coalesce(n, 0) + 1) // (group_n + kinds) AS p,
         1 + 1000000000 * (total::HUGEINT + 1) // (all_n + kinds) AS q
  FROM sized JOIN kept USING (lang) JOIN langs USING (lang) LEFT JOIN counted USING (lang, source, term)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM sides a JOIN sides b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM shares WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS place FROM every)
SELECT lang, source, part, item, value, place::INTEGER AS rank FROM ranked WHERE part = 'pair' OR place <= 200
"""


def _secrets() -> str:
    """op12: matches and what stands between them, by kind; owners of each value."""
    quoted = {kind: "'" + pattern.replace("'", "''") + "'" for kind, pattern in secrets.PATTERNS.items()}
    proposed = " UNION ALL ".join(
        f"SELECT r, doc_id, source, {no} AS kind_no, '{kind}' AS kind, regexp_extract_all(t, {p}) AS m, string_split_regex(t, {p}) AS s "
        f"FROM texts WHERE regexp_matches(t, {p})" for no, (kind, p) in enumerate(quoted.items()))
    return rf"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
proposed AS ({proposed}),
placed AS (
  SELECT r, doc_id, source, kind_no, kind, m[i] AS match,
         CASE WHEN kind_no = 0 THEN regexp_extract(m[i], {quoted["assign"]}, 2) ELSE m[i] END AS value,
         CAST(list_sum([length(x) for x in s[1:i]]) + coalesce(list_sum([length(x) for x in m[1:i - 1]]), 0) AS BIGINT) AS start
  FROM proposed, unnest(range(1, len(m) + 1)) AS u(i)),
spread AS (
  SELECT *, start + length(match) AS stop, len(list_distinct(regexp_extract_all(value, '.'))) AS characters FROM placed),
passed AS (
  SELECT * FROM spread
  WHERE CASE kind WHEN 'assign' THEN length(value) >= 6
                  WHEN 'random' THEN regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]')
                                     AND regexp_matches(value, '[0-9]') AND characters >= 16
                  ELSE true END),
held AS (
  SELECT value, count(DISTINCT coalesce(source, chr(1))) AS owners FROM passed GROUP BY value),
judged AS (
  SELECT *, owners <= {secrets.OWNERS} AND characters >= {secrets.SPREAD}
            AND NOT regexp_matches(lower(value), '{secrets.PLACEHOLDER}') AS live,
         kind || ':' || start || ':' || stop AS span
  FROM passed JOIN held USING (value)),
by_row AS (
  SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
         count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(span, ',' ORDER BY start, kind_no) FILTER (kind_no < 3) AS base,
         string_agg(span, ',' ORDER BY start, kind_no) FILTER (kind_no < 3 OR live) AS spans,
         count(*) FILTER (live) AS n_live, count(*) FILTER (owners > {secrets.OWNERS}) AS n_copied
  FROM judged GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
       coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied
FROM texts LEFT JOIN by_row USING (r)
"""


STATEMENTS = {
    "op2_warc": WARC,
    "op5_decontamination": DECONTAMINATION,
    "op9_perspectives": PERSPECTIVES,
    "op12_secrets": _secrets(),
    "op13_divergence": DIVERGENCE,
}
