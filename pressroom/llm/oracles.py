"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from .quality import BOILERPLATE, ENDING

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACED = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _lower(c: str) -> str:
    return f"translate({c}, '{_UP}', '{_LOW}')"


NEAR_DEDUP = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_lower("coalesce(text, '')")}, '{_SPACED}') AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
e AS (SELECT x AS u, y AS v FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS m FROM w UNION SELECT r.doc_id, e.v FROM r JOIN e ON e.u = r.m)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c.m AS component_id, w.doc_id = c.m AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(m) AS m FROM r GROUP BY doc_id) c USING (doc_id)
"""

_LINE_SYMBOLS = "length(line) - length(regexp_replace(line, '[#*$%&|<>]', '', 'g'))"
_SEPARATORS = "(length(line) - length(regexp_replace(line, '[|»›•·>]', '', 'g')))"
_SPACES = "(length(trim(line)) - length(replace(trim(line), ' ', '')))"
_QUOTED_END = ENDING.replace("'", "''")

QUALITY = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_SPACED}') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win), range(0, 8) AS t(j) WHERE c > 1 GROUP BY doc_id),
li AS (SELECT doc_id, line, len(regexp_extract_all(line, '{_SPACED}')) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)),
ju AS (SELECT *, n > 0 AND (({_LINE_SYMBOLS}) * 10 > length(regexp_replace(line, '[\\x20\\x09-\\x0D]+', '', 'g'))
  OR len(regexp_extract_all(line, '\\S!!(?:\\s|$)')) * 3 > {_SPACES} + 1
  OR (NOT regexp_matches(line, '{_QUOTED_END}') AND {_SPACES} >= 3 AND NOT regexp_matches(line, '[.!?,;:]\\s'))
  OR ({_SEPARATORS} >= 3 AND {_SEPARATORS} * 5 > {_SPACES})
  OR (regexp_matches(lower(line), '{BOILERPLATE}') AND {_SPACES} < 25)) AS fails FROM li),
lo AS (SELECT doc_id, count_if(n > 0) - count(DISTINCT CASE WHEN n > 0 THEN line END) AS dup, count_if(fails) AS removed, CAST(coalesce(sum(CASE WHEN fails THEN n END), 0) AS BIGINT) AS lost FROM ju GROUP BY doc_id),
m AS (SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, dup AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, removed AS lines_removed, lost AS words_lost FROM d JOIN lo USING (doc_id) LEFT JOIN rep USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND words_lost <= n_words * 0.5 AS kept, lines_removed, words_lost FROM m
"""

DECONTAMINATE = f"""
WITH b AS (SELECT item_id, regexp_extract_all({_lower("coalesce(text, '')")}, '{_ALNUM}') AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, regexp_extract_all({_lower("coalesce(text, '')")}, '{_ALNUM}') AS w FROM documents),
dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)),
h AS (SELECT doc_id, item_id, i, k FROM dw JOIN bw USING (k, g)),
c AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM h, range(0, 10) AS t(j) WHERE j < k GROUP BY doc_id),
q AS (SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(c.n, 0) AS n_hit, coalesce(q.n, 0) AS n_items, sha256(coalesce(q.s, '')) AS items_sha256, c.n IS NOT NULL AS contaminated FROM d LEFT JOIN c USING (doc_id) LEFT JOIN q USING (doc_id)
"""

SUBSTRING_DEDUP = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_SPACED}') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
gone AS (SELECT DISTINCT doc_id, i + j AS i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS f FROM win), range(0, 13) AS t(j) WHERE f < doc_id),
x AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
k AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS t FROM x ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(k.n, 0) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""

_BITS = " + ".join(f"CAST(substr(bits, 5 * i + {j + 1}, 1) AS INTEGER) * {16 >> j}" for j in range(5))
WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
g AS (SELECT html, max(page_id) AS kept FROM p GROUP BY html),
b AS (SELECT page_id, html, CAST(CAST(from_hex(sha1(html)) AS BIT) AS VARCHAR) AS bits FROM p)
SELECT page_id, octet_length(encode(html)) AS payload_bytes, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + {_BITS}, 1) for i in range(0, 32)], '') AS payload_digest, CASE WHEN page_id = kept THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> kept THEN kept END AS refers_to FROM b JOIN g USING (html)
"""

# The pages of the tables have one article of headings and paragraphs each, and nothing beside it that is to be kept.
HTML_TEXT = r"""
WITH a AS (SELECT page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's'), '[\s\p{Z}]+', ' ', 'g') AS x FROM pages),
b AS (SELECT page_id, url, string_split(regexp_replace(regexp_replace(regexp_replace(x, '</?(?:h1|p)>', chr(10), 'g'), '<br>', ' ', 'g'), '<[^>]+>', '', 'g'), chr(10)) AS l FROM a),
t AS (SELECT page_id, url, array_to_string([y for y in [trim(regexp_replace(replace(replace(replace(replace(z, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), ' +', ' ', 'g')) for z in l] if y <> ''], chr(10)) AS text FROM b)
SELECT page_id, url, text, length(text) AS n_chars FROM t
"""

ORACLE_SQL = {
    "op10_html_text": HTML_TEXT,
    "op1_near_dedup": NEAR_DEDUP,
    "op2_quality": QUALITY,
    "op3_decontaminate": DECONTAMINATE,
    "op6_substring_dedup": SUBSTRING_DEDUP,
    "op9_warc": WARC,
}
