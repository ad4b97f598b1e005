"""The same results as DuckDB SQL, written by plainer means."""

from tallyhouse.llm.common import LOWER, UPPER

_WORD = r"[^\x20\x09-\x0D]+"

# Every quotient is written out and ranked; the limit of a target is found by trying every number of full sources.
MIXING = f"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{_WORD}')), 0) AS size,
         md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS ticket
  FROM documents
), sums AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place
  FROM sized GROUP BY source
), weighed AS (
  SELECT *, [3, 1, 2][(place - 1) % 3 + 1] AS weight FROM sums
), levels AS (
  SELECT a.place,
         (SELECT (1.5 * (SELECT sum(source_size) FROM sums)
                  - coalesce(sum(2.0 * b.source_size) FILTER (2.0 * b.source_size / b.weight < 2.0 * a.source_size / a.weight), 0))
                 / sum(b.weight) FILTER (2.0 * b.source_size / b.weight >= 2.0 * a.source_size / a.weight)
          FROM weighed b) AS level,
         2.0 * a.source_size / a.weight AS edge
  FROM weighed a
), level AS (
  SELECT coalesce(arg_min(level, edge) FILTER (level < edge), 1e300) AS level FROM levels
), targets AS (
  SELECT source, place, source_size, least(2.0 * source_size, weight * (SELECT level FROM level)) AS target FROM weighed
), total AS (
  SELECT CAST(floor(1.5 * sum(source_size) / 64 + 0.5) AS BIGINT) AS seats FROM targets
), dealt AS (
  SELECT place, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, place, k) AS nth
  FROM (SELECT place, target, unnest(range(2 * ((source_size + 63) // 64))) AS k FROM targets WHERE target > 0)
), source_quota AS (
  SELECT t.*, count(d.place) AS quota, greatest(1, (any_value(source_size) + 65535) // 65536) AS shards
  FROM targets t LEFT JOIN (SELECT place FROM dealt WHERE nth <= (SELECT seats FROM total)) d USING (place)
  GROUP BY ALL
), placed AS (
  SELECT s.doc_id, s.size, s.ticket, q.*, CAST(('0x' || substr(ticket, 1, 8)) AS BIGINT) % q.shards AS shard
  FROM sized s JOIN source_quota q ON s.source IS NOT DISTINCT FROM q.source
), shard AS (
  SELECT place, shard, any_value(quota) AS source_quota, CAST(sum(size) AS BIGINT) AS z FROM placed GROUP BY ALL
), shard_dealt AS (
  SELECT place, shard, source_quota, row_number() OVER (PARTITION BY place ORDER BY z / (2 * k + 1) DESC, shard, k) AS nth
  FROM (SELECT *, unnest(range(2 * ((z + 63) // 64))) AS k FROM shard WHERE z > 0)
), shard_quota AS (
  SELECT s.place, s.shard, s.z, greatest(1, (s.z + 63) // 64) AS n, count(d.place) AS quota
  FROM shard s LEFT JOIN (SELECT * FROM shard_dealt WHERE nth <= source_quota) d
    ON s.place = d.place AND s.shard = d.shard GROUP BY ALL
), runs AS (
  SELECT place, shard, n, quota // n AS rounds, quota % n AS rest,
         CAST(('0x' || substr(md5('mix-1:' || place || ':' || shard), 1, 8)) AS BIGINT) % n AS first
  FROM shard_quota
), stream AS (
  SELECT p.*, r.n, r.rounds, r.rest, r.first,
         coalesce(sum(size) OVER (PARTITION BY place, shard ORDER BY ticket, doc_id NULLS FIRST, size
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begin_at
  FROM placed p JOIN runs r USING (place, shard)
), pieces AS (
  SELECT *, unnest([[first * 64, least(first + rest, n) * 64], [0, greatest(0, first + rest - n) * 64]]) AS run FROM stream
)
SELECT doc_id, size, source_size, target,
       CAST(any_value(rounds) * size + sum(greatest(0, least(begin_at + size, run[2]) - greatest(begin_at, run[1]))) AS BIGINT) AS taken
FROM pieces GROUP BY doc_id, size, source_size, target, begin_at, place, shard
"""

EXACT = f"""
WITH texts AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS text_sha256,
         translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS body
  FROM documents
)
SELECT doc_id, max(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY body) AS kept, text_sha256
FROM texts
"""

RULES = rf"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS words FROM documents
), line AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM texts)
  WHERE regexp_matches(line, '{_WORD}') GROUP BY doc_id
), windows AS (
  SELECT doc_id, i, array_to_string(words[i : i + 7], ' ') AS win
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM texts)
), again AS (
  SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1
), repeated AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM again, range(8) r(k) GROUP BY doc_id
), figures AS (
  SELECT t.doc_id, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(length(regexp_replace(text, '[^\p{{Lu}}]', '', 'g')) AS BIGINT) AS n_capitals,
         coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM texts t LEFT JOIN line USING (doc_id) LEFT JOIN repeated USING (doc_id)
), judged AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM figures
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR 2 * n_capitals > word_chars
            OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 2 * n_dup_lines > n_lines) AS kept
FROM judged
"""

# Trust and distrust by a recursion of 100 rounds; what is left after them is below 1e-7 of a score.
_SLASHED = "split_part(split_part(substr(url, strpos(url, '://') + 3), '?', 1), '#', 1)"
URLS = f"""
WITH RECURSIVE parsed AS (
  SELECT page_id, html, strpos(url, '://') > 0 AS whole, {_SLASHED} AS rest FROM pages
), parts AS (
  SELECT page_id, html, CASE WHEN whole THEN translate(split_part(rest, '/', 1), '{UPPER}', '{LOWER}') ELSE '' END AS host,
         CASE WHEN whole THEN substr(rest, length(split_part(rest, '/', 1)) + 1) ELSE '' END AS path FROM parsed
), rules(verdict, rule_host, rule_path) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), fits AS (
  SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
         arg_max(verdict, length(rule_host || rule_path)) AS told
  FROM parts JOIN rules ON ('.' || host) LIKE ('%.' || rule_host) AND path LIKE (rule_path || '%') GROUP BY page_id
), judged AS (
  SELECT * FROM parts LEFT JOIN fits USING (page_id)
), links AS (
  SELECT host AS src, dst, count(*) AS n
  FROM (SELECT host, unnest(list_distinct([translate(x, '{UPPER}', '{LOWER}') FOR x IN
          regexp_extract_all(html, '(?i)\\b(?:href|src)\\s*=\\s*["'']?\\s*(?:https?:)?//([^\\s"''<>/?#]+)', 1)])) AS dst FROM parts)
  WHERE host <> '' AND host <> dst GROUP BY ALL
), seeds AS (
  SELECT host, avg(CASE WHEN told = 'allow' THEN 1.0 ELSE 0 END) AS trust,
         avg(CASE WHEN told = 'block' THEN 1.0 ELSE 0 END) AS distrust FROM judged WHERE host <> '' GROUP BY host
  UNION ALL SELECT DISTINCT dst, 0.0, 0.0 FROM links WHERE dst NOT IN (SELECT host FROM parts)
), shares AS (
  SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS share FROM links
), flows AS (  -- who gets how much of whose trust and distrust, and every host nothing of its own
  SELECT f.*, s.trust, s.distrust FROM (
    SELECT src AS giver, dst AS host, share AS t, 0.0 AS d FROM shares
    UNION ALL SELECT dst, src, 0.0, share FROM shares UNION ALL SELECT host, host, 0.0, 0.0 FROM seeds) f
  JOIN seeds s USING (host)
), scores AS (
  SELECT 0 AS round, host, CAST(trust AS DOUBLE) AS trust, CAST(distrust AS DOUBLE) AS distrust FROM seeds
  UNION ALL
  SELECT round + 1, f.host, CAST(any_value(f.trust) + 0.85 * sum(f.t * s.trust) AS DOUBLE),
         CAST(any_value(f.distrust) + (1 - any_value(f.distrust)) * 0.85 * sum(f.d * s.distrust) AS DOUBLE)
  FROM scores s JOIN flows f ON f.giver = s.host WHERE round < 100 GROUP BY round, f.host
)
SELECT page_id, j.host, path, rule,
       coalesce(told, CASE WHEN distrust > 0.5 AND distrust > trust THEN 'block' ELSE 'allow' END) AS verdict
FROM judged j LEFT JOIN scores s ON s.host = j.host AND s.round = 100
"""

# Every window of 20 words as a text; all but the first of equal ones cover words that go.
SUBSTRINGS = f"""
WITH split AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '{_WORD}'), []) AS ws FROM documents
), spread AS (
  SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS place FROM split
), starts AS (
  SELECT doc_id, ws, unnest(range(len(ws) - 19)) AS place FROM split WHERE len(ws) >= 20
), windows AS (
  SELECT doc_id, place, row_number() OVER (PARTITION BY array_to_string(ws[place + 1:place + 20], ' ') ORDER BY doc_id, place) AS nth
  FROM starts
), marked AS (
  SELECT s.*, max(w.place) FILTER (w.nth > 1) OVER (
           PARTITION BY s.doc_id ORDER BY s.place ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
  FROM spread s LEFT JOIN windows w USING (doc_id, place)
), cut AS (
  SELECT doc_id, CAST(count(*) FILTER (gone) AS BIGINT) AS n_removed,
         string_agg(word, ' ' ORDER BY place) FILTER (NOT gone) AS kept
  FROM marked GROUP BY doc_id
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM split LEFT JOIN cut USING (doc_id)
"""

STATEMENTS: dict[str, str] = {
    "op1_mixing": MIXING,
    "op5_quality_rules": RULES,
    "op6_url_filters": URLS,
    "op10_exact_dedup": EXACT,
    "op13_substring_dedup": SUBSTRINGS,
}
