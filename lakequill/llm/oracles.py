"""SQL for queries whose module does not hold it: the same results for DuckDB, by plain means."""

#: A digest in base32 from its hex form: every five hex digits are four letters of five bits.
WARC = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages
), h AS (
  SELECT hex, max(page_id) AS holder FROM p GROUP BY hex
)
SELECT p.page_id, CAST(octet_length(encode(p.html)) AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(p.hex, CAST(5 * (k // 4) + 1 AS BIGINT), 5) AS BIGINT) >> (15 - 5 * (k % 4))) & 31 AS BIGINT) + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN p.page_id = h.holder OR h.holder IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN p.page_id <> h.holder OR p.page_id IS NULL THEN h.holder END AS refers_to
FROM p JOIN h USING (hex)
"""

#: Lines, runs of lines of one level, normalised units, the last earlier message with the same unit, votes, and the tree by recursion.
QUOTES = r"""
WITH RECURSIVE m AS (
  SELECT row_number() OVER () AS row, conv_id, turn, role, regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g') AS text,
    md5(concat_ws(' ', coalesce(CAST(conv_id AS VARCHAR), '-'), coalesce(CAST(turn AS VARCHAR), '-'), coalesce(hex(role), '-'), coalesce(text, ''))) AS key FROM conversations
), split AS (
  SELECT row, conv_id, turn, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM m
), l AS (
  SELECT row, conv_id, turn, place, length(regexp_replace(regexp_extract(raw, '^[ \t]*>[> \t]*'), '[^>]', '', 'g')) AS level,
    substr(raw, length(regexp_extract(raw, '^[ \t]*>[> \t]*')) + 1) AS line FROM split
), marked AS (
  SELECT *, CASE WHEN level <> lag(level) OVER w THEN 1 ELSE 0 END AS new_run,
    CASE WHEN level <> lag(level) OVER w OR (trim(line, ' ') = '') <> (lag(trim(line, ' ') = '') OVER w) THEN 1 ELSE 0 END AS new_part
  FROM l WINDOW w AS (PARTITION BY row ORDER BY place)
), runs AS (
  SELECT *, sum(new_run) OVER w AS passage, sum(new_part) OVER w AS part FROM marked
  WINDOW w AS (PARTITION BY row ORDER BY place ROWS UNBOUNDED PRECEDING)
), parts AS (
  SELECT row, conv_id, turn, level, passage, part, string_agg(line, ' ' ORDER BY place) AS line FROM runs GROUP BY ALL HAVING bool_or(trim(line, ' ') <> '')
), texts AS (
  SELECT row, conv_id, turn, level, passage, line FROM parts
  WHERE level = 0 OR (row, passage) IN (SELECT (row, passage) FROM parts GROUP BY row, passage HAVING count(*) > 1)
  UNION ALL SELECT row, conv_id, turn, level, passage, string_agg(line, ' ' ORDER BY place) FROM runs WHERE level > 0 GROUP BY ALL
  UNION ALL SELECT row, conv_id, turn, level, passage, line FROM runs
  UNION ALL SELECT row, conv_id, turn, level, -1, string_agg(line, ' ' ORDER BY place) FROM runs WHERE level = 0 GROUP BY row, conv_id, turn, level
), units AS (
  SELECT row, conv_id, turn, level, passage, trim(regexp_replace(lower(line), '[^\p{L}\p{N}]+', ' ', 'g'), ' ') AS unit FROM texts
  WHERE conv_id IS NOT NULL AND turn IS NOT NULL
), own AS (
  SELECT DISTINCT conv_id, turn, unit FROM units WHERE level = 0 AND unit <> ''
), quoted AS (
  SELECT q.row, q.conv_id, q.turn, q.level, q.passage, q.unit, (SELECT max(o.turn) FROM own o WHERE o.conv_id = q.conv_id AND o.unit = q.unit AND o.turn < q.turn) AS source
  FROM units q WHERE q.level > 0 AND q.unit <> ''
), votes AS (
  SELECT row, conv_id, turn, level, source, sum(length(unit)) AS size FROM quoted WHERE source IS NOT NULL GROUP BY ALL
), best AS (
  SELECT row, conv_id, turn, source AS parent FROM votes QUALIFY row_number() OVER (PARTITION BY row ORDER BY level, size DESC, source DESC) = 1
), edges AS (
  SELECT conv_id, turn, max(parent) AS parent FROM best GROUP BY ALL
), climb AS (
  SELECT conv_id, turn, parent AS up, 1 AS depth FROM edges
  UNION ALL SELECT c.conv_id, c.turn, e.parent, c.depth + 1 FROM climb c JOIN edges e ON e.conv_id = c.conv_id AND e.turn = c.up
), trees AS (
  SELECT conv_id, turn, arg_max(up, depth) AS root, max(depth) AS depth FROM climb GROUP BY ALL
), counts AS (
  SELECT row, count(*) AS n_quoted, sum(linked) AS n_linked FROM (SELECT row, passage, max(CASE WHEN source IS NULL THEN 0 ELSE 1 END) AS linked FROM quoted GROUP BY ALL) GROUP BY row
), said AS (
  SELECT l.row, string_agg(l.line, chr(10) ORDER BY l.place) FILTER (WHERE c.row IS NULL OR NOT regexp_matches(lower(trim(l.line, ' ')), '^(?:(?:on|le|am|el)\b.{1,200}\b(?:wrote|a écrit|schrieb|escribió) ?:|-{2,} ?original message ?-{2,})$')) AS own
  FROM l LEFT JOIN counts c ON c.row = l.row WHERE l.level = 0 GROUP BY l.row
), done AS (
  SELECT m.row, m.key, m.conv_id, m.turn, m.role, trim(regexp_replace(coalesce(s.own, ''), '\n{3,}', chr(10) || chr(10), 'g'), chr(32) || chr(9) || chr(10)) AS text, b.parent AS parent_turn,
    coalesce(t.root, m.turn) AS root_turn, CAST(coalesce(t.depth, 0) AS BIGINT) AS depth, CAST(coalesce(c.n_quoted, 0) AS BIGINT) AS n_quoted, CAST(coalesce(c.n_linked, 0) AS BIGINT) AS n_linked
  FROM m LEFT JOIN said s ON s.row = m.row LEFT JOIN best b ON b.row = m.row LEFT JOIN counts c ON c.row = m.row
  LEFT JOIN trees t ON t.conv_id = m.conv_id AND t.turn = m.turn
)
SELECT conv_id, turn, role, text, parent_turn, root_turn, depth, n_quoted, n_linked,
  CAST(row_number() OVER (PARTITION BY conv_id ORDER BY root_turn NULLS FIRST, depth, turn NULLS FIRST, key) AS BIGINT) AS position FROM done
"""
