"""The registered queries of the operators as SQL, where SQL can express them."""

from __future__ import annotations

_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SOURCE_MIXING = f"""WITH sized AS (
  SELECT doc_id, source, len({_WORDS.format("coalesce(text, '')")})::BIGINT AS size,
         md5('mix-1:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS key
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, count(*) AS docs, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS no
  FROM sized GROUP BY source),
ranked AS (
  SELECT *, no % 3 + 1 AS weight, row_number() OVER (ORDER BY source_size / (no % 3 + 1), no) AS place,
         (sum(source_size) OVER ())::BIGINT AS total
  FROM sources),
tested AS (
  SELECT *, 3 * source_size * (sum(weight) OVER (ORDER BY place DESC))
            < (total - coalesce(sum(3 * source_size) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * weight
            AS above
  FROM ranked),
capped AS (SELECT *, place < (SELECT coalesce(min(place), 1 << 60) FROM tested WHERE NOT above) AS at_cap FROM tested),
goals AS (
  SELECT *, CASE WHEN at_cap THEN (3 * source_size)::DOUBLE
                 ELSE ((total - coalesce(sum(3 * source_size) FILTER (WHERE at_cap) OVER (), 0)) * weight)::BIGINT::DOUBLE
                      / (sum(weight) FILTER (WHERE NOT at_cap) OVER ())::DOUBLE END AS target
  FROM capped),
started AS (
  SELECT *, least(3 * source_size, greatest(0, trunc(target / (sum(target) OVER () / greatest(1, total - count(*) OVER ())) - 0.5)))::BIGINT AS got
  FROM goals WHERE target > 0),
rest AS (SELECT *, (total - sum(got) OVER ())::BIGINT AS left_over FROM started),
seats AS (
  SELECT no, any_value(got) + count(*) FILTER (WHERE turn <= left_over) AS seats FROM (
    SELECT *, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, no) AS turn
    FROM rest, unnest(range(got, least(3 * source_size, got + left_over) + 1)) AS t(k) WHERE k < 3 * source_size)
  GROUP BY no
  UNION ALL SELECT no, got FROM rest WHERE got = 3 * source_size),
dealt AS (
  SELECT s.*, g.no, g.source_size, g.target, coalesce(n.seats, 0) AS seats,
         ('0x' || substr(key, 1, 8))::BIGINT % ((g.docs + 8191) // 8192) AS shard
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source LEFT JOIN seats n ON n.no = g.no),
shards AS (SELECT no, shard, sum(size)::BIGINT AS words, any_value(seats) AS seats FROM dealt GROUP BY no, shard),
shard_started AS (
  SELECT *, least(3 * words, greatest(0, trunc(words::DOUBLE
            / (sum(words) OVER (PARTITION BY no) / greatest(1, seats - count(*) OVER (PARTITION BY no))) - 0.5)))::BIGINT AS got
  FROM shards WHERE seats > 0 AND words > 0),
shard_rest AS (SELECT *, (seats - sum(got) OVER (PARTITION BY no))::BIGINT AS left_over FROM shard_started),
shard_seats AS (
  SELECT no, shard, any_value(got) + count(*) FILTER (WHERE turn <= left_over) AS own FROM (
    SELECT *, row_number() OVER (PARTITION BY no ORDER BY words::DOUBLE / (2 * k + 1) DESC, shard) AS turn
    FROM shard_rest, unnest(range(got, least(3 * words, got + left_over) + 1)) AS t(k) WHERE k < 3 * words)
  GROUP BY no, shard
  UNION ALL SELECT no, shard, got FROM shard_rest WHERE got = 3 * words),
quotas AS (SELECT no, shard, words, coalesce(own, 0) AS quota FROM shards LEFT JOIN shard_seats USING (no, shard)),
placed AS (
  SELECT d.*, words, quota, CASE WHEN words > 0 THEN quota // words ELSE 0 END AS passes,
         sum(size) OVER (PARTITION BY no, shard ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS starts
  FROM dealt d JOIN quotas USING (no, shard))
SELECT doc_id, source, size, source_size, target,
       (passes * size + greatest(0, least(size, quota - passes * words - starts)))::BIGINT AS taken
FROM placed"""

MINHASH_NEARDUP = f"""WITH RECURSIVE split AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN []
    WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
  FROM split),
members AS (SELECT doc_id, unnest(s) AS x FROM sets),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
  FROM members a JOIN members b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
linked AS (
  SELECT a, b FROM shared JOIN sets p ON p.doc_id = a JOIN sets q ON q.doc_id = b
  WHERE 100 * n >= 75 * (len(p.s) + len(q.s) - n)),
links AS (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked),
reach AS (SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN least USING (doc_id)"""

CHAT_FORMAT = r"""WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, turn, role, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) AS t(turn, role)),
placed AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before FROM turns),
sized AS (
  SELECT *, length(text) + len(regexp_extract_all(text, '[\\<>]')) + CASE
              WHEN before = role THEN 8
              ELSE 13 + length(role) + len(regexp_extract_all(role, '[\\<>]')) END AS chars
  FROM placed),
chats AS (
  SELECT conv_id, count(*) AS n_turns, sum(chars)::BIGINT AS formatted_chars,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS lines,
         coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss
  FROM sized GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(lines) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars
FROM chats"""

CONVERSATION_REPAIR = r"""WITH RECURSIVE crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)),
         lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key
  FROM conversations),
kinds AS (
  SELECT *, xor(4294967295, list_reduce(
         list_concat([4294967295::BIGINT], list_transform(string_split(key, ''), lambda x: ord(x)::BIGINT)),
         lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) % 20 AS kind
  FROM keyed, crc_table),
damaged AS (
  SELECT conv_id, turn, copy, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM kinds, (VALUES (0), (1)) AS c(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)),
placed AS (
  SELECT *, substr(role, 1, 1) AS initial, row_number() OVER w AS pos, lag(substr(role, 1, 1)) OVER w AS before,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth
  FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
rows AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN nth > 1 THEN 'duplicate'
                 WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault
  FROM placed),
inserts AS (SELECT * FROM (VALUES
  (0, '', 0, []), (0, 'I', 2, ['user:']), (0, 'II', 3, ['user:', 'assistant:']),
  (1, '', 1, []), (1, 'I', 2, ['user:']), (1, 'II', 3, ['user:', 'assistant:']),
  (2, '', 2, []), (2, 'I', 3, ['assistant:']), (3, '', 3, []), (3, 'I', 2, ['user:'])) AS t(state, added, mid, lines)),
edits AS (SELECT * FROM (VALUES
  (0, 'D', NULL, 0, NULL), (1, 'D', NULL, 1, NULL), (2, 'D', NULL, 2, NULL), (3, 'D', NULL, 3, NULL),
  (0, 'K', 's', 1, NULL), (0, 'K', 'u', 2, NULL), (1, 'K', 'u', 2, NULL), (2, 'K', 'a', 3, NULL), (3, 'K', 'u', 2, NULL),
  (0, 'R', NULL, 2, 'user'), (1, 'R', NULL, 2, 'user'), (2, 'R', NULL, 3, 'assistant'), (3, 'R', NULL, 2, 'user'))
  AS t(mid, edit, initial, after, put)),
ways AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS pos, 0 AS state, {'cost': 0::BIGINT, 'audit': '', 'lines': []::VARCHAR[]} AS best
  FROM conversations
  UNION ALL
  SELECT w.conv_id, r.pos, e.after, min({
           'cost': w.best.cost + 2 * length(i.added) + CASE e.edit WHEN 'D' THEN 3 WHEN 'K' THEN 0 ELSE 2 END
                   + CASE WHEN e.edit <> 'D' AND r.fault = 'truncated' THEN 1 ELSE 0 END,
           'audit': w.best.audit || i.added || e.edit,
           'lines': list_concat(w.best.lines, i.lines, CASE e.edit WHEN 'D' THEN [] ELSE [coalesce(e.put, r.role) || ':' || r.text] END)})
  FROM ways w JOIN rows r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.pos = w.pos + 1
  JOIN inserts i ON i.state = w.state
  JOIN edits e ON e.mid = i.mid AND (e.initial IS NULL OR e.initial = r.initial) AND (e.edit = 'D' OR r.fault IN ('', 'truncated'))
  GROUP BY w.conv_id, r.pos, e.after),
facts AS (
  SELECT c.conv_id, count(r.pos) AS n, coalesce(max(r.turn) - min(r.turn) + 1 - count(DISTINCT r.turn), 0)::BIGINT AS gaps,
         count(*) FILTER (r.fault = 'blank') AS blank, count(*) FILTER (r.fault = 'duplicate') AS duplicate,
         count(*) FILTER (r.fault = 'truncated') AS truncated,
         count(*) FILTER (r.pos > 1 AND r.before || r.initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN rows r ON r.conv_id IS NOT DISTINCT FROM c.conv_id GROUP BY c.conv_id),
tails AS (SELECT * FROM (VALUES (0, '', []), (1, 'II', ['user:', 'assistant:']), (2, 'I', ['assistant:']), (3, '', [])) AS t(state, added, lines)),
final AS (
  SELECT f.conv_id, min({'cost': w.best.cost + 2 * length(t.added), 'audit': w.best.audit || t.added, 'lines': list_concat(w.best.lines, t.lines)}) AS best
  FROM facts f JOIN ways w ON w.conv_id IS NOT DISTINCT FROM f.conv_id AND w.pos = f.n JOIN tails t ON t.state = w.state GROUP BY f.conv_id)
SELECT f.conv_id, gaps, blank, duplicate, truncated, illegal, best.cost AS cost, best.audit AS audit,
       sha256(array_to_string(best.lines, chr(10))) AS repaired_sha256
FROM facts f JOIN final l ON l.conv_id IS NOT DISTINCT FROM f.conv_id"""

ORACLE_SQL = {
    "op3_source_mixing": SOURCE_MIXING,
    "op6_minhash_neardup": MINHASH_NEARDUP,
    "op7_chat_format": CHAT_FORMAT,
    "op13_conversation_repair": CONVERSATION_REPAIR,
}
