"""The registered queries as SQL over the same tables."""

from __future__ import annotations

EVENTS_INVENTORY = """inv AS (
  SELECT event_type AS dir_name,
         event_type || '/' || user_id || '/' || event_id || '.log' AS path,
         strlen(props)::BIGINT AS size_bytes, ts AS mtime, false AS is_dir, true AS stat_ok
  FROM events)"""
EVENTS_CUTOFF = "(TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 168 HOUR)"
EVENTS_AGE = "date_diff('microsecond', {0}, TIMESTAMP '2024-01-31 00:00:00') / 3.6e9"

ORDERS_INVENTORY = """inv AS (
  SELECT o_orderpriority AS dir_name,
         o_orderpriority || '/' || o_custkey || '/' || o_orderkey AS path,
         floor(o_totalprice)::BIGINT * (o_orderkey % 4096) AS size_bytes, o_orderdate AS mtime,
         false AS is_dir, true AS stat_ok
  FROM orders)"""
ORDERS_CUTOFF = "(TIMESTAMP '2001-08-02 00:00:00' - INTERVAL 8760 HOUR)"
ORDERS_AGE = "date_diff('microsecond', {0}, TIMESTAMP '2001-08-02 00:00:00') / 3.6e9"

POLICY = """policy AS (
  SELECT c_custkey::VARCHAR AS dir_name,
         CASE WHEN c_mktsegment <> 'MACHINERY' THEN floor(c_acctbal)::INTEGER * 6 END AS retention_hours,
         CASE WHEN c_mktsegment = 'BUILDING' THEN false
              WHEN c_mktsegment <> 'FURNITURE' THEN true END AS clean_on_session_end,
         CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN true
              WHEN c_mktsegment = 'HOUSEHOLD' THEN false END AS dry_run,
         CASE c_custkey % 4 WHEN 0 THEN false WHEN 1 THEN true END AS session_end_summary,
         c_name AS owner
  FROM customer WHERE c_custkey % 10 <> 0)"""
UPDATES = """updates AS (
  SELECT o_custkey::VARCHAR AS dir_name, floor(o_totalprice)::INTEGER - 150000 AS retention_hours,
         o_orderkey AS updated_at
  FROM orders)"""

CONTENT = """content AS (
  SELECT 'documents' AS dir_name, doc_id::VARCHAR AS item, text FROM documents
  UNION ALL SELECT 'pages', page_id::VARCHAR, html FROM pages
  UNION ALL SELECT 'conversations', conv_id || '/' || turn, text FROM conversations)"""
DOCUMENTS = "content AS (SELECT source AS dir_name, doc_id::VARCHAR AS item, text FROM documents)"
PLANTED = """content AS (
  SELECT source AS dir_name, doc_id::VARCHAR AS item, lang || '/' || source || '/' || doc_id || '.txt' AS path,
         lang, text || chr(10) || CASE doc_id % 6
      WHEN 0 THEN 'sk-' || substr(md5(doc_id::VARCHAR), 1, 24)
      WHEN 1 THEN 'ghp_' || md5(doc_id::VARCHAR) || 'abcd'
      WHEN 2 THEN 'AKIA' || upper(substr(md5(doc_id::VARCHAR), 1, 16))
      WHEN 3 THEN 'xoxb-' || substr(md5(doc_id::VARCHAR), 1, 12)
      WHEN 4 THEN 'phc_' || md5(doc_id::VARCHAR)
      ELSE 'sk-short' END AS text
  FROM documents)"""

_START = "(?:^|[^A-Za-z0-9_])"
BUILTIN = {
    "OpenAI/Anthropic API Keys": _START + "(sk-[A-Za-z0-9_-]{20,})",
    "GitHub Tokens": _START + "(gh[oprsu]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,})",
    "AWS Keys": _START + "(AKIA[0-9A-Z]{16})",
    "Slack Tokens": _START + "(xox[abeprs]-[A-Za-z0-9-]{10,})",
    "PostHog Keys": _START + "(ph[cx]_[A-Za-z0-9]{30,})",
}
CUSTOM = {"Assigned tokens": 'token = (?:"|&quot;)([0-9a-f]{40})'}


def _findings(detectors: dict[str, str], carry: str = "dir_name, item") -> str:
    """A CTE with one row per match of each detector."""
    lists = "\n  UNION ALL ".join(
        f"SELECT {carry}, '{name}' AS category, regexp_extract_all(text, '{pattern}', 1) AS secrets FROM content"
        for name, pattern in detectors.items()
    )
    return f"""lists AS ({lists}),
findings AS (
  SELECT {carry}, category, unnest(range(len(secrets)))::INTEGER AS position, unnest(secrets) AS secret
  FROM lists)"""


def _size(value: str) -> str:
    """Bytes as text."""
    return f"""CASE WHEN abs({value}) < 1024 THEN ({value})::VARCHAR || ' B'
      WHEN abs({value}) < 1048576 THEN printf('%.1f KB', ({value})::DOUBLE / 1024)
      WHEN abs({value}) < 1073741824 THEN printf('%.1f MB', ({value})::DOUBLE / 1048576)
      WHEN abs({value}) < 1099511627776 THEN printf('%.1f GB', ({value})::DOUBLE / 1073741824)
      WHEN abs({value}) < 1125899906842624 THEN printf('%.1f TB', ({value})::DOUBLE / 1099511627776)
      ELSE printf('%.1f PB', ({value})::DOUBLE / 1125899906842624) END"""


def _stats(cutoff: str, age: str) -> str:
    return f"""stats AS (
  SELECT dir_name, count(*) AS file_count, coalesce(sum(size_bytes), 0)::BIGINT AS total_size,
         (count(*) FILTER (WHERE mtime < {cutoff}))::BIGINT AS violations,
         {age.format('min(mtime)')} AS max_age_hours
  FROM inv GROUP BY dir_name)"""


EVENTS_STATS = f"{EVENTS_INVENTORY}, {_stats(EVENTS_CUTOFF, EVENTS_AGE)}"
ORDERS_STATS = f"{ORDERS_INVENTORY}, {_stats(ORDERS_CUTOFF, ORDERS_AGE)}"
ORDERS_PURGE = f"""{ORDERS_INVENTORY}, sums AS (
  SELECT dir_name, count(*) AS files, sum(size_bytes)::BIGINT AS bytes
  FROM inv WHERE mtime < {ORDERS_CUTOFF} GROUP BY dir_name)"""

# Documents as files, a minute old per character.
TREE = """files AS (
  SELECT lang AS dir_name, lang || '/' || source AS folder, lang || '/' || source || '/' || doc_id || '.txt' AS path,
         strlen(text)::BIGINT AS size_bytes, TIMESTAMP '2024-01-31 00:00:00' - to_minutes(n_chars) AS mtime,
         n_chars > 600 AS expired
  FROM documents)"""

# Sessions by gaps and islands; closed once the watermark, kept in milliseconds, has passed the end.
SESSIONS = """marked AS (
  SELECT user_id, ts,
         CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh
  FROM events WHERE ts IS NOT NULL),
numbered AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM marked),
sessions AS (
  SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS events
  FROM numbered GROUP BY user_id, n),
closed AS (
  SELECT * FROM sessions
  WHERE session_end <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR FROM events))"""

# The same with sessions that a purchase ends; of events of one time the end is the last.
ENDED_SESSIONS = """marked AS (
  SELECT user_id, ts, event_type = 'purchase' AS ended,
         CASE WHEN ts - lag(ts) OVER w <= INTERVAL 6 HOUR AND NOT lag(event_type = 'purchase') OVER w THEN 0 ELSE 1 END AS fresh
  FROM events WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_type = 'purchase')),
numbered AS (
  SELECT user_id, ts, ended, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, ended ROWS UNBOUNDED PRECEDING) AS n FROM marked),
sessions AS (
  SELECT user_id, min(ts) AS session_start, max(ts) + CASE WHEN bool_or(ended) THEN INTERVAL 0 HOUR ELSE INTERVAL 6 HOUR END AS session_end,
         count(*) AS events, CASE WHEN bool_or(ended) THEN 'event' ELSE 'gap' END AS closed_by
  FROM numbered GROUP BY user_id, n)"""

ORACLE_SQL: dict[str, str] = {
    "expired_by_folder": f"""WITH {EVENTS_INVENTORY},
known AS (
  SELECT inv.*, split_part(path, '/', 2)::BIGINT AS user_id FROM inv),
windows AS (
  SELECT *, CASE WHEN user_id % 4 = 0 AND user_id % 3 <> 0 THEN ((user_id % 28 + 1) * 24)::INTEGER
                 WHEN dir_name = 'click' THEN 100 WHEN dir_name = 'error' THEN 600 ELSE 24 END AS retention_hours
  FROM known)
SELECT dir_name, retention_hours, count(*) AS files, sum(size_bytes)::BIGINT AS bytes FROM windows
WHERE mtime < TIMESTAMP '2024-01-31 00:00:00' - to_hours(retention_hours) GROUP BY dir_name, retention_hours""",
    "expired_by_dated_policy": """WITH files AS (
  SELECT o_custkey::VARCHAR AS dir_name, o_orderpriority || '/' || o_custkey || '/' || o_orderkey AS path, o_orderdate AS mtime FROM orders),
versions AS (
  SELECT o_custkey::VARCHAR AS dir_name, o_orderdate AS valid_from, max(floor(o_totalprice / 10)::INTEGER) AS hours
  FROM orders WHERE o_orderkey % 7 = 0 AND o_orderkey % 3 <> 0 GROUP BY ALL),
known AS (
  SELECT f.*, coalesce(v.hours, 24) AS retention_hours
  FROM files f ASOF LEFT JOIN versions v ON f.dir_name = v.dir_name AND f.mtime >= v.valid_from)
SELECT * FROM known WHERE mtime < TIMESTAMP '2001-08-02 00:00:00' - to_hours(retention_hours)""",
    "session_end_events": f"""WITH {ENDED_SESSIONS}
SELECT * FROM sessions
WHERE closed_by = 'event' OR session_end <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR FROM events)""",
    "inventory": f"WITH {EVENTS_INVENTORY} SELECT * FROM inv",
    "multi_root_union": f"""WITH {CONTENT}
SELECT dir_name, count(*) AS items, sum(strlen(text))::BIGINT AS bytes FROM content GROUP BY dir_name""",
    "stats_missing_root": f"""WITH {EVENTS_STATS},
roots AS (SELECT event_type AS dir_name FROM events UNION SELECT o_orderpriority FROM orders)
SELECT dir_name, coalesce(file_count, 0) AS file_count, coalesce(total_size, 0) AS total_size,
       coalesce(violations, 0) AS violations, max_age_hours
FROM roots LEFT JOIN stats USING (dir_name)""",
    "unreadable_entries": f"""WITH inv AS (
  SELECT event_type AS dir_name,
         CASE WHEN value >= 10 AND value <= 100 THEN strlen(props)::BIGINT END AS size_bytes,
         CASE WHEN value >= 10 THEN ts END AS mtime
  FROM events),
{_stats(EVENTS_CUTOFF, EVENTS_AGE)},
sums AS (
  SELECT dir_name, count(*) AS files, sum(coalesce(size_bytes, 0))::BIGINT AS bytes
  FROM inv WHERE mtime < {EVENTS_CUTOFF} GROUP BY dir_name)
SELECT stats.*, files, bytes FROM stats LEFT JOIN sums USING (dir_name)""",
    "expired_files": f"""WITH {EVENTS_INVENTORY}
SELECT dir_name, path, size_bytes, mtime FROM inv WHERE mtime < {EVENTS_CUTOFF}""",
    "expired_by_policy": f"""WITH {POLICY},
inv AS (
  SELECT o_custkey::VARCHAR AS dir_name, floor(o_totalprice)::BIGINT * (o_orderkey % 4096) AS size_bytes,
         o_orderdate AS mtime
  FROM orders),
known AS (SELECT inv.*, coalesce(retention_hours, 24) AS retention_hours FROM inv LEFT JOIN policy USING (dir_name))
SELECT dir_name, retention_hours, count(*) AS files, sum(size_bytes)::BIGINT AS bytes FROM known
WHERE mtime < TIMESTAMP '2001-08-02 00:00:00' - to_hours(retention_hours) GROUP BY dir_name, retention_hours""",
    "effective_retention": """WITH given AS (
  SELECT c_custkey::VARCHAR AS dir_name,
         CASE c_mktsegment WHEN 'MACHINERY' THEN 0 WHEN 'BUILDING' THEN -1 WHEN 'FURNITURE' THEN NULL
              ELSE c_nationkey + 1 END AS override_hours,
         floor(c_acctbal)::INTEGER AS configured_hours
  FROM customer)
SELECT *, CASE WHEN override_hours IS NULL OR override_hours = 0 THEN configured_hours
               ELSE override_hours END AS retention_hours FROM given""",
    "effective_dry_run": """SELECT c_custkey::VARCHAR AS dir_name,
       c_nationkey > 12 OR c_mktsegment = 'AUTOMOBILE' AS dry_run FROM customer""",
    "policy_overlay": f"""WITH {POLICY},
roots AS (SELECT DISTINCT o_custkey::VARCHAR AS dir_name FROM orders),
known AS (
  SELECT dir_name, coalesce(retention_hours, 24) AS retention_hours,
         coalesce(clean_on_session_end, true) AS clean_on_session_end, coalesce(dry_run, false) AS dry_run,
         owner, coalesce(session_end_summary, true) AS session_end_summary
  FROM roots LEFT JOIN policy USING (dir_name))
SELECT *, clean_on_session_end AS runs, clean_on_session_end AND session_end_summary AS prints FROM known""",
    "policy_upsert": f"""WITH {POLICY}, {UPDATES},
latest AS (
  SELECT dir_name, arg_max(retention_hours, updated_at) AS new_hours
  FROM updates WHERE retention_hours >= 0 GROUP BY dir_name)
SELECT dir_name, coalesce(new_hours, retention_hours) AS retention_hours, clean_on_session_end, dry_run, session_end_summary, owner
FROM policy FULL JOIN latest USING (dir_name)""",
    "policy_update_outcome": f"""WITH {UPDATES}
SELECT *, retention_hours >= 0 AS accepted,
       CASE WHEN retention_hours >= 0 THEN 'Retention period set to ' || retention_hours || ' hours'
            ELSE 'Invalid hours value: ' || retention_hours END AS message FROM updates""",
    "purge_plan": f"""WITH {ORDERS_INVENTORY}
SELECT dir_name, path, size_bytes, mtime, true AS dry_run,
       '[DRY RUN] Would delete: ' || path || ' (' || {_size('size_bytes')} || ')' AS message
FROM inv WHERE mtime < {ORDERS_CUTOFF}""",
    "purge_summary": f"""WITH {ORDERS_PURGE}
SELECT *, dir_name || ': Deleted ' || files || ' files (' || {_size('bytes')} || ' freed)' AS message FROM sums""",
    "purge_rollup": f"""WITH {ORDERS_PURGE}
SELECT dir_name, sum(files)::BIGINT AS files, sum(bytes)::BIGINT AS bytes, grouping(dir_name) = 1 AS is_total
FROM sums GROUP BY ROLLUP (dir_name)""",
    "purge_total": f"""WITH {ORDERS_PURGE},
total AS (SELECT coalesce(sum(files), 0)::BIGINT AS files, coalesce(sum(bytes), 0)::BIGINT AS bytes FROM sums)
SELECT *, 8760 AS retention_hours, 'Starting cleanup (retention: 8760h, dry_run: True)' AS start,
       CASE WHEN files = 0 THEN 'No files older than 8760h found'
            ELSE 'Cleanup complete: ' || files || ' files processed' END AS message,
       CASE WHEN files = 0 THEN '[retention] No old files to clean'
            ELSE '[retention] Would clean ' || files || ' files (' || {_size('bytes')} || ')' END AS session_message
FROM total""",
    "run_message": f"""WITH {ORDERS_PURGE},
found AS (
  SELECT dir_name, coalesce(files, 0) AS files, coalesce(bytes, 0) AS bytes
  FROM (SELECT DISTINCT dir_name FROM inv) LEFT JOIN sums USING (dir_name)
  UNION ALL SELECT DISTINCT dir_name, 0, 0 FROM inv)
SELECT dir_name, dry_run, files, bytes, CASE
    WHEN dry_run AND files > 0 THEN '[retention] Would clean ' || files || ' files (' || {_size('bytes')} || ')'
    WHEN dry_run THEN '[retention] No old files to clean'
    WHEN files > 0 THEN '[retention] Cleaned ' || files || ' files (' || {_size('bytes')} || ' freed)'
    ELSE '[retention] No old files found' END AS message
FROM found CROSS JOIN (VALUES (false), (true)) AS modes(dry_run)""",
    "table_purge_retained": f"SELECT * FROM events WHERE ts IS NULL OR ts >= {EVENTS_CUTOFF}",
    "table_purge_partitions": f"""WITH counted AS (
  SELECT year(o_orderdate)::INTEGER AS order_year, count(*) AS rows,
         (count(*) FILTER (WHERE o_orderdate < {ORDERS_CUTOFF}))::BIGINT AS expired
  FROM orders GROUP BY ALL)
SELECT *, CASE expired WHEN 0 THEN 'keep' WHEN rows THEN 'drop' ELSE 'rewrite' END AS action FROM counted""",
    "table_purge_applied": f"""SELECT *, year(o_orderdate)::INTEGER AS order_year FROM orders
WHERE o_orderdate IS NULL OR o_orderdate >= {ORDERS_CUTOFF}""",
    "table_purge_files": f"SELECT * FROM orders WHERE o_orderdate IS NULL OR o_orderdate >= {ORDERS_CUTOFF}",
    "table_purge_layouts": f"""SELECT *, month(o_orderdate)::INTEGER AS order_month,
       CASE WHEN o_orderkey % 2 = 1 THEN o_orderpriority END AS note FROM orders
WHERE o_orderdate IS NULL OR o_orderdate >= {ORDERS_CUTOFF}""",
    "tree_inventory": f"""WITH {TREE}
SELECT dir_name, path, size_bytes, mtime, false AS is_dir, true AS stat_ok FROM files
UNION ALL SELECT DISTINCT dir_name, folder, NULL::BIGINT, NULL::TIMESTAMP, true, true FROM files""",
    "tree_source": f"""WITH {TREE}
SELECT dir_name, path, size_bytes, mtime FROM files
WHERE mtime < TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 10 HOUR AND size_bytes BETWEEN 1000 AND 100000""",
    "tree_status": f"""WITH {TREE}
SELECT dir_name, count(*) AS file_count, sum(size_bytes)::BIGINT AS total_size,
       (count(*) FILTER (WHERE expired))::BIGINT AS violations,
       date_diff('microsecond', min(mtime), TIMESTAMP '2024-01-31 00:00:00') / 3.6e9 AS max_age_hours
FROM files GROUP BY dir_name""",
    "tree_clean": f"""WITH {TREE},
sums AS (
  SELECT dir_name, count(*) AS files, sum(size_bytes)::BIGINT AS bytes FROM files WHERE expired GROUP BY dir_name),
emptied AS (SELECT dir_name, folder FROM files GROUP BY dir_name, folder HAVING bool_and(expired)),
removed AS (SELECT dir_name, count(*) AS folders FROM emptied GROUP BY dir_name)
SELECT dir_name, files, bytes,
       dir_name || ': Deleted ' || files || ' files (' || {_size('bytes')} || ' freed)' AS message,
       coalesce(folders, 0) AS folders
FROM sums LEFT JOIN removed USING (dir_name)""",
    "tree_scan": f"""WITH {PLANTED}, {_findings(BUILTIN, 'lang, path')}
SELECT lang AS dir_name, path, category, position, secret FROM findings""",
    "rescan_changed": f"""WITH {PLANTED.replace("content AS", "planted AS")},
content AS (
  SELECT p.* REPLACE (CASE WHEN doc_id % 9 = 0 THEN p.text || chr(10) || 'AKIA' || upper(substr(md5('new' || doc_id), 1, 16))
                           WHEN doc_id % 5 = 0 THEN d.text ELSE p.text END AS text)
  FROM planted p JOIN documents d ON p.item = d.doc_id::VARCHAR),
{_findings(BUILTIN, 'lang, path')}
SELECT lang AS dir_name, path, category, position, secret FROM findings""",
    "tree_scan_touching": f"""WITH content AS (
  SELECT lang, lang || '/' || source || '/' || doc_id || '.txt' AS path,
         text || chr(10) || repeat(md5(doc_id::VARCHAR), 40) AS text FROM documents),
lists AS (SELECT lang AS dir_name, path, regexp_extract_all(text, '[0-9a-f]{{40}}') AS secrets FROM content)
SELECT dir_name, path, 'Runs' AS category, unnest(range(len(secrets)))::INTEGER AS position, unnest(secrets) AS secret FROM lists""",
    "prune_dirs": """WITH files AS (
  SELECT event_type AS root, event_type || '/' || user_id AS folder,
         event_type <> 'view' AND ts < TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 24 HOUR AS gone
  FROM events),
swept AS (SELECT DISTINCT root FROM files WHERE gone),
folders AS (SELECT root, folder, bool_and(coalesce(gone, false)) AS emptied FROM files GROUP BY root, folder)
SELECT root AS dir_name, folder AS path, 1 AS depth FROM folders WHERE emptied
UNION ALL
SELECT root, folder || '/archive', 2 FROM folders SEMI JOIN swept USING (root)""",
    "format_size": f"""WITH {ORDERS_INVENTORY}
SELECT path, size_bytes, {_size('size_bytes')} AS size_text FROM inv""",
    "dir_stats": f"WITH {EVENTS_STATS} SELECT * FROM stats",
    "dir_stats_orders": f"WITH {ORDERS_STATS} SELECT * FROM stats",
    "status_report": f"""WITH {ORDERS_STATS}
SELECT dir_name, '  ' || dir_name || ': ' || {_size('total_size')} || ' (' || file_count || ' files)' ||
       CASE WHEN violations > 0 THEN ' ⚠️  ' || violations || ' violations' ELSE '' END AS line
FROM stats""",
    "status_summary": f"""WITH {EVENTS_STATS},
total AS (
  SELECT sum(file_count)::BIGINT AS file_count, sum(total_size)::BIGINT AS total_size,
         sum(violations)::BIGINT AS violations, max(max_age_hours) AS max_age_hours
  FROM stats)
SELECT *, 168 AS retention_hours, printf('Oldest file: %.1f hours ago', max_age_hours) AS oldest,
       CASE WHEN violations > 0
            THEN '⚠️  Retention violations: ' || violations || ' files exceed 168h'
            ELSE '✓ No retention violations' END AS verdict
FROM total""",
    "secret_match_flags": "WITH "
    + PLANTED
    + "\n"
    + "\nUNION ALL ".join(
        f"SELECT dir_name, item, '{name}' AS category, regexp_matches(text, '{pattern}') AS matched FROM content"
        for name, pattern in BUILTIN.items()
    ),
    "secret_findings": f"WITH {PLANTED}, {_findings(BUILTIN)} SELECT * FROM findings",
    "secret_summary": f"""WITH {PLANTED}, {_findings(BUILTIN)}
SELECT dir_name, category, count(*) AS matches, count(DISTINCT item) AS items
FROM findings GROUP BY dir_name, category""",
    "secret_custom_detector": f"WITH {CONTENT}, {_findings({**BUILTIN, **CUSTOM})} SELECT * FROM findings",
    "secret_scanner_union": f"""WITH {CONTENT}, {_findings({**BUILTIN, **CUSTOM})},
words AS (
  SELECT dir_name, item, list_filter(regexp_extract_all(text, '\\b[0-9a-f]{{40}}\\b'),
                                     lambda w: len(list_distinct(string_split(w, ''))) >= 10) AS secrets FROM content),
varied AS (
  SELECT dir_name, item, 'Assigned tokens' AS category, unnest(range(len(secrets)))::INTEGER AS position, unnest(secrets) AS secret
  FROM words)
SELECT dir_name, item, category, secret, position FROM findings WHERE category <> 'Assigned tokens'
UNION ALL
SELECT dir_name, item, category, secret, min(position)
FROM (SELECT * FROM findings WHERE category = 'Assigned tokens' UNION ALL SELECT * FROM varied) GROUP BY ALL""",
    "secret_entropy": f"""WITH {CONTENT},
words AS (SELECT dir_name, item, regexp_extract_all(text, '[0-9A-Za-z+/_-]+') AS words FROM content),
kinds(category, shape, least) AS (VALUES ('High-entropy hex', '[0-9a-f]{{32,}}', 3.0), ('High-entropy base64', '[0-9A-Za-z+/]{{24,}}', 4.25)),
lists AS (
  SELECT dir_name, item, category, list_filter(words, lambda w: regexp_full_match(w, shape) AND list_sum(list_transform(
           list_distinct(string_split(w, '')), lambda c: -((length(w) - length(replace(w, c, ''))) / length(w))
           * log2((length(w) - length(replace(w, c, ''))) / length(w)))) >= least) AS secrets
  FROM words CROSS JOIN kinds)
SELECT dir_name, item, category, unnest(range(len(secrets)))::INTEGER AS position, unnest(secrets) AS secret FROM lists""",
    "secret_sketches": f"""WITH {PLANTED}, {_findings(BUILTIN)}
SELECT dir_name, category, count(*) AS matches, count(DISTINCT item) AS items FROM findings GROUP BY dir_name, category""",
    "retention_curve": f"""WITH {EVENTS_INVENTORY},
counted AS (
  SELECT dir_name, ((date_diff('microsecond', mtime, TIMESTAMP '2024-01-31 00:00:00') - 1) // 86400000000) * 24 AS hours,
         count(*) AS n, sum(size_bytes) AS size
  FROM inv WHERE mtime < TIMESTAMP '2024-01-31 00:00:00' GROUP BY ALL)
SELECT dir_name, hours, (sum(n) OVER w)::BIGINT AS files, (sum(size) OVER w)::BIGINT AS bytes
FROM counted WINDOW w AS (PARTITION BY dir_name ORDER BY hours DESC)""",
    "scan_recommendation": f"""WITH {DOCUMENTS}, {_findings({**BUILTIN, **CUSTOM})},
sums AS (SELECT dir_name, count(*) AS matches FROM findings GROUP BY dir_name)
SELECT dir_name, coalesce(matches, 0) AS matches, coalesce(matches, 0) > 0 AS cleanup_advised
FROM (SELECT DISTINCT dir_name FROM content) LEFT JOIN sums USING (dir_name)""",
    "scan_items": f"""WITH {DOCUMENTS}, {_findings(CUSTOM)}
SELECT dir_name, item FROM content SEMI JOIN findings USING (dir_name, item)""",
    "session_end_clean": f"""WITH {SESSIONS}, {TREE},
ran AS (SELECT max(session_end) AS as_of, count(*) AS closed_sessions FROM closed),
total AS (
  SELECT as_of, closed_sessions, count(*) FILTER (WHERE mtime < as_of - INTERVAL 10 HOUR) AS files,
         coalesce(sum(size_bytes) FILTER (WHERE mtime < as_of - INTERVAL 10 HOUR), 0)::BIGINT AS bytes,
         count(*) FILTER (WHERE mtime >= as_of - INTERVAL 10 HOUR) AS files_left
  FROM ran CROSS JOIN files GROUP BY as_of, closed_sessions)
SELECT *, CASE WHEN files = 0 THEN 'No files older than 10h found'
               ELSE 'Cleanup complete: ' || files || ' files processed' END AS message FROM total""",
    "session_end_trigger": f"WITH {SESSIONS} SELECT user_id, session_start, session_end, events FROM closed",
    "session_end_run": f"""WITH {SESSIONS}, {EVENTS_INVENTORY},
ran AS (SELECT max(session_end) AS as_of, count(*) AS closed_sessions FROM closed),
total AS (
  SELECT as_of, closed_sessions, count(path) AS files, coalesce(sum(size_bytes), 0)::BIGINT AS bytes
  FROM ran LEFT JOIN inv ON mtime < as_of - INTERVAL 168 HOUR
  WHERE closed_sessions > 0 GROUP BY as_of, closed_sessions)
SELECT *, 168 AS retention_hours, 'Starting cleanup (retention: 168h, dry_run: True)' AS start,
       CASE WHEN files = 0 THEN 'No files older than 168h found'
            ELSE 'Cleanup complete: ' || files || ' files processed' END AS message,
       CASE WHEN files = 0 THEN '[retention] No old files to clean'
            ELSE '[retention] Would clean ' || files || ' files (' || {_size('bytes')} || ')' END AS session_message
FROM total""",
    "session_end_batches": f"""WITH {SESSIONS}, {EVENTS_INVENTORY},
parts AS (
  SELECT CASE WHEN ts < DATE '2024-01-11' THEN 1 WHEN ts < DATE '2024-01-21' THEN 2 ELSE 3 END AS part,
         date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR AS mark
  FROM events WHERE ts IS NOT NULL GROUP BY part),
marks AS (SELECT mark, lag(mark, 1, TIMESTAMP '0001-01-01 00:00:00') OVER (ORDER BY part) AS before FROM parts),
ran AS (
  SELECT max(session_end) AS as_of, count(*) AS closed_sessions
  FROM sessions JOIN marks ON session_end <= mark AND session_end > before GROUP BY mark),
total AS (
  SELECT as_of, closed_sessions, count(path) AS files, coalesce(sum(size_bytes), 0)::BIGINT AS bytes
  FROM ran LEFT JOIN inv ON mtime < as_of - INTERVAL 168 HOUR
  WHERE closed_sessions > 0 GROUP BY as_of, closed_sessions)
SELECT *, 168 AS retention_hours, 'Starting cleanup (retention: 168h, dry_run: True)' AS start,
       CASE WHEN files = 0 THEN 'No files older than 168h found'
            ELSE 'Cleanup complete: ' || files || ' files processed' END AS message,
       CASE WHEN files = 0 THEN '[retention] No old files to clean'
            ELSE '[retention] Would clean ' || files || ' files (' || {_size('bytes')} || ')' END AS session_message
FROM total""",
}
# However files are read, the same is found.
ORACLE_SQL["tree_scan_parts"] = ORACLE_SQL["tree_scan"]
