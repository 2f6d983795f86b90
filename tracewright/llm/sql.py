"""SQL of the queries on training data, in the dialect of the checking database."""

TERM_COUNTS = r"""
  SELECT file_name, term, sum(cnt)::BIGINT AS tf FROM (
    SELECT file_name, chunk_no, token, arg_max(count, loaded_at) AS cnt,
      lower(rtrim(trim(token, ' '), '''')) AS term
    FROM per_file_counts WHERE file_name IS NOT NULL AND trim(token, ' ') <> ''
    GROUP BY file_name, chunk_no, token
  ) WHERE cnt >= 1 AND NOT regexp_matches(term, '^(a[0-3]|pid)=')
  GROUP BY file_name, term
"""

P2_FREQUENCY = f"""
WITH tf AS ({TERM_COUNTS}), n AS (SELECT count(DISTINCT file_name) AS n FROM per_file_counts)
SELECT term AS token, sum(tf)::BIGINT AS occurrences, count(*) AS files,
  CASE WHEN count(*) = 1 THEN 'rare' WHEN count(*) * 100 > any_value(n) * 95 THEN 'common' ELSE 'kept' END AS mark
FROM tf, n GROUP BY term
"""
P2_FOUND = f"SELECT token, mark FROM ({P2_FREQUENCY}) WHERE mark <> 'kept'"

P3_SCORES = f"""
WITH tf AS ({TERM_COUNTS}), n AS (SELECT count(DISTINCT file_name) AS n FROM per_file_counts),
dl AS (SELECT file_name, sum(tf)::BIGINT AS dl FROM tf GROUP BY file_name),
df AS (SELECT term, sum(tf)::BIGINT AS cf, count(*) AS df FROM tf GROUP BY term),
whole AS (SELECT sum(dl)::BIGINT AS total, count(*) AS files FROM dl)
SELECT file_name, term AS token, tf, dl, cf, df, n, total,
  ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / (total / files))) AS score
FROM tf JOIN dl USING (file_name) JOIN df USING (term), n, whole
"""
P3_RELEVANCE = f"SELECT file_name, token, tf, round(score, 6) AS score FROM ({P3_SCORES})"
P3_FOUND = f"""
SELECT file_name, token FROM ({P3_SCORES})
WHERE tf * 10 >= dl AND tf::HUGEINT * total >= cf::HUGEINT * dl * 10 AND df >= 2 AND df * 10 <= n
"""

_FORM = r"regexp_replace(lower({0}), '[-_.\s]+', '-', 'g')"
P7_FOUND = rf"""
WITH RECURSIVE hop AS (
  SELECT {_FORM.format('skill')} AS name, arg_max({_FORM.format('renamed_to')}, added_at) AS next
  FROM skill_catalog WHERE skill IS NOT NULL AND renamed_to IS NOT NULL GROUP BY 1
), files AS (
  SELECT DISTINCT file_name, {_FORM.format(
    "CASE WHEN regexp_matches(file_name, '(?is)^.*_prompt_[0-9]+_audit-logs[.]log$')"
    " THEN regexp_extract(file_name, '(?is)^(.*)_prompt_[0-9]+_audit-logs[.]log$', 1)"
    " ELSE regexp_replace(file_name, '(?i)_audit-logs[.]log$', '') END")} AS name
  FROM sample_features WHERE file_name IS NOT NULL
), walk AS (
  SELECT name AS origin, name AS place, 0 AS n FROM (SELECT DISTINCT name FROM files)
  UNION ALL SELECT origin, next, n + 1 FROM walk JOIN hop ON walk.place = hop.name WHERE n < 1000
)
SELECT file_name, arg_max(place, n) AS group_key FROM files JOIN walk ON files.name = walk.origin GROUP BY file_name
"""

P4_FOUND = r"""
WITH r AS (
  SELECT DISTINCT session_id, line_no, entry_id, type, message FROM session_log WHERE session_id IS NOT NULL AND line_no IS NOT NULL
), m AS (
  SELECT session_id, line_no, entry_id, message.role AS role,
    CASE regexp_replace(lower(message.role), '[\s_\-]+', '', 'g') WHEN 'user' THEN 'user' WHEN 'human' THEN 'user' WHEN 'assistant' THEN 'assistant' WHEN 'ai' THEN 'assistant'
      WHEN 'agent' THEN 'assistant' WHEN 'model' THEN 'assistant' WHEN 'tool' THEN 'tool' WHEN 'toolresult' THEN 'tool' WHEN 'environment' THEN 'tool' WHEN 'system' THEN 'system' END AS sp,
    coalesce(list_transform(list_filter(message.content, lambda i: i.type = 'text' AND regexp_matches(i.text, '\S')), lambda i: i.text), []) AS texts,
    coalesce(list_transform(list_filter(message.content, lambda i: i.type = 'toolCall'), lambda i: i.id), []) AS calls,
    coalesce(list_distinct(list_filter(list_transform(message.content, lambda i: i.id), lambda x: x IS NOT NULL)), []) AS ids
  FROM r WHERE type = 'message'
), c AS (
  SELECT *, lag(sp) OVER w AS sp_before, lag(texts) OVER w AS texts_before FROM m
  WHERE sp = 'tool' OR sp IS NOT NULL AND (len(texts) > 0 OR len(calls) > 0) WINDOW w AS (PARTITION BY session_id ORDER BY line_no)
), k AS (
  SELECT session_id, line_no, entry_id, sp, calls, ids, row_number() OVER (PARTITION BY session_id ORDER BY line_no) AS turn_no,
    count(*) FILTER (sp = 'user') OVER (PARTITION BY session_id ORDER BY line_no) AS asked
  FROM c WHERE NOT (sp = 'assistant' AND len(calls) = 0 AND coalesce(sp_before = 'assistant' AND texts_before = texts, false))
), call AS (SELECT session_id, line_no, unnest(calls) AS id FROM k WHERE len(calls) > 0),
reply AS (SELECT session_id, line_no, unnest(ids) AS id FROM k WHERE sp = 'tool' AND len(ids) > 0),
bad AS (
  SELECT session_id FROM r GROUP BY session_id HAVING min(line_no) < 1 OR count(DISTINCT line_no) <> max(line_no)
  UNION ALL SELECT session_id FROM m WHERE role IS NULL
  UNION ALL SELECT session_id FROM k WHERE sp = 'tool' AND len(ids) = 0
  UNION ALL SELECT a.session_id FROM reply a WHERE NOT EXISTS (SELECT 1 FROM call b WHERE b.session_id = a.session_id AND b.id = a.id AND b.line_no < a.line_no)
  UNION ALL SELECT a.session_id FROM call a WHERE NOT EXISTS (SELECT 1 FROM reply b WHERE b.session_id = a.session_id AND b.id = a.id AND b.line_no > a.line_no)
  UNION ALL SELECT session_id FROM k WHERE asked > 0 GROUP BY session_id, asked HAVING count(*) FILTER (sp = 'assistant') = 0
  UNION ALL SELECT session_id FROM k GROUP BY session_id HAVING count(*) FILTER (sp = 'user') = 0
)
SELECT session_id, turn_no, entry_id FROM k WHERE session_id NOT IN (SELECT session_id FROM bad)
"""
