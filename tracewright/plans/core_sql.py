"""SQL of the core queries on problems 1, 5 and 6, in the dialect of the checking database."""

_P1_NAME = r"regexp_replace(lower(trim({0}, ' ' || chr(9) || chr(65279))), '(_audit-logs\.log|_network\.pcap)$', '')"

P1_FOUND = f"""
WITH parents AS (
  SELECT 'audit' AS parent, {_P1_NAME.format('file_name')} AS name, deleted_at IS NOT NULL AS gone, received_at AS came FROM audit_files
  UNION ALL SELECT 'pcap', {_P1_NAME.format('pcap_name')}, deleted_at IS NOT NULL, received_at FROM pcap_files
  UNION ALL SELECT 'sample', {_P1_NAME.format('file_name')}, retired_at IS NOT NULL, built_at FROM sample_features
), keys AS (
  SELECT parent, name, bool_or(NOT gone) AS live, min(came) FILTER (WHERE NOT gone) AS first_came
  FROM parents WHERE name IS NOT NULL GROUP BY ALL
), refs AS (
  SELECT 'audit' AS ref_name, {_P1_NAME.format('file_name')} AS name, file_name AS record_key, built_at AS ref_at FROM sample_features WHERE has_audit
  UNION ALL SELECT 'pcap', {_P1_NAME.format('file_name')}, file_name, built_at FROM sample_features WHERE has_pcap
  UNION ALL SELECT 'sample', {_P1_NAME.format('sample_id')}, CAST(result_id AS VARCHAR), scored_at FROM results WHERE sample_id IS NOT NULL
)
SELECT DISTINCT ref_name, record_key, coalesce(strftime(ref_at, '%Y-%m'), 'unknown') AS period,
  CASE WHEN k.name IS NULL THEN 'missing' WHEN NOT live THEN 'deleted' ELSE 'late' END AS status
FROM refs r LEFT JOIN keys k ON k.parent = r.ref_name AND k.name = r.name
WHERE k.name IS NULL OR NOT live OR first_came > ref_at
"""

P1_REPORT = f"""
SELECT ref_name, period, status, count(*) AS n FROM ({P1_FOUND}) GROUP BY ref_name, period, status
"""

P6_ITEMS = """
WITH e AS (SELECT DISTINCT entry_id, session_id, line_no, message.content AS content FROM session_log WHERE entry_id IS NOT NULL AND message.content IS NOT NULL),
i AS (SELECT entry_id, session_id, line_no, content, unnest(range(len(content))) AS item_no FROM e)
SELECT entry_id, session_id, line_no, item_no, content[item_no + 1].type AS item_type, content[item_no + 1].id AS call_id,
  content[item_no + 1].name AS item_name, content[item_no + 1].text AS text, content[item_no + 1].arguments AS arguments
FROM i
"""
P6_CALLS = f"SELECT entry_id, session_id, line_no, item_no, call_id, item_name, arguments FROM ({P6_ITEMS}) WHERE item_type = 'toolCall'"

_ISO = r"\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d[.,]\d+(?:Z|[+-]\d\d:\d\d)?"
_MONTHS = "['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec']"
#: Layouts by name: (pattern of a head, group of the level or 0, group of the component); the first group is the time.
_LAYOUTS = {
    "clf": (r"^(\d+/\w+/\d+:[\d:.]+ [+-]\d{4}) (\w+) ([^ :]+): ", 2, 3),
    "dash": (rf"^({_ISO}) - (\S+) - (\w+) - ", 3, 2),
    "bracket": (rf"^\[({_ISO})\]\s\[(\w+)\]\s\[([^\]]+)\]", 2, 3),
    "syslog": (rf"^<\d+>1 ({_ISO}) \S+ (\S+) \S+ ", 0, 2),
    "glog": (r"^([A-Z]\d{4} \d\d:\d\d:\d\d\.\d+) +\d+ ([\w.]+):\d+\] ", 0, 2),
    "level": (rf"^time=({_ISO}) level=(\w+) component=(\S+) msg=", 2, 3),
    "component": (rf"^time=({_ISO}) component=(\S+) level=(\w+) msg=", 3, 2),
    "bsd": (r"^(?:<\d+>)?([A-Z][a-z]{2} [ \d]\d \d\d:\d\d:\d\d) \S+ (\w+)(?:\[\d+\])?: ", 0, 2),
}
_AUDIT = r"^(?:node=\S+ )?type=(\w+) msg=audit\((\d+\.\d+):\d+\)"
_OBJECT = r"""^\{\s*"(ts|logger)":"""


def _by_layout(part: int) -> str:
    cases = []
    for name, (pattern, level, component) in _LAYOUTS.items():
        group = (1, level, component)[part]
        cases.append(f"WHEN '{name}' THEN " + (f"regexp_extract(line, '{pattern}', {group})" if group else "substr(stamp_of, 1, 1)" if name == "glog" else "''"))
    audit = (f"regexp_extract(line, '{_AUDIT}', 2)", "''", f"regexp_extract(line, '{_AUDIT}', 1)")[part]
    member = ("ts", "lvl", "logger")[part]
    return " ".join(cases) + f" WHEN 'audit' THEN {audit} WHEN 'object' THEN json_extract_string(line, '$.{member}')"


def _member(name: str) -> str:
    value = f"""regexp_extract(line, '^\\s*"{name}":\\s*"?([^",]*)"?,?$', 1)"""
    return f"""arg_min({value}, line_no) FILTER (starts AND kind <> 'open' OR regexp_matches(line, '^\\s*"{name}":'))"""


P5_FOUND = rf"""
WITH years AS (SELECT file_name, year(min(started_at)) AS y FROM audit_files GROUP BY file_name),
lines AS (SELECT file_name, line_no::BIGINT AS line_no, regexp_replace(regexp_replace(max(msg), '\x1b\[[0-9;]*m', '', 'g'), '\r+$', '') AS line FROM audit_raw GROUP BY ALL),
kinds AS (
  SELECT *, CASE {' '.join(f"WHEN regexp_matches(line, '{p}') THEN '{n}'" for n, (p, _, _) in _LAYOUTS.items())} WHEN regexp_matches(line, '{_AUDIT}') THEN 'audit'
    WHEN regexp_matches(line, '{_OBJECT}') AND json_valid(line) THEN 'object'
    WHEN line = '{{' AND regexp_matches(lead(line) OVER w, '^\s*"(ts|logger)":') THEN 'open' END AS kind
  FROM lines WINDOW w AS (PARTITION BY file_name ORDER BY line_no)
), marked AS (
  SELECT *, kind IS NOT NULL AS starts, max(CASE WHEN kind IS NOT NULL THEN line_no END) OVER (PARTITION BY file_name ORDER BY line_no) AS entry FROM kinds
), stamped AS (SELECT *, CASE kind {_by_layout(0)} END AS stamp_of FROM marked WHERE entry IS NOT NULL
), fields AS (SELECT *, CASE kind {_by_layout(1)} END AS level_of, CASE kind {_by_layout(2)} END AS component_of FROM stamped
), entries AS (
  SELECT file_name, entry AS first_line, max(line_no) FILTER (regexp_matches(line, '\S')) AS last_line, max(kind) AS kind,
    CASE WHEN max(kind) = 'open' THEN {_member('ts')} ELSE max(stamp_of) END AS stamp,
    CASE WHEN max(kind) = 'open' THEN {_member('lvl')} ELSE max(level_of) END AS level,
    CASE WHEN max(kind) = 'open' THEN {_member('logger')} ELSE max(component_of) END AS component
  FROM fields GROUP BY file_name, entry
), timed AS (
  SELECT *, CASE
    WHEN regexp_matches(stamp, '^\d{{13}}$') THEN make_timestamp(try_cast(stamp AS BIGINT) * 1000)
    WHEN regexp_matches(stamp, '^\d{{10}}\.\d{{3}}$') THEN make_timestamp(try_cast(replace(stamp, '.', '') AS BIGINT) * 1000)
    WHEN kind = 'clf' THEN strptime(regexp_extract(stamp, '^(\S+) ', 1), '%d/%b/%Y:%H:%M:%S.%g')
      - to_minutes((CASE WHEN substr(stamp, -5, 1) = '-' THEN -1 ELSE 1 END) * (substr(stamp, -4, 2)::INT * 60 + substr(stamp, -2, 2)::INT))
    WHEN kind = 'glog' THEN try_cast(y || '-' || substr(stamp, 2, 2) || '-' || substr(stamp, 4, 2) || ' ' || substr(stamp, 7) AS TIMESTAMP)
    WHEN kind = 'bsd' THEN try_cast(y || '-' || lpad(list_position({_MONTHS}, substr(stamp, 1, 3))::VARCHAR, 2, '0') || '-' || lpad(trim(substr(stamp, 5, 2)), 2, '0') || ' ' || substr(stamp, 8) AS TIMESTAMP)
    ELSE try_cast(replace(regexp_extract(stamp, '^(\d{{4}}-\d\d-\d\d[T ][\d:.,]+)', 1), ',', '.') AS TIMESTAMP)
      - to_minutes(CASE WHEN regexp_matches(stamp, '[+-]\d\d:\d\d$') THEN (CASE WHEN substr(stamp, -6, 1) = '-' THEN -1 ELSE 1 END) * (substr(stamp, -5, 2)::INT * 60 + substr(stamp, -2, 2)::INT) ELSE 0 END)
    END AS at_time FROM entries LEFT JOIN years USING (file_name)
)
SELECT file_name, first_line, last_line, strftime(at_time, '%Y-%m-%d %H:%M:%S.%g') AS logged_at,
  CASE upper(substr(coalesce(level, ''), 1, 1)) WHEN 'D' THEN 'DEBUG' WHEN 'I' THEN 'INFO' WHEN 'W' THEN 'WARN' WHEN 'E' THEN 'ERROR' WHEN 'F' THEN 'FATAL' WHEN 'C' THEN 'FATAL' ELSE '' END AS log_level,
  coalesce(component, '') AS component
FROM timed
"""
