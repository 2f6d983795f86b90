"""SQL of the pipeline queries, in the dialect of the checking database."""

from tracewright.plans import reference_sql as ref

_R = ref.ORACLE
_NAME = ref._NAME
_LAST = f"""SELECT name, label FROM (SELECT {_NAME.format('sample_id')} AS name, label, row_number() OVER (PARTITION BY {_NAME.format('sample_id')} ORDER BY scored_at DESC NULLS LAST, result_id DESC, label DESC) AS r
  FROM results WHERE sample_id IS NOT NULL AND label IS NOT NULL) WHERE r = 1"""
_JUDGED = r"regexp_extract(text, '(?i)<Judgment>\s*(safe|unsafe)\s*</Judgment>', 1)"
_UNSAFE = f"CASE WHEN {_JUDGED} <> '' THEN (lower({_JUDGED}) = 'unsafe')::INT ELSE coalesce(contains(lower(text), 'unsafe'), false)::INT END"
_PACKET = """SELECT event_id, user_id, ts, event_type AS kind, event_type IN ('click', 'view', 'signup') AS up, event_type IN ('signup', 'error') AS udp,
  'u' || user_id || '-' || event_id // 5000 || '.pcap' AS file, '10.' || user_id % 65536 // 256 || '.' || user_id % 256 || '.7' AS near, '203.0.113.' || event_id % 50 + 1 AS far,
  CASE event_type WHEN 'click' THEN 75 WHEN 'view' THEN 40 WHEN 'signup' THEN 31 + length((event_id % 11)::VARCHAR) WHEN 'error' THEN 31 + length((event_id % 11)::VARCHAR) ELSE 2 END AS payload,
  CASE event_type WHEN 'click' THEN 443 WHEN 'view' THEN 80 WHEN 'signup' THEN 53 WHEN 'error' THEN 53 ELSE 443 END AS port FROM events"""
_ROWS = f"""SELECT file, row_number() OVER (PARTITION BY file ORDER BY event_id) - 1 AS pkt_idx, round(epoch_us(ts) / 1e6::DOUBLE, 3) AS ts, (34 + CASE WHEN udp THEN 8 ELSE 20 END + payload)::INT AS length,
  (20 + CASE WHEN udp THEN 8 ELSE 20 END + payload)::INT AS ip_len, CASE WHEN up THEN near ELSE far END AS src, CASE WHEN up THEN far ELSE near END AS dst, CASE WHEN udp THEN 'udp' ELSE 'tcp' END AS proto,
  (CASE WHEN up THEN own ELSE port END)::INT AS sport, (CASE WHEN up THEN port ELSE own END)::INT AS dport, payload::INT AS payload, CASE WHEN udp THEN 'd' || event_id % 11 || '.example.net' END AS dns, up, far
  FROM (SELECT *, CASE WHEN udp THEN 50000 ELSE 40000 + user_id % 1000 END AS own FROM ({_PACKET}))"""
_NAMES = f"""SELECT DISTINCT file, 'dns' AS kind, 'd' || event_id % 11 || '.example.net' AS value FROM ({_PACKET}) WHERE udp
  UNION SELECT file, 'sni', 't' || user_id % 9 || '.example.com' FROM ({_PACKET}) WHERE kind = 'click'
  UNION SELECT file, 'host', 'w' || user_id % 7 || '.example.org' FROM ({_PACKET}) WHERE kind = 'view'
  UNION SELECT file, 'ip', far FROM ({_PACKET})"""
_AUDIT_WORDS = r"SELECT file_name, term, count(*) AS tf FROM (SELECT file_name, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]{2,}')) AS term FROM d) GROUP BY ALL"
_MESSAGES = """
m AS (SELECT DISTINCT session_id, line_no, message.role AS role, message.api AS api, message.content AS content FROM session_log
  WHERE type = 'message' AND message.role IS NOT NULL AND message.content IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY line_no) AS n, to_json(content)::VARCHAR AS said,
  list_transform(list_filter(content, lambda i: i.type = 'text' AND i.text IS NOT NULL), lambda i: i.text) AS texts FROM m),
w AS (
  SELECT session_id, n, true AS keep, role, api, said, texts FROM o WHERE n = 1
  UNION ALL
  SELECT session_id, n, keep, CASE WHEN keep THEN new.role ELSE old.role END, CASE WHEN keep THEN new.api ELSE old.api END, CASE WHEN keep THEN new.said ELSE old.said END, CASE WHEN keep THEN new.texts ELSE old.texts END
  FROM (SELECT o.session_id, o.n, o AS new, w AS old, NOT (o.role = 'assistant' AND w.role = 'assistant' AND (o.said = w.said
    OR coalesce(o.api = 'cli' AND w.api = 'openai-completions' AND len(o.texts) > 0 AND o.texts = w.texts, false))) AS keep
    FROM o JOIN w ON o.session_id = w.session_id AND o.n = w.n + 1)
), k AS (SELECT o.* FROM o JOIN w ON o.session_id = w.session_id AND o.n = w.n WHERE w.keep),
c AS (SELECT *, list_transform(list_filter(content, lambda i: i.type = 'toolCall'), lambda i: {'id': i.id, 'name': i.name, 'arguments': i.arguments}) AS calls, array_to_string(texts, chr(10)) AS words FROM k),
t AS (SELECT * FROM (SELECT session_id, line_no, CASE role WHEN 'user' THEN 'user' WHEN 'assistant' THEN 'agent' WHEN 'toolResult' THEN 'environment' END AS role,
  CASE role WHEN 'user' THEN words WHEN 'toolResult' THEN CASE WHEN len(texts) = 0 AND len(content) > 0 THEN said ELSE words END END AS content, words AS thought,
  CASE WHEN len(calls) = 1 THEN to_json(calls[1])::VARCHAR WHEN len(calls) > 1 THEN to_json(calls)::VARCHAR ELSE '' END AS action FROM c)
  WHERE role IS NOT NULL AND (role <> 'agent' OR thought <> '' OR action <> ''))
"""
_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_PART = f"""CASE WHEN role = 'user' AND content <> '' THEN chr(10) || '[USER]: ' || content WHEN role = 'environment' AND content <> '' THEN chr(10) || '[ENVIRONMENT]: ' || content
  WHEN role = 'agent' THEN chr(10) || '[AGENT]:' || chr(10) || concat_ws(chr(10), CASE WHEN thought <> '' THEN '[THOUGHT]: ' || {_STRIP.format('thought')} END, CASE WHEN action <> '' THEN '[ACTION]: ' || {_STRIP.format('action')} END) END"""
_BLANK = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{0b}]*"
_FUSION = [f"ln(1 + greatest(host_numeric[{i + 1}], 0))" if i in (0, 1, 2, 7) else f"host_numeric[{i + 1}]" for i in range(8)]
_FUSION += [f"ln(1 + greatest(net_numeric[{i + 1}], 0))" if i in ref._LOGGED else f"net_numeric[{i + 1}]" for i in range(15)]
_FUSION += [f"coalesce({c}, false)::INT::DOUBLE" for c in ("has_audit", "has_pcap")]

ORACLE = {
    "token_table": ref._FACTS,
    "corpus_from_table": _R["capped_document"],
    "token_database": f"SELECT token, sum(count)::BIGINT AS total_count FROM ({ref._FACTS}) WHERE NOT {ref._SKIP} GROUP BY token",
    "token_counts_report": f"SELECT token, c AS count, format('{{:.4f}}', round(c::DOUBLE / n, 4)) AS avg FROM (SELECT token, sum(count)::BIGINT AS c FROM ({ref._FACTS}) WHERE NOT {ref._SKIP} GROUP BY token), (SELECT count(DISTINCT file_name) AS n FROM ({ref._FACTS}))",
    "distribution_report": _R["token_distribution"],
    "union_manifest": f"SELECT name || '_audit-logs.log' AS file_name, 1::INT AS label, has_audit, has_pcap, pcap_file FROM ({_R['session_manifest']})",
    "unified_manifest": f"SELECT name || '_audit-logs.log' AS file_name, 0::INT AS label, name || '_network.pcap' AS pcap_file FROM ({_R['sessions_both']})",
    "metrics_report": _R["classification_metrics"],
    "fold_report": _R["fold_metrics"],
    "truth_labels": f"SELECT name AS sample_id, label FROM ({_LAST})",
    "constant_labels": f"SELECT DISTINCT {_NAME.format('file_name')} AS sample_id, 1::INT AS label FROM sample_features WHERE file_name IS NOT NULL",
    "keyword_list": "SELECT DISTINCT skill AS keyword FROM skill_catalog WHERE trim(skill) <> ''",
    "last_result": f"SELECT name, result_id, detector FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY result_id DESC) AS r FROM (SELECT DISTINCT {_NAME.format('sample_id')} AS name, result_id, detector FROM results WHERE sample_id IS NOT NULL)) WHERE r = 1",
    "resolved_samples": " UNION ALL ".join(f"SELECT '{m}' AS mode, name FROM ({q})" for m, q in (("fusion", _R["sessions_union"]), ("audit_only", ref._AUDIT), ("pcap_only", ref._PCAP), ("fusion_both", _R["sessions_both"]))),
    "separators": f"SELECT file_name, line_no, replace(msg, chr(29), ' ') AS msg FROM ({ref._READ})",
    "judged": f"SELECT doc_id, {_UNSAFE} AS unsafe FROM documents",
    "unsafe_sessions": f"SELECT source, bool_or({_UNSAFE} = 1) AS unsafe FROM documents GROUP BY source",
    "masked_counters": "SELECT file_name, built_at, " + ", ".join(f"CASE WHEN coalesce(has_audit, false) AND host_numeric IS NOT NULL THEN round(host_numeric[{i + 1}], 6) ELSE 0 END AS x{i}" for i in range(8)) + " FROM sample_features",
    "fusion_numbers": "SELECT file_name, built_at, " + ", ".join(f"round({e}, 6) AS x{i}" for i, e in enumerate(_FUSION)) + " FROM sample_features WHERE host_numeric IS NOT NULL AND net_numeric IS NOT NULL",
    "tfidf_audit": f"""WITH d AS (SELECT file_name, max(audit_text) AS text FROM sample_features WHERE file_name IS NOT NULL GROUP BY file_name), c AS ({_AUDIT_WORDS}),
      v AS (SELECT term, ln((1 + n)::DOUBLE / (1 + df)) + 1 AS idf FROM (SELECT term, count(*) AS df FROM c GROUP BY term), (SELECT count(*) AS n FROM d) WHERE df >= 2 AND df <= n * 0.95::DOUBLE),
      w AS (SELECT file_name, term, (1 + ln(tf)) * idf AS w FROM c JOIN v USING (term)), n AS (SELECT file_name, sqrt(sum(w * w)) AS norm FROM w GROUP BY file_name)
      SELECT file_name, term, round(w / norm, 6) AS weight FROM w JOIN n USING (file_name)""",
    "embedding_cache": f"SELECT doc_id, CASE WHEN text IS NULL OR regexp_full_match(text, '{_BLANK}') THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS squared FROM documents",
    "fold_check": f"SELECT count(DISTINCT skill) AS groups, count(*) AS records, least(count(DISTINCT skill), 10)::BIGINT AS folds, 0::BIGINT AS leaking FROM (SELECT {ref._SKILL} AS skill FROM sample_features WHERE file_name IS NOT NULL)",
    "wrong_report": f"SELECT name, wrong_folds FROM ({_R['misclassified_summary']})",
    "mixed_first": f"SELECT * FROM ({_R['mixed_label_groups']}) ORDER BY skill LIMIT 5",
    "packet_rows": _ROWS,
    "packet_names": _NAMES,
    "packet_features": f"""SELECT file, packet_count, total_bytes, up_bytes, total_bytes - up_bytes AS down_bytes, pkt_len_min, pkt_len_max, dns_domain_count, sni_count, http_host_count, net_text FROM
      (SELECT file, count(*) AS packet_count, sum(ip_len)::BIGINT AS total_bytes, coalesce(sum(ip_len) FILTER (up), 0)::BIGINT AS up_bytes, min(length)::BIGINT AS pkt_len_min, max(length)::BIGINT AS pkt_len_max FROM ({_ROWS}) GROUP BY file) JOIN
      (SELECT file, count(*) FILTER (kind = 'dns') AS dns_domain_count, count(*) FILTER (kind = 'sni') AS sni_count, count(*) FILTER (kind = 'host') AS http_host_count,
        string_agg(kind || ':' || value, ' ' ORDER BY list_position(['dns', 'sni', 'host', 'ip'], kind), value) AS net_text FROM ({_NAMES}) GROUP BY file) USING (file)""",
    "conversation_dedup": f"WITH RECURSIVE {_MESSAGES} SELECT session_id, line_no, role FROM k",
    "conversation_rounds": f"""WITH RECURSIVE {_MESSAGES}, s AS (SELECT *, (role = 'user' OR row_number() OVER (PARTITION BY session_id ORDER BY line_no) = 1)::INT AS starts FROM t)
      SELECT session_id, line_no, role, sum(starts) OVER (PARTITION BY session_id ORDER BY line_no)::BIGINT AS round_no FROM s""",
    "conversation_render": f"""WITH RECURSIVE {_MESSAGES} SELECT session_id, '=== Agent Profile ===' || chr(10) || 'Agent with access to tools.' || chr(10) || chr(10) || '=== Conversation History ==='
      || coalesce(chr(10) || string_agg({_PART}, chr(10) ORDER BY line_no), '') AS text FROM t GROUP BY session_id""",
}
