"""SQL of the reference queries, in the dialect of the checking database."""

_NAME = r"regexp_replace(lower(trim({0}, ' ' || chr(9) || chr(65279))), '(_audit-logs\.log|_network\.pcap)$', '')"
_AUDIT = f"SELECT DISTINCT {_NAME.format('file_name')} AS name FROM audit_files WHERE file_name IS NOT NULL"
_PCAP = f"SELECT DISTINCT {_NAME.format('pcap_name')} AS name FROM pcap_files WHERE pcap_name IS NOT NULL"
_READ = "SELECT file_name, line_no, max(msg) AS msg FROM audit_raw GROUP BY ALL"
_KV = r"""'\b([a-zA-Z][\w-]*)=("[^"]*"|\([^)]*\)|[^\s\x1c-\x1f]+)'"""
_LINE = f"""SELECT file_name, line_no, list_filter(list_transform(list_transform(regexp_extract_all(msg, {_KV}, 0), lambda m: regexp_replace(lower(m), '''+$', '')),
  lambda t: CASE WHEN regexp_matches(t, '^[^=]*="$') THEN t || '"' ELSE t END), lambda t: NOT starts_with(t, 'msg=')) AS t FROM ({_READ}) WHERE msg IS NOT NULL"""
_PER_FILE = f"SELECT file_name, token, count(*) AS count FROM (SELECT file_name, unnest(t) AS token FROM ({_LINE})) GROUP BY ALL"
_FACTS = """SELECT file_name, token, sum(c)::BIGINT AS count FROM (SELECT file_name, chunk_no, token, arg_max(count, loaded_at) AS c FROM per_file_counts
  WHERE file_name IS NOT NULL AND trim(token, ' ') <> '' GROUP BY ALL) WHERE c >= 1 GROUP BY ALL"""
_SKIP = "regexp_matches(token, '^(a[0-3]|pid)=')"
_RESULTS = "SELECT DISTINCT * FROM results"
_SCORED = "SELECT *, result_id % 10 AS fold FROM (SELECT DISTINCT * FROM results) WHERE label IN (0, 1) AND pred IN (0, 1)"
_CELLS = """count(*) FILTER (label = 1 AND coalesce(pred = 1, false)) AS tp, count(*) FILTER (label = 0 AND NOT coalesce(pred = 1, false)) AS tn,
  count(*) FILTER (label = 0 AND coalesce(pred = 1, false)) AS fp, count(*) FILTER (label = 1 AND NOT coalesce(pred = 1, false)) AS fn"""
_PERCENT = """round(coalesce((tp + tn) * 100.0::DOUBLE / nullif(total, 0), 0), 6) AS accuracy, round(coalesce(tp * 100.0::DOUBLE / nullif(tp + fn, 0), 0), 6) AS recall,
  round(coalesce(fp * 100.0::DOUBLE / nullif(fp + tn, 0), 0), 6) AS fpr"""
_QUALITY = """round(coalesce((tp + tn)::DOUBLE / nullif(total, 0), 0), {0}) AS accuracy, round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), {0}) AS precision,
  round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), {0}) AS recall, round(coalesce(2 * tp::DOUBLE / nullif(2 * tp + fp + fn, 0), 0), {0}) AS f1"""
_SKILL = r"""CASE WHEN regexp_extract(file_name, '^(.+)_prompt_\d+_audit-logs\.log$', 1) <> '' THEN regexp_extract(file_name, '^(.+)_prompt_\d+_audit-logs\.log$', 1)
  ELSE regexp_replace(file_name, '\.[^.]*$', '') END"""
_FOLDS = f"""SELECT fold, n - total AS train_size, total AS test_size, zero - test_innocent AS train_innocent, one - test_malicious AS train_malicious,
  test_innocent, test_malicious, {_QUALITY.format(4)}, tn, fp, fn, tp
  FROM (SELECT fold, count(*) AS total, count(*) FILTER (label = 0) AS test_innocent, count(*) FILTER (label = 1) AS test_malicious, {_CELLS} FROM ({_SCORED}) GROUP BY fold),
  (SELECT count(*) AS n, count(*) FILTER (label = 0) AS zero, count(*) FILTER (label = 1) AS one FROM ({_SCORED}))"""
_GAPS = "SELECT user_id, event_id, value, event_type, CASE WHEN d IS NOT NULL THEN greatest(d, 0.0::DOUBLE) END AS gap FROM (SELECT *, s - lag(s) OVER (PARTITION BY user_id ORDER BY event_id) AS d FROM (SELECT *, epoch_us(ts)::DOUBLE / 1e6::DOUBLE AS s FROM events))"
_NET = """SELECT file_name, split_part(t, ':', 1) AS kind, regexp_replace(t, '^[^:]*:', '') AS value
  FROM (SELECT file_name, unnest(regexp_split_to_array(net_text, ' +')) AS t FROM sample_features WHERE net_text IS NOT NULL) WHERE contains(t, ':')"""
_WORDS = r"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]{2,}')) AS term FROM documents) GROUP BY ALL"
_VOCAB = f"""SELECT term, df, total_tf, ln((1 + n)::DOUBLE / (1 + df)) + 1 AS idf FROM (SELECT term, count(*) AS df, sum(tf)::BIGINT AS total_tf FROM ({_WORDS}) GROUP BY term),
  (SELECT count(*) AS n FROM documents) WHERE df >= 2 AND df <= n * 0.95::DOUBLE ORDER BY total_tf DESC, term LIMIT 100000"""
_TOK = r"SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0b\f\r]+'), lambda t: t <> '') AS t FROM documents"


def _windows(size: int, stride: int, starts: str) -> str:
    return f"""SELECT doc_id, k AS window_no, len(w) AS n_tokens, w[1] AS first_token, w[len(w)] AS last_token
  FROM (SELECT doc_id, k, t[k * {stride} + 1 : k * {stride} + {size}] AS w FROM (SELECT doc_id, t, unnest(range(greatest(0, {starts})::BIGINT + 1)) AS k FROM ({_TOK})))"""


def _at(rank: str) -> str:
    return f"(CASE WHEN {rank} < zeros THEN 0 ELSE vals[({rank} - zeros + 1)::BIGINT] END)"


def _percentile(p: int) -> str:
    low = f"((n - 1) * {p} // 100)"
    return f"round({_at(low)} + ({_at(f'least({low} + 1, n - 1)')} - {_at(low)}) * (((n - 1) * {p} % 100) / 100.0::DOUBLE), 4)"


_DISTRIBUTION = f"""
WITH f AS ({_FACTS}), c AS (SELECT count(DISTINCT file_name) AS n FROM f),
t AS (SELECT token, sum(count)::BIGINT AS s1, count(*) AS k, sum(count * count)::BIGINT AS s2, min(count) AS least_count, max(count) AS most, list(count ORDER BY count) AS vals FROM f WHERE NOT {_SKIP} GROUP BY token),
z AS (SELECT *, n - k AS zeros FROM t, c)
SELECT token, s1 AS total_count, round(s1 / n, 4) AS avg_per_file, n AS file_count, k AS files_with_token, zeros AS files_without_token, round(k / n, 4) AS presence_ratio,
  CASE WHEN zeros = 0 THEN least_count ELSE 0 END AS min_per_file, {_percentile(25)} AS p25_per_file, {_percentile(50)} AS median_per_file, {_percentile(75)} AS p75_per_file,
  most AS max_per_file, round(CASE WHEN n > 1 THEN sqrt(greatest((s2 - (s1 * s1) / n) / (n - 1), 0.0::DOUBLE)) ELSE 0.0::DOUBLE END, 4) AS std_per_file, round(s1 / n, 4) AS mean_per_file
FROM z
"""
_LOGGED = (0, 1, 2, 3, 5, 6, 7, 11, 12, 13, 14)
_WEIGHTS = (0.001, 0.02, -0.01, 1.5, 0.05, -0.3, 0.7, 0.002)
_SCORE = " + ".join(f"host_numeric[{i + 1}] * ({w}::DOUBLE)" for i, w in enumerate(_WEIGHTS)) + " + (-0.5::DOUBLE)"
_HOST = r"""
WITH l AS (SELECT file_name, unnest(regexp_split_to_array(coalesce(msg, ''), '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e]')) AS line FROM (""" + _READ + r""")),
c AS (SELECT file_name, contains(line, 'type=SYSCALL') AS sys, contains(line, 'success=no') AS failed, regexp_extract(line, '\bexit=(-?\d+)', 1) = '-2' AS two,
  contains(line, 'SYSCALL=execve') OR contains(line, 'syscall=59') AS exe,
  CASE WHEN regexp_matches(line, 'type=EXECVE\b') THEN coalesce(list_sum(list_transform(regexp_extract_all(line, '\ba\d+=([0-9A-Fa-f]{8,})\b', 1),
    lambda v: CASE WHEN length(v) % 2 = 0 THEN length(decode(unhex(v))) ELSE 0 END)), 0) ELSE 0 END AS chars FROM l),
n AS (SELECT file_name, count(*) FILTER (sys) AS syscall_total, count(*) FILTER (sys AND failed) AS syscall_failed, count(*) FILTER (sys AND two) AS syscall_exit_neg2,
  count(*) FILTER (sys AND exe) AS execve_total, count(*) FILTER (sys AND exe AND failed) AS execve_failed, coalesce(sum(chars) FILTER (NOT sys), 0)::BIGINT AS execve_payload_chars FROM c GROUP BY file_name)
SELECT *, round(coalesce(syscall_failed::DOUBLE / nullif(syscall_total, 0), 0), 6) AS syscall_failed_ratio, round(coalesce(execve_failed::DOUBLE / nullif(execve_total, 0), 0), 6) AS execve_failed_ratio FROM n
"""
_UNION_SETS = ("pcap", "session", "rule", "pcap+session", "pcap+rule", "session+rule", "pcap+session+rule")
_VOTES = f"""SELECT {_NAME.format('sample_id')} AS name, max(label) FILTER (label IN (0, 1)) AS label,
  {', '.join(f"bool_or(detector = '{k}' AND coalesce(pred = 1, false)) AS {k}" for k in ('pcap', 'session', 'rule'))} FROM ({_RESULTS}) WHERE sample_id IS NOT NULL GROUP BY 1"""
_UNION_ROWS = " UNION ALL ".join(f"SELECT '{s}' AS detectors, label, ({' OR '.join(f'coalesce({k}, false)' for k in s.split('+'))})::INT AS pred FROM v" for s in _UNION_SETS)

ORACLE = {
    "kv_tokens": f"SELECT file_name, line_no, pos, t[pos + 1] AS token FROM (SELECT file_name, line_no, t, unnest(range(len(t))) AS pos FROM ({_LINE}))",
    "token_counts_per_file": _PER_FILE,
    "token_counts": f"SELECT token, sum(count)::BIGINT AS total_count FROM ({_PER_FILE}) GROUP BY token",
    "token_counts_filtered": f"SELECT token, sum(count)::BIGINT AS total_count FROM ({_PER_FILE}) WHERE NOT {_SKIP} GROUP BY token",
    "top_tokens": f"SELECT token, sum(count)::BIGINT AS total_count FROM ({_PER_FILE}) GROUP BY token ORDER BY total_count DESC, token LIMIT 20",
    "file_count": f"SELECT count(DISTINCT file_name) AS file_count FROM ({_FACTS})",
    "token_distribution": _DISTRIBUTION,
    "capped_document": f"SELECT file_name, coalesce(string_agg(rtrim(repeat(token || ' ', least(greatest(count, 1), 30)::INT), ' ' ), ' ' ORDER BY token) FILTER (NOT {_SKIP}), '') AS text FROM ({_FACTS}) GROUP BY file_name",
    "host_numeric": _HOST,
    "sessions_both": f"({_AUDIT}) INTERSECT ({_PCAP})",
    "sessions_union": f"({_AUDIT}) UNION ({_PCAP})",
    "sessions_only_left": f"({_AUDIT}) EXCEPT ({_PCAP})",
    "sessions_only_right": f"({_PCAP}) EXCEPT ({_AUDIT})",
    "session_manifest": f"""SELECT coalesce(a.name, p.name) AS name, a.name IS NOT NULL AS has_audit, p.name IS NOT NULL AS has_pcap,
      CASE WHEN p.name IS NOT NULL THEN p.name || '_network.pcap' ELSE '' END AS pcap_file FROM ({_AUDIT}) a FULL JOIN ({_PCAP}) p ON a.name = p.name""",
    "modality_coverage": """SELECT count(*) FILTER (a AND p) AS both, count(*) FILTER (a AND NOT p) AS audit_only, count(*) FILTER (NOT a AND p) AS pcap_only, count(*) FILTER (NOT a AND NOT p) AS neither
      FROM (SELECT coalesce(has_audit, false) AS a, coalesce(has_pcap, false) AS p FROM sample_features)""",
    "class_union": rf"""SELECT file_name, class, skill, class || ':' || skill AS group_key, regexp_replace(file_name, '_audit-logs\.log$', '') || '_network.pcap' AS pcap_file
      FROM (SELECT file_name, CASE label WHEN 0 THEN 'innocent' ELSE 'malicious' END AS class, {_SKILL} AS skill FROM sample_features WHERE label IN (0, 1))""",
    "labels_defaulted": f"""SELECT s.name, coalesce(l.label, 0) AS label FROM (SELECT DISTINCT {_NAME.format('file_name')} AS name FROM sample_features WHERE file_name IS NOT NULL) s LEFT JOIN
      (SELECT name, label FROM (SELECT {_NAME.format('sample_id')} AS name, label, row_number() OVER (PARTITION BY {_NAME.format('sample_id')} ORDER BY scored_at DESC NULLS LAST, result_id DESC, label DESC) AS r
       FROM results WHERE sample_id IS NOT NULL AND label IS NOT NULL) WHERE r = 1) l ON s.name = l.name""",
    "sample_cap_per_class": "SELECT file_name, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY file_name) AS r FROM (SELECT DISTINCT file_name, label FROM sample_features WHERE label IN (0, 1))) WHERE r <= 100",
    "keyword_hits": "SELECT doc_id FROM documents SEMI JOIN (SELECT DISTINCT skill FROM skill_catalog WHERE trim(skill) <> '') k ON contains(text, skill)",
    "detector_metrics": f"SELECT detector, total, tp, tn, fp, fn, {_PERCENT} FROM (SELECT detector, count(*) AS total, {_CELLS} FROM ({_RESULTS}) GROUP BY detector)",
    "detector_union_metrics": f"WITH v AS ({_VOTES}) SELECT detectors, total, tp, tn, fp, fn, {_PERCENT} FROM (SELECT detectors, count(*) AS total, {_CELLS} FROM ({_UNION_ROWS}) GROUP BY detectors)",
    "classification_metrics": f"SELECT total, {_QUALITY.format(6)}, tp, tn, fp, fn FROM (SELECT count(*) AS total, {_CELLS} FROM ({_SCORED}))",
    "confusion_matrix": f"SELECT label AS actual, count(*) FILTER (pred = 0) AS pred_0, count(*) FILTER (pred = 1) AS pred_1 FROM ({_SCORED}) GROUP BY label",
    "misclassified": f"SELECT result_id, detector, label AS actual, pred AS predicted, CASE WHEN label = 0 THEN 'FP' ELSE 'FN' END AS error_type FROM ({_SCORED}) WHERE label <> pred",
    "misclassified_summary": f"""SELECT name, count(*) AS wrong_folds, count(*) FILTER (label = 0) AS fp_count, count(*) FILTER (label = 1) AS fn_count, string_agg(fold::VARCHAR, ',' ORDER BY fold) AS fold_list
      FROM (SELECT *, {_NAME.format('sample_id')} AS name FROM ({_SCORED})) WHERE name IS NOT NULL AND label <> pred GROUP BY name""",
    "prediction_table": f"""SELECT result_id, pred AS predicted, CASE pred WHEN 0 THEN 'innocent' ELSE 'malicious' END AS predicted_label, label AS actual, CASE label WHEN 0 THEN 'innocent' ELSE 'malicious' END AS actual_label,
      pred = label AS correct FROM ({_SCORED})""",
    "fold_metrics": _FOLDS,
    "fold_summary": "SELECT metric, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(min(v), 6) AS min, round(max(v), 6) AS max FROM ("
    + " UNION ALL ".join(f"SELECT '{m}' AS metric, {m} AS v FROM ({_FOLDS})" for m in ("accuracy", "precision", "recall", "f1"))
    + ") GROUP BY metric",
    "fold_leakage": f"SELECT name, count(DISTINCT fold) AS folds FROM (SELECT *, {_NAME.format('sample_id')} AS name FROM ({_SCORED})) WHERE name IS NOT NULL GROUP BY name HAVING count(DISTINCT fold) > 1",
    "mixed_label_groups": f"SELECT skill, count(DISTINCT label) AS labels FROM (SELECT label, {_SKILL} AS skill FROM sample_features) GROUP BY skill HAVING count(DISTINCT label) > 1",
    "group_size_stats": f"SELECT count(*) AS groups, min(n) AS least, floor(quantile_cont(n, 0.5))::BIGINT AS median, max(n) AS greatest FROM (SELECT count(*) AS n FROM (SELECT {_SKILL} AS skill FROM sample_features) GROUP BY skill)",
    "iat": f"SELECT user_id, event_id, round(gap, 4) AS gap FROM ({_GAPS})",
    "flow_stats": f"""SELECT user_id, count(*) AS packet_count, round(coalesce(sum(value), 0), 4) AS total_bytes, round(coalesce(sum(CASE WHEN event_type = 'click' THEN value ELSE 0 END), 0), 4) AS up_bytes,
      round(coalesce(sum(value) - sum(CASE WHEN event_type = 'click' THEN value ELSE 0 END), 0), 4) AS down_bytes,
      round(coalesce(sum(CASE WHEN event_type = 'click' THEN value ELSE 0 END) / nullif(sum(value), 0), 0), 4) AS up_ratio, round(coalesce(min(value), 0), 4) AS pkt_len_min, round(coalesce(max(value), 0), 4) AS pkt_len_max,
      round(coalesce(avg(value), 0), 4) AS pkt_len_mean, round(coalesce(stddev_pop(value), 0), 4) AS pkt_len_std, round(coalesce(avg(gap), 0), 4) AS iat_mean, round(coalesce(stddev_pop(gap), 0), 4) AS iat_std,
      round(coalesce(max(gap), 0), 4) AS iat_max FROM ({_GAPS}) GROUP BY user_id""",
    "domain_counts": f"""SELECT file_name, count(DISTINCT value) FILTER (kind = 'dns') AS dns_domain_count, count(DISTINCT value) FILTER (kind = 'sni') AS sni_count, count(DISTINCT value) FILTER (kind = 'host') AS http_host_count
      FROM ({_NET}) GROUP BY file_name""",
    "valid_domains": f"""SELECT value, regexp_matches(v, '^(?:[a-z0-9](?:[a-z0-9-]{{0,61}}[a-z0-9])?\\.)+[a-z]{{2,}}$') AND length(v) BETWEEN 1 AND 253 AS valid FROM (SELECT DISTINCT value, rtrim(lower(trim(value)), '.') AS v FROM ({_NET}))""",
    "net_meta_text": f"""SELECT file_name, string_agg(kind || ':' || value, ' ' ORDER BY list_position(['dns', 'sni', 'host', 'ip'], kind), value) AS net_text
      FROM (SELECT DISTINCT * FROM ({_NET}) WHERE kind IN ('dns', 'sni', 'host', 'ip')) GROUP BY file_name""",
    "sliding_windows": _windows(64, 58, "ceil(len(t) / 58) - 1"),
    "fixed_chunks": _windows(48, 48, "ceil((len(t) - 48) / 48)"),
    "pool_mean": "SELECT label, pos, round(avg(x::DOUBLE), 6) AS value FROM (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS pos FROM embeddings) GROUP BY ALL",
    "pool_max": "SELECT label, pos, round(max(x::DOUBLE), 6) AS value FROM (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS pos FROM embeddings) GROUP BY ALL",
    "l2_normalized": """SELECT vec_id, pos, round(x::DOUBLE / greatest(norm, 1e-12::DOUBLE), 6) AS x FROM (SELECT vec_id, unnest(embedding) AS x, unnest(range(len(embedding))) AS pos,
      sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS norm FROM embeddings)""",
    "tfidf_vocab": f"SELECT term, df, total_tf, round(idf, 6) AS idf FROM ({_VOCAB})",
    "tfidf": f"""WITH w AS (SELECT doc_id, term, (1 + ln(tf)) * idf AS w FROM ({_WORDS}) JOIN ({_VOCAB}) USING (term)), n AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY doc_id)
      SELECT doc_id, term, round(w / norm, 6) AS weight FROM w JOIN n USING (doc_id)""",
    "log1p_features": "SELECT file_name, built_at, " + ", ".join(f"round({f'ln(1 + greatest(net_numeric[{i + 1}], 0))' if i in _LOGGED else f'net_numeric[{i + 1}]'}, 6) AS x{i}" for i in range(15)) + " FROM sample_features",
    "minmax_scaled": "WITH b AS (SELECT " + ", ".join(f"min(host_numeric[{i + 1}]) AS l{i}, max(host_numeric[{i + 1}]) AS h{i}" for i in range(8)) + " FROM sample_features) SELECT file_name, built_at, "
    + ", ".join(f"round((host_numeric[{i + 1}] - l{i}) / CASE WHEN h{i} = l{i} THEN 1 ELSE h{i} - l{i} END, 6) AS x{i}" for i in range(8)) + " FROM sample_features, b",
    "corpus_fingerprint": """SELECT substr(sha256('v1' || chr(10) || string_agg(d, chr(10) ORDER BY b)), 1, 16) AS fingerprint FROM (SELECT substr(d, 1, 3) AS b, sha256(string_agg(d, chr(10) ORDER BY d)) AS d
      FROM (SELECT sha256(coalesce(file_name, '') || chr(9) || coalesce(label::VARCHAR, '') || chr(9) || coalesce(net_text, '')) AS d FROM sample_features) GROUP BY 1)""",
    "svm_score": f"SELECT file_name, built_at, round({_SCORE}, 6) AS score, ({_SCORE} > 0)::INT AS predicted FROM sample_features WHERE host_numeric IS NOT NULL",
}
