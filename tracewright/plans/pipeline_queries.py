"""Queries on sources, sinks, captures, trajectories, caches and folds: tables go out and come back, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions import net
from tracewright.functions import numeric as nu
from tracewright.functions import text as tx
from tracewright.ml import encoder
from tracewright.operators import cv, features, flow, metrics, sessions, tokens, trajectory
from tracewright.operators.orphans import canonical_name
from tracewright.plans import detect, pipeline_sql, reference_queries
from tracewright.runtime import read_table, scratch
from tracewright.sinks import files as sinks
from tracewright.sources import files, packets

#: Packets of a user in one capture, at most.
CAPTURE = 5000


def token_table(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "tokens-csv")
    sinks.write_csv(reference_queries._facts(spark, d).select("file_name", "token", F.col("count").cast("int").alias("count")), path)
    return files.token_table(spark, path).withColumn("count", F.col("count").cast("bigint"))


def corpus_from_table(spark, d):
    path = scratch(spark, "corpus-csv")
    sinks.write_csv(reference_queries._facts(spark, d), path)
    return files.audit_corpus(spark, path, path)


def token_database(spark, d):
    path = scratch(spark, "token-table")
    sinks.write_token_table(reference_queries._facts(spark, d), path)
    return spark.read.parquet(path).filter(~tx.skipped(F.col("token"))).groupBy("token").agg(F.sum("count").alias("total_count"))


def token_counts_report(spark, d):
    path = scratch(spark, "counts-csv")
    facts = reference_queries._facts(spark, d)
    n = tokens.file_count(facts).first()[0]
    sinks.write_token_counts(tokens.total_counts(facts, filtered=True), n, path)
    return spark.read.options(**sinks.CSV).schema("token string, count bigint, avg string").csv(path)


def distribution_report(spark, d):
    path = scratch(spark, "distribution-csv")
    rows = reference_queries.token_distribution(spark, d).select(*sinks.DISTRIBUTION)
    sinks.write_distribution(rows, path)
    return spark.read.options(**sinks.CSV).schema(rows.schema).csv(path)


def union_manifest(spark, d):
    path = scratch(spark, "manifest-csv")
    sinks.write_manifest(reference_queries.session_manifest(spark, d), 1, path)
    back = spark.read.options(**sinks.CSV).schema("file_name string, label int, has_audit boolean, has_pcap boolean, pcap_file string").csv(path)
    return back.withColumn("pcap_file", F.coalesce("pcap_file", F.lit("")))


def unified_manifest(spark, d):
    path = scratch(spark, "unified-csv")
    sinks.write_unified_manifest(reference_queries.sessions_both(spark, d), 0, path)
    return spark.read.options(**sinks.CSV).schema("file_name string, label int, pcap_file string").csv(path)


def metrics_report(spark, d):
    path = scratch(spark, "metrics-json")
    rows = reference_queries.classification_metrics(spark, d)
    sinks.write_metrics(rows, path)
    return spark.read.schema(rows.schema).json(path)


def fold_report(spark, d):
    path = scratch(spark, "cv")
    rows = reference_queries.fold_metrics(spark, d)
    sinks.write_cv({"folds": rows}, path, "fusion")
    return spark.read.options(**sinks.CSV).schema(rows.schema).csv(f"{path}/fusion_folds")


def truth_labels(spark, d):
    path = scratch(spark, "truth-csv")
    labels = sessions.last_labels(read_table(spark, d, "results"), canonical_name(F.col("sample_id")), "label", F.col("scored_at"), F.col("result_id"))
    labels.select(F.concat_ws(",", "name", F.col("label").cast("string")).alias("value")).write.text(path)
    return files.truth_table(spark, path)


def constant_labels(spark, d):
    return files.constant_labels(reference_queries._samples(spark, d).withColumnRenamed("name", "sample_id"), 1)


def keyword_list(spark, d):
    path = scratch(spark, "keywords")
    skills = read_table(spark, d, "skill_catalog").select("skill").distinct().agg(F.to_json(F.collect_list("skill")).alias("value"))  # 260 rows, fixed
    skills.write.text(path)
    return spark.createDataFrame([(k,) for k in files.keyword_list(spark, path)], "keyword string")


def last_result(spark, d):
    rows = read_table(spark, d, "results").distinct().select(canonical_name(F.col("sample_id")).alias("name"), "result_id", "detector").filter(F.col("name").isNotNull())
    return sessions.last_wins(rows, "name", "result_id")


def resolved_samples(spark, d):
    a, p = reference_queries._audit(spark, d), reference_queries._pcap(spark, d)
    modes = (("fusion", False), ("audit_only", False), ("pcap_only", False), ("fusion", True))
    parts = [sessions.resolve(m, a, p, require_both=both).select(F.lit(m + ("_both" if both else "")).alias("mode"), "name") for m, both in modes]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3])


def separators(spark, d):
    return reference_queries._lines(spark, d).select("file_name", "line_no", tx.separators_as_blanks(F.col("msg")).alias("msg"))


def judged(spark, d):
    return read_table(spark, d, "documents").select("doc_id", tx.judged_unsafe(F.col("text")).alias("unsafe"))


def unsafe_sessions(spark, d):
    return trajectory.unsafe_sessions(read_table(spark, d, "documents").select("source", F.col("text").alias("answer")), "source")


def masked_counters(spark, d):
    s = read_table(spark, d, "sample_features").select("file_name", "built_at", nu.masked(F.col("has_audit"), F.col("host_numeric"), 8).alias("x"))
    return s.select("file_name", "built_at", *[F.round(F.get("x", F.lit(i)), 6).alias(f"x{i}") for i in range(8)])


def fusion_numbers(spark, d):
    s = detect.numeric_block(read_table(spark, d, "sample_features").filter(F.col("host_numeric").isNotNull() & F.col("net_numeric").isNotNull()))
    x = F.concat("raw", "flags")
    return s.select("file_name", "built_at", *[F.round(F.get(x, F.lit(i)), 6).alias(f"x{i}") for i in range(25)])


def tfidf_audit(spark, d):
    docs = read_table(spark, d, "sample_features").filter(F.col("file_name").isNotNull()).groupBy("file_name").agg(F.max("audit_text").alias("text"))
    counts = features.word_counts(docs, "file_name", "text")
    w = features.tfidf(counts, features.tfidf_vocabulary(counts, docs, "file_name"), "file_name")
    return w.select("file_name", "term", F.round("weight", 6).alias("weight"))


def embedding_cache(spark, d):
    """Vectors of all texts, those of English ones from a cache that went out and came back: their squared lengths."""
    docs = read_table(spark, d, "documents").select("doc_id", "text", "lang")
    english = docs.filter("lang = 'en'")
    path = scratch(spark, "embeddings")
    sinks.write_embeddings(encoder.with_digest(encoder.embed(english, "doc_id", "text", dim=64), english, "doc_id", "text"), "v1", path)
    made = encoder.cached_embeddings(docs, files.embedding_cache(spark, path, "v1"), "doc_id", "text", dim=64)
    return made.select("doc_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x), 6).alias("squared"))


def fold_check(spark, d):
    """One row: groups placed in folds, and how many stand in several, which must be none before any training."""
    rows = read_table(spark, d, "sample_features").filter(F.col("file_name").isNotNull()).withColumn("skill", tx.skill_id(F.col("file_name")))
    placed = rows.join(cv.group_folds(rows, "skill", "label"), "skill")
    leaking = metrics.fold_leakage(placed, "skill").agg(F.count(F.lit(1)).alias("leaking"))
    return placed.agg(F.count_distinct("skill").alias("groups"), F.count(F.lit(1)).alias("records"), F.count_distinct("fold").alias("folds")).crossJoin(leaking)


def wrong_report(spark, d):
    return metrics.wrong_first(reference_queries.misclassified_summary(spark, d), "name").select("name", "wrong_folds")


def mixed_first(spark, d):
    return metrics.first_groups(reference_queries.mixed_label_groups(spark, d), "skill")


def _hex(value: Column, size: int) -> Column:
    return F.lpad(F.hex(value.cast("bigint")), 2 * size, "0")


def _text(value: Column) -> Column:
    return F.hex(F.encode(value, "UTF-8"))


def captures(spark: SparkSession, d: str) -> DataFrame:
    """(path, content): the events of each user as captures, a packet an event, its protocol by its type.

    click is a TLS greeting, view an HTTP request, signup a DNS question, error a question that comes in, any other an
    answer that comes in.
    """
    e, u, kind = F.col("event_id"), F.col("user_id"), F.col("event_type")
    near = F.concat(F.lit("0A"), _hex(u % 65_536, 2), F.lit("07"))
    far = F.concat(F.lit("CB0071"), _hex(e % 50 + 1, 1))
    label = F.concat(F.lit("d"), (e % 11).cast("string"))
    dns = F.concat(F.lit("000101000001000000000000"), _hex(F.length(label), 1), _text(label), F.lit("07"), _text(F.lit("example")), F.lit("03"), _text(F.lit("net")), F.lit("0000010001"))
    name = _text(F.concat(F.lit("t"), (u % 9).cast("string"), F.lit(".example.com")))  # 14 letters
    tls = F.concat(F.lit("1603010046" + "01000042" + "0303" + "00" * 32 + "00" + "00021301" + "0100" + "0017" + "00000013" + "0011" + "00000E"), name)
    http = _text(F.concat(F.lit("GET / HTTP/1.1\r\nHost: w"), (u % 7).cast("string"), F.lit(".example.org\r\n\r\n")))
    up, udp = kind.isin("click", "view", "signup"), kind.isin("signup", "error")
    body = F.when(kind == "click", tls).when(kind == "view", http).when(udp, dns).otherwise(F.lit("6F6B"))
    port = F.when(kind == "click", 443).when(kind == "view", 80).when(udp, 53).otherwise(443)
    own = F.when(udp, F.lit(50_000)).otherwise(40_000 + u % 1000)
    ports = F.when(up, F.concat(_hex(own, 2), _hex(port, 2))).otherwise(F.concat(_hex(port, 2), _hex(own, 2)))
    size = F.length(body) / 2
    segment = F.when(udp, F.concat(ports, _hex(size + 8, 2), F.lit("0000"), body)).otherwise(F.concat(ports, F.lit("00" * 8 + "5018FFFF00000000"), body))
    ends = F.when(up, F.concat(near, far)).otherwise(F.concat(far, near))
    packet = F.concat(F.lit("4500"), _hex(F.length(segment) / 2 + 20, 2), F.lit("0000000040"), F.when(udp, "11").otherwise("06"), F.lit("0000"), ends, segment)
    frame = F.concat(F.lit("00" * 12 + "0800"), packet)
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts"))
    whole = F.concat(_hex(F.floor(micros / 1_000_000), 4), _hex(micros % 1_000_000, 4), _hex(F.length(frame) / 2, 4), _hex(F.length(frame) / 2, 4), frame)
    path = F.concat(F.lit("u"), u.cast("string"), F.lit("-"), F.floor(e / F.lit(CAPTURE)).cast("string"), F.lit(".pcap"))
    packed = F.array_join(F.transform(F.sort_array(F.collect_list("p")), lambda p: p["hex"]), "")
    rows = read_table(spark, d, "events").select(path.alias("path"), F.struct(e.alias("event_id"), whole.alias("hex")).alias("p"))
    return rows.groupBy("path").agg(F.unhex(F.concat(F.lit("A1B2C3D40002000400000000000000000000FFFF00000001"), packed)).alias("content"))


def packet_rows(spark, d):
    p = packets.decoded(captures(spark, d))
    return p.select(
        "file", "pkt_idx", F.round("ts", 3).alias("ts"), "length", "ip_len", net.ipv4_text(F.col("src")).alias("src"), net.ipv4_text(F.col("dst")).alias("dst"), "proto", "sport", "dport",
        F.octet_length("payload").alias("payload"), F.get("dns", F.lit(0)).alias("dns"), net.private_ipv4(F.col("src")).alias("up"), net.remote_public(F.col("src"), F.col("dst")).alias("far"),
    )


def packet_names(spark, d):
    return detect.capture_names(flow.file_captures(captures(spark, d)))


def packet_features(spark, d):
    f = detect.capture_features(flow.file_captures(captures(spark, d)))
    picked = {"packet_count": 0, "total_bytes": 1, "up_bytes": 2, "down_bytes": 3, "pkt_len_min": 5, "pkt_len_max": 6, "dns_domain_count": 12, "sni_count": 13, "http_host_count": 14}
    return f.select("file", *[F.get("net_numeric", F.lit(i)).cast("bigint").alias(n) for n, i in picked.items()], "net_text")


_ALL = (
    token_table, corpus_from_table, token_database, token_counts_report, distribution_report, union_manifest, unified_manifest, metrics_report, fold_report, truth_labels,
    constant_labels, keyword_list, last_result, resolved_samples, separators, judged, unsafe_sessions, masked_counters, fusion_numbers, tfidf_audit, embedding_cache, fold_check,
    wrong_report, mixed_first, packet_rows, packet_names, packet_features,
)
QUERIES = {f.__name__: f for f in _ALL}
ORACLE = pipeline_sql.ORACLE
