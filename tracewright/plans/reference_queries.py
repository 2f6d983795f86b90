"""Queries that exercise the reference's own operators on the driver tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions import numeric as nu
from tracewright.functions import text as tx
from tracewright.operators import features, flow, metrics, sessions, tokens, trajectory
from tracewright.operators.orphans import canonical_name
from tracewright.plans import reference_sql
from tracewright.runtime import read_table, spread

#: Weights of the scoring query over the host counters, and its intercept.
TOY_WEIGHTS = (0.001, 0.02, -0.01, 1.5, 0.05, -0.3, 0.7, 0.002)
TOY_INTERCEPT = -0.5
WINDOW, STRIDE, CHUNK = 64, 58, 48


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return read_table(spark, d, name)


def _lines(spark, d):
    return tokens.read_once(_t(spark, d, "audit_raw"))


def kv_tokens(spark, d):
    return tokens.line_tokens(_lines(spark, d))


def token_counts_per_file(spark, d):
    return tokens.counts_per_file(_lines(spark, d))


def token_counts(spark, d):
    return tokens.total_counts(token_counts_per_file(spark, d))


def token_counts_filtered(spark, d):
    return tokens.total_counts(token_counts_per_file(spark, d), filtered=True)


def top_tokens(spark, d):
    return tokens.top_tokens(token_counts(spark, d))


def file_count(spark, d):
    return tokens.file_count(_facts(spark, d))


def _facts(spark, d):
    return tokens.fact_rows(_t(spark, d, "per_file_counts"))


def token_distribution(spark, d):
    return tokens.token_distribution(_facts(spark, d))


def capped_document(spark, d):
    return tokens.capped_documents(_facts(spark, d))


def host_numeric(spark, d):
    return tokens.host_counters(_lines(spark, d))


def _audit(spark, d):
    return sessions.names(_t(spark, d, "audit_files"), "file_name")


def _pcap(spark, d):
    return sessions.names(_t(spark, d, "pcap_files"), "pcap_name")


def sessions_both(spark, d):
    return sessions.both(_audit(spark, d), _pcap(spark, d))


def sessions_union(spark, d):
    return sessions.either(_audit(spark, d), _pcap(spark, d))


def sessions_only_left(spark, d):
    return sessions.only_left(_audit(spark, d), _pcap(spark, d))


def sessions_only_right(spark, d):
    return sessions.only_left(_pcap(spark, d), _audit(spark, d))


def session_manifest(spark, d):
    return sessions.manifest(_audit(spark, d), _pcap(spark, d))


def modality_coverage(spark, d):
    return sessions.coverage(_t(spark, d, "sample_features"))


def class_union(spark, d):
    s = _t(spark, d, "sample_features").select("file_name", "label")
    return s.filter("label = 0").unionByName(s.filter("label = 1")).select("file_name", tx.class_name(F.col("label")).alias("class"), tx.skill_id(F.col("file_name")).alias("skill"), tx.cv_group(F.col("label"), F.col("file_name")).alias("group_key"), tx.pcap_name(F.col("file_name")).alias("pcap_file"))


def _samples(spark, d):
    return sessions.names(_t(spark, d, "sample_features"), "file_name")


def labels_defaulted(spark, d):
    labels = sessions.last_labels(_t(spark, d, "results"), canonical_name(F.col("sample_id")), "label", F.col("scored_at"), F.col("result_id"))
    return sessions.labels_defaulted(_samples(spark, d), labels)


def sample_cap_per_class(spark, d):
    s = _t(spark, d, "sample_features").filter(F.col("label").isin(0, 1)).select("file_name", "label").distinct()
    return tokens.sample_cap(s, "label", "file_name", 100)


def keyword_hits(spark, d):
    words = [r[0] for r in _t(spark, d, "skill_catalog").select("skill").distinct().collect()]  # 260 rows, fixed
    return sessions.keyword_hits(spread(_t(spark, d, "documents").select("doc_id", "text")), "text", words).select("doc_id")


def _results(spark, d):
    return _t(spark, d, "results").distinct()


def detector_metrics(spark, d):
    return metrics.detector_metrics(_results(spark, d), "detector")


def detector_union_metrics(spark, d):
    name = canonical_name(F.col("sample_id"))
    vote = lambda k: F.bool_or((F.col("detector") == k) & metrics.positive(F.col("pred"))).alias(k)
    votes = _results(spark, d).filter(name.isNotNull()).groupBy(name.alias("name")).agg(F.max(F.when(F.col("label").isin(0, 1), F.col("label"))).alias("label"), *[vote(k) for k in ("pcap", "session", "rule")])
    return metrics.union_metrics(votes, ["pcap", "session", "rule"])


def _scored(spark, d):
    return _results(spark, d).filter(F.col("label").isin(0, 1) & F.col("pred").isin(0, 1)).withColumn("fold", F.pmod("result_id", F.lit(10)))


def classification_metrics(spark, d):
    return metrics.classification(_scored(spark, d), digits=6)


def confusion_matrix(spark, d):
    return metrics.confusion(_scored(spark, d))


def misclassified(spark, d):
    return metrics.misclassified(_scored(spark, d), "result_id", "detector")


def misclassified_summary(spark, d):
    rows = _scored(spark, d).withColumn("name", canonical_name(F.col("sample_id"))).filter(F.col("name").isNotNull())
    return metrics.misclassified_summary(metrics.misclassified(rows, "name", "fold"), "name")


def prediction_table(spark, d):
    return metrics.prediction_table(_scored(spark, d), "result_id")


def fold_metrics(spark, d):
    return metrics.fold_metrics(_scored(spark, d))


def fold_summary(spark, d):
    return metrics.fold_summary(metrics.fold_metrics(_scored(spark, d)))


def fold_leakage(spark, d):
    rows = _scored(spark, d).withColumn("name", canonical_name(F.col("sample_id"))).filter(F.col("name").isNotNull())
    return metrics.fold_leakage(rows, "name")


def mixed_label_groups(spark, d):
    s = _t(spark, d, "sample_features").withColumn("skill", tx.skill_id(F.col("file_name")))
    return metrics.mixed_label_groups(s, "skill")


def group_size_stats(spark, d):
    s = _t(spark, d, "sample_features").withColumn("skill", tx.skill_id(F.col("file_name")))
    return metrics.group_sizes(s, "skill")


def _seconds():
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts")) / 1e6


def iat(spark, d):
    return flow.arrival_gaps(_t(spark, d, "events"), "user_id", "event_id", _seconds()).select("user_id", "event_id", F.round("gap", 4).alias("gap"))


def flow_stats(spark, d):
    return flow.flow_stats(_t(spark, d, "events"), "user_id", "event_id", _seconds(), F.col("value"), F.col("event_type") == "click")


def _net(spark, d):
    return flow.net_tokens(_t(spark, d, "sample_features"), "file_name", "net_text")


def domain_counts(spark, d):
    return flow.domain_counts(_net(spark, d), "file_name")


def valid_domains(spark, d):
    return flow.valid_domains(_net(spark, d))


def net_meta_text(spark, d):
    return flow.net_meta_text(_net(spark, d), "file_name")


def _messages(spark, d):
    return trajectory.messages(_t(spark, d, "session_log"))


def conversation_dedup(spark, d):
    return trajectory.deduplicated(_messages(spark, d)).select("session_id", "line_no", "role")


def conversation_rounds(spark, d):
    return trajectory.rounds(trajectory.turns(_messages(spark, d))).select("session_id", "line_no", "role", "round_no")


def conversation_render(spark, d):
    return trajectory.rendered(trajectory.turns(_messages(spark, d)))


def sliding_windows(spark, d):
    return trajectory.token_windows(_t(spark, d, "documents"), "doc_id", "text", WINDOW, STRIDE)


def fixed_chunks(spark, d):
    return trajectory.token_windows(_t(spark, d, "documents"), "doc_id", "text", CHUNK, CHUNK, stop_at_end=True)


def pool_mean(spark, d):
    return features.pooled(_t(spark, d, "embeddings"), "label", "embedding").select("label", "pos", F.round("value", 6).alias("value"))


def pool_max(spark, d):
    return features.pooled(_t(spark, d, "embeddings"), "label", "embedding", "max").select("label", "pos", F.round("value", 6).alias("value"))


def l2_normalized(spark, d):
    rows = _t(spark, d, "embeddings").select("vec_id", F.posexplode(nu.l2_normalized(F.col("embedding"))).alias("pos", "x"))
    return rows.select("vec_id", F.col("pos").cast("bigint").alias("pos"), F.round("x", 6).alias("x"))


def _words(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", "text")
    return features.word_counts(docs, "doc_id", "text"), docs


def tfidf_vocab(spark, d):
    counts, docs = _words(spark, d)
    v = features.tfidf_vocabulary(counts, docs, "doc_id")
    return v.select("term", "df", "total_tf", F.round("idf", 6).alias("idf"))


def tfidf(spark, d):
    counts, docs = _words(spark, d)
    w = features.tfidf(counts, features.tfidf_vocabulary(counts, docs, "doc_id"), "doc_id")
    return w.select("doc_id", "term", F.round("weight", 6).alias("weight"))


def _numeric(rows, column, width):
    return rows.select("file_name", "built_at", *[F.round(F.get(column, F.lit(i)), 6).alias(f"x{i}") for i in range(width)])


def log1p_features(spark, d):
    return _numeric(features.log_features(_t(spark, d, "sample_features")), "net_numeric", 15)


def minmax_scaled(spark, d):
    rows = _t(spark, d, "sample_features").select("file_name", "built_at", "host_numeric")
    return _numeric(features.min_max_scaled(rows, "host_numeric", 8, nu.HOST_WEIGHT), "host_numeric", 8)


def corpus_fingerprint(spark, d):
    return features.fingerprint(_t(spark, d, "sample_features"), "file_name", "label", "v1", "net_text")


def svm_score(spark, d):
    from tracewright.ml.svm import linear_score

    s = _t(spark, d, "sample_features").filter(F.col("host_numeric").isNotNull())
    score = linear_score(F.col("host_numeric"), TOY_WEIGHTS, TOY_INTERCEPT)
    return s.select("file_name", "built_at", F.round(score, 6).alias("score"), (score > 0).cast("int").alias("predicted"))


_ALL = (
    kv_tokens, token_counts_per_file, token_counts, token_counts_filtered, top_tokens, file_count, token_distribution, capped_document, host_numeric,
    sessions_both, sessions_union, sessions_only_left, sessions_only_right, session_manifest, modality_coverage, class_union, labels_defaulted,
    sample_cap_per_class, keyword_hits, detector_metrics, detector_union_metrics, classification_metrics, confusion_matrix, misclassified,
    misclassified_summary, prediction_table, fold_metrics, fold_summary, fold_leakage, mixed_label_groups, group_size_stats, iat, flow_stats,
    domain_counts, valid_domains, net_meta_text, conversation_dedup, conversation_rounds, conversation_render, sliding_windows, fixed_chunks,
    pool_mean, pool_max, l2_normalized, tfidf_vocab, tfidf, log1p_features, minmax_scaled, corpus_fingerprint, svm_score,
)
QUERIES = {f.__name__: f for f in _ALL}
ORACLE = reference_sql.ORACLE
