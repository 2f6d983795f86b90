"""Queries on training data: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import conversations, encoding, lookalikes, packing, splits, sql, terms
from tracewright.runtime import read_table, scratch, written

CAPACITY = 3000


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_frequency(spark, d).filter(F.col("mark") != "kept").select("token", "mark")


def p2_frequency(spark: SparkSession, d: str) -> DataFrame:
    return terms.term_frequency(read_table(spark, d, "per_file_counts"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return terms.distinctive_terms(read_table(spark, d, "per_file_counts")).select("file_name", "token")


def p3_relevance(spark: SparkSession, d: str) -> DataFrame:
    scored = terms.term_relevance(read_table(spark, d, "per_file_counts"))
    return scored.select("file_name", "token", "tf", F.round("score", 6).alias("score"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return conversations.replay(spark, f"{d}/session_log.parquet").select("session_id", "turn_no", "entry_id")


def p4_conversations(spark: SparkSession, d: str) -> DataFrame:
    turns = conversations.replay(spark, f"{d}/session_log.parquet")
    return conversations.conversations(turns, read_table(spark, d, "session_log"))


def p4_batches(spark: SparkSession, d: str) -> DataFrame:
    """The turns of p4_found from a log that arrives in parts, late lines in later batches than their sessions."""
    log = read_table(spark, d, "session_log")
    home = scratch(spark, "parts")
    log.repartition(4).write.parquet(home)
    return conversations.replay(spark, home, files_per_batch=2).select("session_id", "turn_no", "entry_id")


def _grouped(spark: SparkSession, d: str) -> DataFrame:
    return splits.grouped_samples(read_table(spark, d, "sample_features"), read_table(spark, d, "skill_catalog"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_splits(spark, d).filter(F.col("split").isNotNull()).select("file_name", "group_key")


def p7_splits(spark: SparkSession, d: str) -> DataFrame:
    return splits.grouped_split(_grouped(spark, d))


def p7_check(spark: SparkSession, d: str) -> DataFrame:
    """One row: every name has a split, each group has one, and shares are near 80/10/10 as far as groups allow."""
    rows = written(p7_splits(spark, d), "splits")
    groups = rows.groupBy("group_key").agg(F.count_distinct("split").alias("splits"), F.count(F.lit(1)).alias("n"))
    shares = rows.agg(*[F.count_if(F.col("split") == name).alias(name) for name, _ in splits.SPLITS], F.count(F.lit(1)).alias("n"))
    near = [F.abs(F.col(name) - F.col("n") * share) <= F.col("n") * 0.02 + F.col("largest") for name, share in splits.SPLITS]
    whole = groups.agg(F.max("splits").alias("splits"), F.max("n").alias("largest"))
    return rows.agg(F.bool_and(F.col("split").isNotNull()).alias("all_given")).crossJoin(whole).crossJoin(shares).select("all_given", (F.col("splits") == 1).alias("groups_whole"), (near[0] & near[1] & near[2]).alias("shares_near"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoding.encode(read_table(spark, d, "documents"))


def p8_decoded(spark: SparkSession, d: str) -> DataFrame:
    return encoding.decode(p8_ids(spark, d)).select("doc_id", "text")


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    sizes = written(encoding.token_counts(read_table(spark, d, "documents")), "sizes")
    return packing.pack(sizes, capacity=CAPACITY)


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.packing_report(p9_containers(spark, d), CAPACITY)


def p9_check(spark: SparkSession, d: str) -> DataFrame:
    """One row: no container is too full, every text is whole, and containers are within 1 % and one of the bound."""
    sizes = written(encoding.token_counts(read_table(spark, d, "documents")), "sizes")
    packed = written(packing.pack(sizes, capacity=CAPACITY), "packed")
    per = packed.groupBy("doc_id").agg(F.sum("length").alias("held"), F.count(F.lit(1)).alias("parts"))
    whole = sizes.join(per, "doc_id", "left").agg(F.bool_and((F.col("tokens") == F.coalesce("held", F.lit(0))) & (F.coalesce("parts", F.lit(0)) == F.ceil(F.col("tokens") / F.lit(CAPACITY)))).alias("texts_whole"))
    report = packing.packing_report(packed, CAPACITY)
    return report.crossJoin(whole).select((F.col("fullest") <= CAPACITY).alias("all_fit"), "texts_whole", (F.col("containers") <= F.col("least_containers") * 1.01 + 1).alias("few"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.same_look_pairs(read_table(spark, d, "documents"))


def p10_groups(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.same_look_groups(read_table(spark, d, "documents"))


def p10_forms(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.unified(read_table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "form")


_ALL = (p2_found, p2_frequency, p3_found, p3_relevance, p4_found, p4_batches, p4_conversations, p7_found, p7_splits, p7_check, p8_ids, p8_decoded, p9_containers, p9_report, p9_check, p10_found, p10_groups, p10_forms)
QUERIES = {f.__name__: f for f in _ALL}
ORACLE = {
    "p2_found": sql.P2_FOUND,
    "p2_frequency": sql.P2_FREQUENCY,
    "p3_found": sql.P3_FOUND,
    "p3_relevance": sql.P3_RELEVANCE,
    "p4_found": sql.P4_FOUND,
    "p4_batches": sql.P4_FOUND,
    "p7_check": "SELECT true AS all_given, true AS groups_whole, true AS shares_near",
    "p9_check": "SELECT true AS all_fit, true AS texts_whole, true AS few",
    "p7_found": sql.P7_FOUND,
    "p8_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
