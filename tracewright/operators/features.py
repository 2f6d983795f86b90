"""Feature artifacts: TF-IDF, scaled counters, pooled vectors, fingerprints and stacking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions import numeric as nu
from tracewright.functions import text as tx


def word_counts(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf) of the word pieces of at least two characters, in lower case."""
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(tx.WORD_PIECE), F.lit(0))
    return documents.select(key, F.explode(words).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def tfidf_vocabulary(counts: DataFrame, documents: DataFrame, key: str, min_df: int = 2, max_share: float = 0.95, max_features: int = 100_000) -> DataFrame:
    """(term, df, total_tf, idf): terms within the bounds, the most frequent ``max_features`` of them."""
    n = documents.agg(F.count(F.lit(1))).scalar()
    per = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total_tf"))
    kept = per.withColumn("n", n).filter((F.col("df") >= min_df) & (F.col("df") <= F.col("n") * max_share))
    capped = kept.orderBy(F.desc("total_tf"), "term").limit(max_features)
    return capped.select("term", "df", "total_tf", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


def tfidf(counts: DataFrame, vocabulary: DataFrame, key: str) -> DataFrame:
    """(key, term, weight): sublinear tf times idf, each document of length 1."""
    raw = counts.join(vocabulary.select("term", "idf"), "term").select(key, "term", ((1 + F.log("tf")) * F.col("idf")).alias("w"))
    norm = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, key).select(key, "term", (F.col("w") / F.col("norm")).alias("weight"))


def log_features(samples: DataFrame) -> DataFrame:
    """Samples with log1p of the counters that grow without bound."""
    return samples.withColumn("host_numeric", nu.log_selected(F.col("host_numeric"), nu.HOST_LOG)).withColumn("net_numeric", nu.log_selected(F.col("net_numeric"), nu.NET_LOG))


def min_max_fit(rows: DataFrame, column: str) -> DataFrame:
    """(i, low, high) of every position of an array column."""
    return rows.select(F.posexplode(column).alias("i", "x")).groupBy("i").agg(F.min("x").alias("low"), F.max("x").alias("high"))


def min_max_scaled(rows: DataFrame, column: str, width: int, weight: float = 1.0) -> DataFrame:
    """``rows`` with ``column`` scaled to 0..1 per position over all rows, times ``weight``."""
    at = lambda i: F.get(F.col(column), F.lit(i))
    bounds = rows.agg(F.struct(*[F.min(at(i)).alias(f"l{i}") for i in range(width)], *[F.max(at(i)).alias(f"h{i}") for i in range(width)])).scalar()
    scaled = [nu.min_max(at(i), F.col(f"__b.l{i}"), F.col(f"__b.h{i}")) * weight for i in range(width)]
    return rows.withColumn("__b", bounds).withColumn(column, F.when(F.col(column).isNotNull(), F.array(*scaled))).drop("__b")


def stacked(mode: str, host: Column, net: Column) -> Column:
    """The numeric block of a mode: host, net or both."""
    return {"fusion": F.concat(host, net), "audit_only": host, "pcap_only": net}[mode]


def pooled(rows: DataFrame, key: str, vector: str, how: str = "mean") -> DataFrame:
    """(key, pos, value): element-wise mean or maximum of the vectors of each key, combined partially."""
    one = rows.select(key, F.posexplode(vector).alias("pos", "x")).withColumns({"x": F.col("x").cast("double"), "pos": F.col("pos").cast("bigint")})
    return one.groupBy(key, "pos").agg((F.avg("x") if how == "mean" else F.max("x")).alias("value"))


def fingerprint(rows: DataFrame, name: str, label: str, tag: str, content: str | None = None) -> DataFrame:
    """One row: 16 hex digits over the configuration and all (name, label), and content if given.

    A digest of digests: lines are digested in 4,096 buckets by their own digest, the buckets in
    order by one more; no task sees more than a bucket's lines.
    """
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (name, label, *([content] if content else []))]
    lines = rows.select(F.sha2(F.concat_ws("\t", *parts), 256).alias("d"))
    buckets = lines.groupBy(F.substring("d", 1, 3).alias("b")).agg(F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list("d"))), 256).alias("d"))
    return buckets.agg(F.array_sort(F.collect_list(F.struct("b", "d"))).alias("all")).select(F.substring(F.sha2(F.concat_ws("\n", F.lit(tag), F.transform("all", lambda x: x["d"])), 256), 1, 16).alias("fingerprint"))
