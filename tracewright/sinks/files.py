"""Sinks: CSV and JSON reports, the token fact table, manifests and caches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: the columns of the distribution report.
DISTRIBUTION = ("token", "total_count", "avg_per_file", "file_count", "files_with_token", "files_without_token", "presence_ratio", "min_per_file", "p25_per_file", "median_per_file", "p75_per_file", "max_per_file", "std_per_file", "mean_per_file")

CSV = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """CSV with header, quotes doubled and blanks kept, replacing what is there; one file only for small reports."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").options(**CSV).csv(path)


def write_token_table(per_file: DataFrame, path: str) -> None:
    """The fact table (file_name, token, count) as parquet, sorted by token within files for pruning."""
    per_file.sortWithinPartitions("token").write.mode("overwrite").parquet(path)


def write_token_counts(totals: DataFrame, files: int, path: str) -> None:
    """token, count, avg with four decimals, most frequent first."""
    avg = F.format_string("%.4f", F.col("total_count") / F.lit(float(max(files, 1))))
    write_csv(totals.select("token", F.col("total_count").alias("count"), avg.alias("avg")).orderBy(F.desc("count"), "token"), path)


def write_distribution(rows: DataFrame, path: str) -> bool:
    """The distribution report; nothing is written if there are no rows."""
    if rows.isEmpty():
        return False
    write_csv(rows.select(*DISTRIBUTION).orderBy(F.desc("total_count"), "token"), path)
    return True


def write_manifest(manifest: DataFrame, label: int, path: str) -> None:
    """file_name, label, has_audit, has_pcap, pcap_file."""
    write_csv(manifest.select(F.concat("name", F.lit("_audit-logs.log")).alias("file_name"), F.lit(label).alias("label"), "has_audit", "has_pcap", "pcap_file").orderBy("file_name"), path)


def write_unified_manifest(names: DataFrame, label: int, path: str) -> None:
    """file_name, label, pcap_file of sessions with both modalities."""
    write_csv(names.select(F.concat("name", F.lit("_audit-logs.log")).alias("file_name"), F.lit(label).alias("label"), F.concat("name", F.lit("_network.pcap")).alias("pcap_file")).orderBy("file_name"), path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """One-row metrics as a JSON line."""
    metrics.coalesce(1).write.mode("overwrite").json(path)


def write_embeddings(vectors: DataFrame, fingerprint: str, path: str) -> None:
    """The embedding cache (key, content, embedding) of ``cached_embeddings`` with the fingerprint of its corpus."""
    vectors.withColumn("fingerprint", F.lit(fingerprint)).write.mode("overwrite").parquet(path)


def write_cv(outputs: dict[str, DataFrame], folder: str, mode: str) -> None:
    """Per-fold, summary, confusion and misclassified reports of a cross-validation."""
    for name, df in outputs.items():
        write_csv(df, f"{folder}/{mode}_{name}", one_file=True)
