"""Sources: audit logs, token tables, session JSONL, labels, keywords and sample folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.functions import text as tx

MESSAGE = "struct<role:string,api:string,content:array<struct<type:string,text:string,id:string,name:string,arguments:string>>>"


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)/?$", 1)


def audit_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, msg) of every line of the logs below ``path``; bad bytes are replaced."""
    lines = spark.read.option("pathGlobFilter", "*.log").text(path)
    return lines.select(base_name(F.col("_metadata.file_path")).alias("file_name"), F.make_valid_utf8("value").alias("msg"))


def audit_lines_numbered(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, line_no, msg) with every line separator, from whole files; for logs that fit in memory."""
    files = spark.read.option("pathGlobFilter", "*.log").option("wholetext", True).text(path)
    text = tx.separators_as_blanks(F.make_valid_utf8("value"))
    return files.select(base_name(F.col("_metadata.file_path")).alias("file_name"), F.posexplode(tx.split_lines(text)).alias("line_no", "msg"))


def token_table(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, token, count) of a token CSV with header; rows that do not parse are left out."""
    rows = spark.read.options(header=True, mode="PERMISSIVE", escape='"').schema("file_name string, token string, count string").csv(path)
    return rows.withColumn("count", F.col("count").try_cast("int")).filter(F.col("count").isNotNull())


def embedding_cache(spark: SparkSession, path: str, fingerprint: str) -> DataFrame:
    """(key, content, embedding) of the cache at ``path``, of rows with this fingerprint."""
    return spark.read.parquet(path).filter(F.col("fingerprint") == fingerprint).drop("fingerprint")


def audit_corpus(spark: SparkSession, folder: str, csv: str | None = None, cap: int = tx.MAX_REPEAT) -> DataFrame:
    """(file_name, text) of each log: from the token CSV if there is one, else from the raw logs."""
    from tracewright.operators import tokens

    jvm = spark._jvm
    if csv:
        p = jvm.org.apache.hadoop.fs.Path(csv)
        if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            return tokens.capped_documents(token_table(spark, csv), cap)
    return tokens.capped_documents(tokens.counts_per_file(audit_lines(spark, folder)), cap)


def numbered_lines(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(path, line_no, value) of every line of the files below ``path`` whose names match, numbered from 0.

    Files are split and read in parallel however long they are. Lines of a split are numbered as they are read; only
    the splits' numbers of lines are summed up in order, so no file is sorted.
    """
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    lines = reader.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value")
    per = lines.groupBy("path", "block").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select("path", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return lines.join(offsets, ["path", "block"]).select("path", (F.col("id") - F.col("first") + F.col("offset")).alias("line_no"), "value")


def session_lines(spark: SparkSession, path: str) -> DataFrame:
    """(session_id, line_no, type, message) of JSONL below ``path``; blank and bad lines are skipped.

    The session is the file's name without ending, or its folder's if the file is ``session.jsonl``.
    Arguments that are objects are kept as their JSON text.
    """
    where = F.col("path")
    stem = F.regexp_replace(base_name(where), r"\.jsonl$", "")
    folder = F.regexp_extract(where, r"([^/]+)/[^/]+$", 1)
    raw = numbered_lines(spark, path, "*.jsonl")
    lines = raw.select(F.when(stem == "session", folder).otherwise(stem).alias("session_id"), "line_no", F.col("value").alias("line"))
    v = F.try_parse_json("line")
    good = lines.filter(F.trim("line") != "").withColumn("v", v).filter(F.col("v").isNotNull() & F.startswith(F.schema_of_variant("v"), F.lit("OBJECT")))
    item = "array<struct<type:string,text:string,id:string,name:string,arguments:string>>"
    return good.select(
        "session_id",
        "line_no",
        F.try_variant_get("v", "$.type", "string").alias("type"),
        F.when(
            F.try_variant_get("v", "$.message.role", "string").isNotNull(),
            F.struct(
                F.try_variant_get("v", "$.message.role", "string").alias("role"),
                F.try_variant_get("v", "$.message.api", "string").alias("api"),
                F.from_json(F.to_json(F.try_variant_get("v", "$.message.content", "variant")), item).alias("content"),
            ),
        ).alias("message"),
    )


def truth_table(spark: SparkSession, path: str) -> DataFrame:
    """(sample_id, label) of a CSV without header; rows without an integer label are left out, the last of an id holds."""
    rows = spark.read.text(path).select(F.monotonically_increasing_id().alias("i"), F.regexp_replace("value", "^﻿", "").alias("v"))
    cut = rows.select("i", F.split("v", ",").alias("c")).filter(F.size("c") >= 2)
    out = cut.select("i", F.trim(F.col("c")[0]).alias("sample_id"), F.trim(F.col("c")[1]).try_cast("int").alias("label")).filter(F.col("label").isNotNull())
    return out.groupBy("sample_id").agg(F.max_by("label", "i").alias("label"))


def constant_labels(samples: DataFrame, label: int) -> DataFrame:
    return samples.select("sample_id", F.lit(label).alias("label"))


def keyword_list(spark: SparkSession, path: str) -> list[str]:
    """The keywords of a JSON array; blank ones are dropped, outer blanks kept."""
    rows = spark.read.option("wholetext", True).text(path).select(F.explode(F.from_json("value", "array<string>")).alias("k")).filter(F.trim("k") != "")
    return [r[0] for r in rows.collect()]  # a parameter file


def sample_folders(spark: SparkSession, root: str) -> DataFrame:
    """(sample_id, session_path, pcap_path, audit_path) of the folders right below ``root``.

    A folder with none of the three files is no sample; a missing root gives an empty table.
    """
    try:
        files = spark.read.format("binaryFile").load(f"{root}/*/*").select("path")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "sample_id string, session_path string, pcap_path string, audit_path string")
    name = base_name(F.col("path"))
    at = lambda n: F.max(F.when(name == n, F.col("path")))
    return (
        files.filter(name.isin("session.jsonl", "network.pcap", "audit.log"))
        .groupBy(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("sample_id"))
        .agg(at("session.jsonl").alias("session_path"), at("network.pcap").alias("pcap_path"), at("audit.log").alias("audit_path"))
    )


def audit_texts(spark: SparkSession, root: str) -> DataFrame:
    """(sample_id, content) of the audit.log of each folder right below ``root``, whole; bad bytes are left out."""
    raw = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "audit.log").text(root)
    text = F.when(F.is_valid_utf8("value"), F.col("value")).otherwise(F.replace(F.make_valid_utf8("value"), F.lit("\ufffd"), F.lit("")))
    path = F.col("_metadata.file_path")
    below = F.regexp_extract(path, r"([^/]+)/([^/]+)/[^/]+$", 1) == F.lit(root.rstrip("/").rsplit("/", 1)[-1])
    return raw.filter(below).select(F.regexp_extract(path, r"([^/]+)/[^/]+$", 1).alias("sample_id"), F.regexp_replace(text, "\r\n?", "\n").alias("content"))


def labelled_names(spark: SparkSession, root: str) -> DataFrame:
    """(label, kind, name) of a labelled dataset: the label is the folder, kind is audit or pcap."""
    files = spark.read.format("binaryFile").load(f"{root}/*-by-type/*/*").select("path")
    kind = F.when(F.col("path").endswith(tx.AUDIT_ENDING), "audit").when(F.col("path").endswith(tx.PCAP_ENDING), "pcap")
    name = F.when(kind == "pcap", tx.audit_name(base_name(F.col("path")))).otherwise(base_name(F.col("path")))
    return files.filter(kind.isNotNull()).select(F.when(F.contains("path", F.lit("/malicious-by-type/")), 1).otherwise(0).alias("label"), kind.alias("kind"), name.alias("name"))
