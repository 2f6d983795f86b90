"""Token counts of audit lines and their distribution over files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions import text as tx
from tracewright.functions.numeric import ratio


def line_tokens(lines: DataFrame) -> DataFrame:
    """(file_name, line_no, pos, token) of every audit line."""
    return lines.select("file_name", "line_no", F.posexplode(tx.kv_tokens(F.col("msg"))).alias("pos", "token")).withColumn("pos", F.col("pos").cast("bigint"))


def counts_per_file(lines: DataFrame) -> DataFrame:
    """(file_name, token, count); combined partially before the shuffle."""
    return lines.select("file_name", F.explode(tx.kv_tokens(F.col("msg"))).alias("token")).groupBy("file_name", "token").agg(F.count(F.lit(1)).alias("count"))


def total_counts(per_file: DataFrame, filtered: bool = False) -> DataFrame:
    """(token, total_count) over all files; filtered: without the skipped prefixes."""
    rows = per_file.filter(~tx.skipped(F.col("token"))) if filtered else per_file
    return rows.groupBy("token").agg(F.sum("count").alias("total_count"))


def top_tokens(totals: DataFrame, k: int = 20) -> DataFrame:
    return totals.orderBy(F.desc("total_count"), "token").limit(k)


def file_count(per_file: DataFrame) -> DataFrame:
    """Distinct files with at least one token."""
    return per_file.select("file_name").distinct().agg(F.count(F.lit(1)).alias("file_count"))


def read_once(lines: DataFrame) -> DataFrame:
    """(file_name, line_no, msg): lines that were read twice count once, the greatest text should they differ."""
    return lines.groupBy("file_name", "line_no").agg(F.max("msg").alias("msg"))


def fact_rows(chunks: DataFrame) -> DataFrame:
    """(file_name, token, count) of a fact table whose files come in chunks, some of them loaded again.

    Of the rows of a (file, chunk, token) the one loaded last counts; then rows with a null or blank token, a null file
    name or a count below one hold nothing. Rows are shuffled once, by (file, token).
    """
    return (
        chunks.filter(F.col("file_name").isNotNull() & (F.trim("token") != ""))
        .select("file_name", "chunk_no", "token", F.struct("loaded_at", "count").alias("loaded"))
        .repartition("file_name", "token")
        .groupBy("file_name", "token", "chunk_no")
        .agg(F.max("loaded")["count"].cast("bigint").alias("count"))
        .filter(F.col("count") >= 1)
        .groupBy("file_name", "token")
        .agg(F.sum("count").alias("count"))
    )


def token_distribution(per_file: DataFrame) -> DataFrame:
    """How each token is distributed over all files, files without it counting as zero.

    Counts are first folded to (token, count, number of files), so a token in a third of all files is
    a handful of rows; zeros come back as one weighted row. Percentiles are exact and interpolated.
    """
    rows = per_file.filter(~tx.skipped(F.col("token")))
    n_files = F.col("file_count")
    weighted = rows.groupBy("token", "count").agg(F.count(F.lit(1)).alias("files"))
    per_token = weighted.groupBy("token").agg(
        F.sum(F.col("count") * F.col("files")).alias("total_count"),
        F.sum("files").alias("files_with_token"),
        F.sum(F.col("count") * F.col("count") * F.col("files")).alias("squares"),
        F.min("count").alias("least"),
        F.max("count").alias("max_per_file"),
        F.array_sort(F.collect_list(F.struct("count", "files"))).alias("steps"),
    )
    total = per_file.select("file_name").distinct().agg(F.count(F.lit(1))).scalar()
    s1, s2 = F.col("total_count"), F.col("squares")
    zeros = n_files - F.col("files_with_token")

    def at(rank):
        """The count at a rank from 0 among all files in ascending order."""
        inside = F.aggregate(
            "steps",
            F.struct(zeros.alias("seen"), F.lit(0).cast("bigint").alias("value")),
            lambda a, x: F.when(a["seen"] > rank, a).otherwise(F.struct((a["seen"] + x["files"]).alias("seen"), x["count"].cast("bigint").alias("value"))),
            lambda a: a["value"],
        )
        return F.when(rank < zeros, F.lit(0).cast("bigint")).otherwise(inside)

    def percentile(p: int):
        k = (n_files - 1) * p
        low = F.floor(k / F.lit(100))
        part = (k % 100) / F.lit(100.0)
        return at(low) + (at(F.least(low + 1, n_files - 1)) - at(low)) * part

    spread = (s2 - s1 * s1 / n_files) / (n_files - 1)
    r4 = lambda c: F.round(c, 4)
    return per_token.withColumn("file_count", total).select(
        "token",
        "total_count",
        r4(s1 / n_files).alias("avg_per_file"),
        "file_count",
        "files_with_token",
        zeros.alias("files_without_token"),
        r4(F.col("files_with_token") / n_files).alias("presence_ratio"),
        F.when(zeros == 0, F.col("least")).otherwise(0).cast("bigint").alias("min_per_file"),
        r4(percentile(25)).alias("p25_per_file"),
        r4(percentile(50)).alias("median_per_file"),
        r4(percentile(75)).alias("p75_per_file"),
        F.col("max_per_file").cast("bigint").alias("max_per_file"),
        r4(F.when(n_files > 1, F.sqrt(F.greatest(spread, F.lit(0.0)))).otherwise(0.0)).alias("std_per_file"),
        r4(s1 / n_files).alias("mean_per_file"),
    )


def capped_documents(per_file: DataFrame, cap: int = tx.MAX_REPEAT) -> DataFrame:
    """(file_name, text): each file as its tokens, each repeated 1 to ``cap`` times, in order of token."""
    return per_file.groupBy("file_name").agg(F.collect_list(F.struct(F.col("token"), F.col("count").alias("n"))).alias("t")).select("file_name", tx.capped_document(F.col("t"), cap).alias("text"))


def _payloads(line: Column) -> tuple[Column, Column]:
    """(whether a line holds arguments, its decoded hexadecimal arguments with anything printable)."""
    arg_line = ~F.contains(line, F.lit("type=SYSCALL")) & line.rlike(r"(?U)type=EXECVE\b")
    decoded = F.transform(F.regexp_extract_all(line, F.lit(r"(?U)\ba\p{Nd}+=([0-9A-Fa-f]{8,})\b"), F.lit(1)), tx.hex_text)
    return arg_line, F.filter(decoded, lambda p: p.rlike(r"[^\p{C}\p{Z}]|\x20"))


def host_payload(lines: DataFrame) -> DataFrame:
    """(file_name, payload): the decoded arguments of each file, in order of their text."""
    one = lines.select("file_name", F.explode(tx.split_lines(F.coalesce(F.col("msg"), F.lit("")))).alias("line"))
    arg_line, shown = _payloads(F.col("line"))
    return one.filter(arg_line).select("file_name", F.explode(shown).alias("p")).groupBy("file_name").agg(F.array_join(F.array_sort(F.collect_list("p")), " ").alias("payload"))


def host_counters(lines: DataFrame) -> DataFrame:
    """(file_name, 8 counters and ratios) of the audit lines of each file, in one aggregation.

    A line is cut at all line separators first, as enriched records hold some.
    """
    one = lines.select("file_name", F.explode(tx.split_lines(F.coalesce(F.col("msg"), F.lit("")))).alias("line"))
    syscall = F.contains("line", F.lit("type=SYSCALL"))
    failed = syscall & F.contains("line", F.lit("success=no"))
    execve = syscall & (F.contains("line", F.lit("SYSCALL=execve")) | F.contains("line", F.lit("syscall=59")))
    arg_line, shown = _payloads(F.col("line"))
    chars = F.aggregate(F.transform(shown, lambda p: F.length(p)), F.lit(0), lambda a, n: a + n)
    c = one.groupBy("file_name").agg(
        F.count_if(syscall).alias("syscall_total"),
        F.count_if(failed).alias("syscall_failed"),
        F.count_if(syscall & (F.regexp_extract("line", r"(?U)\bexit=(-?\p{Nd}+)", 1) == "-2")).alias("syscall_exit_neg2"),
        F.count_if(execve).alias("execve_total"),
        F.count_if(execve & failed).alias("execve_failed"),
        F.coalesce(F.sum(F.when(arg_line, chars)), F.lit(0)).alias("execve_payload_chars"),
    )
    return c.select(
        "file_name", "syscall_total", "syscall_failed", "syscall_exit_neg2",
        F.round(ratio(F.col("syscall_failed"), F.col("syscall_total")), 6).alias("syscall_failed_ratio"),
        "execve_total", "execve_failed",
        F.round(ratio(F.col("execve_failed"), F.col("execve_total")), 6).alias("execve_failed_ratio"),
        F.col("execve_payload_chars").cast("bigint").alias("execve_payload_chars"),
    )


def sample_cap(rows: DataFrame, group: str, order: str, cap: int, salts: int = 64) -> DataFrame:
    """The first ``cap`` rows of each group by ``order``: first per salted part, then of what is left."""
    part = Window.partitionBy(group, "__salt").orderBy(order)
    first = rows.withColumn("__salt", F.pmod(F.xxhash64(order), F.lit(salts))).withColumn("__r", F.row_number().over(part)).filter(F.col("__r") <= cap)
    return first.withColumn("__r", F.row_number().over(Window.partitionBy(group).orderBy(order))).filter(F.col("__r") <= cap).drop("__r", "__salt")
