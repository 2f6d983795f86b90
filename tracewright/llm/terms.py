"""Frequency of every distinct term, and how distinctive a term is per record.

Both operators start from per-record term counts. Rows are partitioned once, by (file, term): the rule
that the row loaded last counts per (file, chunk, token), the sum per (file, term) and every later
grouping that keeps both keys work inside that partitioning, so the fact table is shuffled once however
many chunks a file has, and neither a hot file nor a hot term meets in one task. Per term and per file sums
are combined partially by hash before their shuffle.

Defined cases: a null or blank token, a null file name, or a count that is null or below one holds no
occurrence; of repeated rows the last loaded counts, on a tie the greatest count, and a row without a load
time was loaded before all others. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.text import skipped
from tracewright.runtime import written


def term_of(token: Column) -> Column:
    """A token without outer blanks, then without apostrophes at its end, in lower case."""
    return F.lower(F.rtrim(F.trim(token), F.lit("'")))


def term_counts(counts: DataFrame) -> DataFrame:
    """(file_name, term, tf): occurrences of each term in each file, from the chunked counts."""
    term = term_of(F.col("token"))
    return (
        counts.filter(F.col("file_name").isNotNull() & (F.trim("token") != "") & ~skipped(term))
        .select("file_name", "chunk_no", "token", F.struct("loaded_at", "count").alias("loaded"))
        .repartition("file_name", term)
        .groupBy("file_name", term.alias("term"), "chunk_no", "token")
        .agg(F.max("loaded")["count"].cast("bigint").alias("count"))
        .filter(F.col("count") >= 1)
        .groupBy("file_name", "term")
        .agg(F.sum("count").alias("tf"))
    )


def file_total(counts: DataFrame) -> Column:
    """The number of distinct non-null file names of the table, as a scalar subquery."""
    return counts.select("file_name").filter(F.col("file_name").isNotNull()).distinct().agg(F.count(F.lit(1))).scalar()


def term_frequency(counts: DataFrame, rare_at_most: int = 1, common_above: tuple[int, int] = (95, 100)) -> DataFrame:
    """(token, occurrences, files, mark) of every distinct term.

    mark is ``rare`` in at most ``rare_at_most`` files, ``common`` in more than the given fraction of
    all files of the table, else ``kept``. A term that is both is rare.
    """
    per, of = common_above
    return (
        term_counts(counts)
        .groupBy(F.col("term").alias("token"))
        .agg(F.sum("tf").alias("occurrences"), F.count(F.lit(1)).alias("files"))
        .withColumn("mark", F.when(F.col("files") <= rare_at_most, "rare").when(F.col("files") * of > file_total(counts) * per, "common").otherwise("kept"))
    )


def term_relevance(counts: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """BM25 weight of every (file, term): ``file_name, token, tf, file_length, term_total, files, file_count, total, mean_length, score``.

    score = ln(1 + (N - df + 0.5) / (df + 0.5)) * tf (k1 + 1) / (tf + k1 (1 - b + b dl / avgdl)), where N
    is the number of files of the table and avgdl the mean length of the files that hold a term. The
    counts and statistics cover all rows. The counts of terms are written once and read for each statistic.
    """
    tf = written(term_counts(counts), "term-counts")
    per_file = tf.groupBy("file_name").agg(F.sum("tf").alias("file_length"))
    per_term = tf.groupBy("term").agg(F.sum("tf").alias("term_total"), F.count(F.lit(1)).alias("files"))
    whole = per_file.agg(F.struct(F.sum("file_length").alias("total"), F.count(F.lit(1)).alias("n"))).scalar()
    idf = F.log1p((F.col("file_count") - F.col("files") + 0.5) / (F.col("files") + 0.5))
    norm = k1 * (1 - b + b * F.col("file_length") / F.col("mean_length"))
    return (
        tf.join(per_file, "file_name")
        .join(per_term, "term")
        .withColumns({"file_count": file_total(counts), "whole": whole})
        .withColumns({"total": F.col("whole.total"), "mean_length": F.try_divide(F.col("whole.total"), F.col("whole.n"))})
        .withColumn("score", idf * F.col("tf") * (k1 + 1) / (F.col("tf") + norm))
        .select("file_name", F.col("term").alias("token"), "tf", "file_length", "term_total", "files", "file_count", "total", "mean_length", "score")
    )


def least_score(share: int, spread: int, k1: float = 1.2, b: float = 0.75) -> Column:
    """A BM25 weight that no term is below which makes up 1/``share`` of its file and is in at most 1/``spread`` of the files.

    Its idf is least where it is in as many files as allowed. As its file's length is at most ``share`` times tf,
    and tf at least 1, its saturated frequency is at least (k1 + 1) / (1 + k1 (1 - b) + k1 b share / avgdl).
    """
    most = F.floor(F.col("file_count") / F.lit(spread))
    idf = F.log1p((F.col("file_count") - most + 0.5) / (most + 0.5))
    return idf * (k1 + 1) / (1 + k1 * (1 - b) + k1 * b * share / F.col("mean_length"))


def distinctive_terms(counts: DataFrame, share: int = 10, lift: int = 10, fewest: int = 2, spread: int = 10) -> DataFrame:
    """The rows of ``term_relevance`` whose term marks its file: those scored high enough, then checked.

    The term makes up at least 1/``share`` of its file, at least ``lift`` times its share of the whole
    collection, and is in at least ``fewest`` and at most 1/``spread`` of the files. Candidates are the rows with
    at least the score such a term has (``least_score``, less rounding); the conditions are compared in integers.
    """
    big = lambda c: F.col(c).cast("decimal(19,0)")
    candidates = term_relevance(counts).filter(F.col("score") >= least_score(share, spread) * (1 - 1e-9))
    return candidates.filter(
        (F.col("tf") * share >= F.col("file_length"))
        & (big("tf") * big("total") >= big("term_total") * (F.col("file_length") * lift).cast("decimal(19,0)"))
        & (F.col("files") >= fewest)
        & (F.col("files") * spread <= F.col("file_count"))
    )
