"""Streaming forms of the token statistics: running counts per file and per event-time window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.functions import text as tx


def running_counts(lines: DataFrame) -> DataFrame:
    """(file_name, token, count) of a stream of audit lines so far; for update or complete output."""
    return lines.select("file_name", F.explode(tx.kv_tokens(F.col("msg"))).alias("token")).groupBy("file_name", "token").agg(F.count(F.lit(1)).alias("count"))


def windowed_counts(lines: DataFrame, time: str = "read_at", width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(start, token, count) per event-time window; a window closes ``late`` after its end, later lines are dropped."""
    seen = lines.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", late)
    one = seen.select("__t", F.explode(tx.kv_tokens(F.col("msg"))).alias("token"))
    return one.groupBy(F.window("__t", width).alias("w"), "token").agg(F.count(F.lit(1)).alias("count")).select(F.col("w.start").alias("start"), "token", "count")
