"""References to records that do not exist.

Parent keys are strings that end in an integer (``<stem><number>``). They are split into a stem and
an integer, the integers of a stem are sorted and compressed into contiguous runs, and each reference
is matched as-of to the preceding run start: it dangles if its integer lies beyond that run's end.

Every stem is cut into blocks of ``BLOCK`` consecutive integers, so no sort, run list or array ever
exceeds ``BLOCK`` keys, however many records one stem holds. Parents are reduced to one row per key
before they are grouped by block. The reference side is never grouped: it meets the run table in an
equi-join on (stem, block), which Spark broadcasts if the run table is small and which adaptive
execution splits if one block is hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Consecutive integers of a stem that share a block; the bound of every array below.
BLOCK = 1024
#: Outer characters and endings that names are compared without.
OUTER = " \t﻿"
ENDINGS = ("_audit-logs.log", "_network.pcap")


def canonical_name(name: Column) -> Column:
    """``name`` without outer blanks, tabs and byte-order marks, in lower case, without its ending."""
    ending = "(?:" + "|".join(e.replace(".", r"\.") for e in ENDINGS) + ")$"
    return F.regexp_replace(F.lower(F.trim(name, F.lit(OUTER))), ending, "")


def split_key(name: Column) -> tuple[Column, Column]:
    """(stem, number) of a name, one to one: ``stem`` followed by ``number`` is the name again.

    Leading zeros stay with the stem, so ``x_007`` and ``x_7`` differ. A name that ends in no digit
    has the number -1, which no digits can give. At most 18 digits are taken, so a bigint holds them.
    """
    digits = F.regexp_extract(name, r"^(?s:.*?)(0|[1-9][0-9]{0,17})$", 1)
    has = digits != ""
    return (
        F.when(has, F.substring(name, F.lit(1), F.length(name) - F.length(digits))).otherwise(name),
        F.when(has, digits.cast("bigint")).otherwise(F.lit(-1).cast("bigint")),
    )


def _keyed(df: DataFrame, name: Column) -> DataFrame:
    stem, number = split_key(F.col("__name"))
    return (
        df.withColumn("__name", name)
        .withColumns({"__stem": stem, "__num": number})
        .withColumn("__block", F.floor(F.col("__num") / F.lit(BLOCK)))
        .drop("__name")
    )


def key_runs(parents: DataFrame) -> DataFrame:
    """Runs of contiguous parent keys.

    parents: ``parent`` (which table), ``name``, ``gone`` boolean (the row is deleted), ``came``
    timestamp (its arrival). Rows with a null name are no parents. Returns ``parent, __stem, __block,
    runs``; runs is sorted by ``lo`` and each run holds, per integer from lo to hi, whether a row is
    live and the earliest arrival of its live rows.
    """
    live = ~F.coalesce(F.col("gone"), F.lit(False))
    per_key = (
        _keyed(parents.filter(F.col("name").isNotNull()), F.col("name"))
        .groupBy("parent", "__stem", "__block", "__num")
        .agg(F.bool_or(live).alias("live"), F.min(F.when(live, F.col("came"))).alias("first"))
    )
    order = Window.partitionBy("parent", "__stem", "__block").orderBy("__num")
    return (
        per_key.withColumn("island", F.col("__num") - F.row_number().over(order))
        .groupBy("parent", "__stem", "__block", "island")
        .agg(
            F.min("__num").alias("lo"),
            F.max("__num").alias("hi"),
            F.array_sort(F.collect_list(F.struct("__num", "live", "first"))).alias("keys"),
        )
        .groupBy("parent", "__stem", "__block")
        .agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "keys"))).alias("runs"))
    )


def dangling(references: DataFrame, runs: DataFrame) -> DataFrame:
    """References whose record is missing, deleted or came later, one row each.

    references: ``ref_name, parent, name, record_key, at``; name is canonical. A null name refers to
    nothing and is reported as missing. The status ``late`` needs both times; where one is null the
    reference is sound. Repeated references come out once. Without parents everything is missing.
    """
    found = F.col("run").isNotNull() & (F.col("__num") <= F.col("run.hi"))
    key = F.element_at(F.col("run.keys"), (F.col("__num") - F.col("run.lo") + 1).cast("int"))
    joined = (
        _keyed(references, F.col("name"))
        .join(runs, ["parent", "__stem", "__block"], "left")
        .withColumn("run", F.try_element_at(F.filter("runs", lambda r: r["lo"] <= F.col("__num")), F.lit(-1)))
    )
    return (
        joined.withColumn("key", F.when(found, key))
        .withColumn(
            "status",
            F.when(F.col("key").isNull(), "missing")
            .when(~F.col("key.live"), "deleted")
            .when(F.col("key.first") > F.col("at"), "late"),
        )
        .filter(F.col("status").isNotNull())
        .select(
            "ref_name",
            "record_key",
            F.coalesce(F.date_format("at", "yyyy-MM"), F.lit("unknown")).alias("period"),
            "status",
        )
        .distinct()
    )


def session_orphans(samples: DataFrame, audit: DataFrame, pcap: DataFrame, results: DataFrame) -> DataFrame:
    """Dangling references of the session tables: ``ref_name, record_key, period, status``."""
    parents = (
        audit.select(F.lit("audit").alias("parent"), canonical_name(F.col("file_name")).alias("name"), F.col("deleted_at").isNotNull().alias("gone"), F.col("received_at").alias("came"))
        .unionByName(pcap.select(F.lit("pcap").alias("parent"), canonical_name(F.col("pcap_name")).alias("name"), F.col("deleted_at").isNotNull().alias("gone"), F.col("received_at").alias("came")))
        .unionByName(samples.select(F.lit("sample").alias("parent"), canonical_name(F.col("file_name")).alias("name"), F.col("retired_at").isNotNull().alias("gone"), F.col("built_at").alias("came")))
    )
    kinds = F.array(
        F.when(F.col("has_audit"), F.lit("audit")),
        F.when(F.col("has_pcap"), F.lit("pcap")),
    )
    refs = (
        samples.filter(F.col("has_audit") | F.col("has_pcap"))
        .select(F.explode(F.array_compact(kinds)).alias("ref_name"), "file_name", "built_at")
        .select("ref_name", F.col("ref_name").alias("parent"), canonical_name(F.col("file_name")).alias("name"), F.col("file_name").alias("record_key"), F.col("built_at").alias("at"))
        .unionByName(
            results.filter(F.col("sample_id").isNotNull()).select(
                F.lit("sample").alias("ref_name"),
                F.lit("sample").alias("parent"),
                canonical_name(F.col("sample_id")).alias("name"),
                F.col("result_id").cast("string").alias("record_key"),
                F.col("scored_at").alias("at"),
            )
        )
    )
    return dangling(refs, key_runs(parents))


def orphan_report(found: DataFrame) -> DataFrame:
    """Dangling references counted per table, month and status."""
    return found.groupBy("ref_name", "period", "status").agg(F.count(F.lit(1)).alias("n"))
