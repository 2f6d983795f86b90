"""Queries on problems 1, 5 and 6: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewright.operators import logparse, nested, orphans
from tracewright.plans import core_sql
from tracewright.runtime import read_table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    names = ("sample_features", "audit_files", "pcap_files", "results")
    return orphans.session_orphans(*(read_table(spark, d, n) for n in names))


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(p1_found(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_entries(spark, d).drop("message_line")


def p5_entries(spark: SparkSession, d: str) -> DataFrame:
    return logparse.log_entries(read_table(spark, d, "audit_raw"), read_table(spark, d, "audit_files"))


def p5_templates(spark: SparkSession, d: str) -> DataFrame:
    return logparse.template_counts(read_table(spark, d, "audit_raw"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.nested_objects(read_table(spark, d, "session_log"))


def p6_items(spark: SparkSession, d: str) -> DataFrame:
    return nested.content_items(read_table(spark, d, "session_log"))


def p6_calls(spark: SparkSession, d: str) -> DataFrame:
    return nested.tool_calls(read_table(spark, d, "session_log"))


def p6_nodes(spark: SparkSession, d: str) -> DataFrame:
    return nested.argument_nodes(read_table(spark, d, "session_log"))


def p6_objects(spark: SparkSession, d: str) -> DataFrame:
    return nested.schema_tables(nested.argument_nodes(read_table(spark, d, "session_log")))


_ALL = (p1_found, p1_report, p5_found, p5_entries, p5_templates, p6_found, p6_items, p6_calls, p6_nodes, p6_objects)
QUERIES = {f.__name__: f for f in _ALL}
ORACLE = {
    "p1_found": core_sql.P1_FOUND,
    "p1_report": core_sql.P1_REPORT,
    "p5_found": core_sql.P5_FOUND,
    "p6_items": core_sql.P6_ITEMS,
    "p6_calls": core_sql.P6_CALLS,
}
