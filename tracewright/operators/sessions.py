"""Session sets: which samples have which evidence, and their labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.operators.orphans import canonical_name


def names(df: DataFrame, column: str) -> DataFrame:
    """Distinct session names (canonical) of a column of file names."""
    return df.select(canonical_name(F.col(column)).alias("name")).filter(F.col("name").isNotNull()).distinct()


def both(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def either(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def only_left(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def manifest(a: DataFrame, b: DataFrame) -> DataFrame:
    """(name, has_audit, has_pcap, pcap_file) of the full outer join of two name sets."""
    left, right = a.withColumn("has_audit", F.lit(True)), b.withColumn("has_pcap", F.lit(True))
    return left.join(right, "name", "full_outer").select(
        "name",
        F.coalesce("has_audit", F.lit(False)).alias("has_audit"),
        F.coalesce("has_pcap", F.lit(False)).alias("has_pcap"),
        F.when(F.col("has_pcap"), F.concat("name", F.lit("_network.pcap"))).otherwise("").alias("pcap_file"),
    )


def coverage(rows: DataFrame, audit: str = "has_audit", pcap: str = "has_pcap") -> DataFrame:
    """One row: rows with both modalities, one of them, neither."""
    a, p = F.coalesce(F.col(audit), F.lit(False)), F.coalesce(F.col(pcap), F.lit(False))
    return rows.agg(F.count_if(a & p).alias("both"), F.count_if(a & ~p).alias("audit_only"), F.count_if(~a & p).alias("pcap_only"), F.count_if(~a & ~p).alias("neither"))


def resolve(mode: str, audit: DataFrame, pcap: DataFrame, unified: bool = False, require_both: bool = False) -> DataFrame:
    """The names a run mode works on: intersection, union or one modality."""
    if unified or mode == "all" or (mode == "fusion" and require_both):
        return both(audit, pcap)
    return {"fusion": lambda: either(audit, pcap), "audit_only": lambda: audit, "pcap_only": lambda: pcap}[mode]()


def last_labels(truth: DataFrame, key: Column, label: str, *order: Column) -> DataFrame:
    """(name, label): of several labels of a name the last holds; unlabelled rows are left out."""
    rows = truth.select(key.alias("name"), F.col(label).alias("label"), F.struct(*order).alias("o")).filter(F.col("name").isNotNull() & F.col("label").isNotNull())
    return rows.groupBy("name").agg(F.max(F.struct("o", "label"))["label"].alias("label"))


def labels_defaulted(samples: DataFrame, labels: DataFrame, default: int = 0) -> DataFrame:
    """(name, label): every sample with its label, ``default`` where it has none."""
    return samples.join(labels, "name", "left").select("name", F.coalesce("label", F.lit(default)).alias("label"))


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Union of sources where the row that is last in ``order`` holds per key."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def keyword_hits(documents: DataFrame, text: str, keywords: list[str], per_pass: int = 500) -> DataFrame:
    """Documents that hold any keyword, case-sensitive; blank keywords are dropped.

    The list is a parameter of the run; it goes into the plan as literal arrays of ``per_pass``.
    """
    kept = [k for k in dict.fromkeys(keywords) if k and k.strip()]
    hit = F.lit(False)
    for i in range(0, len(kept), per_pass):
        hit = hit | F.exists(F.array(*map(F.lit, kept[i : i + per_pass])), lambda k: F.contains(F.col(text), k))
    return documents.filter(hit)
