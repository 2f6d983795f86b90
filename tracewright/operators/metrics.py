"""Detector metrics, unions, folds and misclassifications, each as one aggregation."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.numeric import ratio

CELLS = ("tp", "tn", "fp", "fn")


def positive(pred: Column) -> Column:
    """Whether a prediction is 1; null and anything else is not."""
    return F.coalesce(pred.cast("string") == "1", F.lit(False))


def cells(label: Column, pred: Column) -> list[Column]:
    p = positive(pred)
    one, zero = F.coalesce(label == 1, F.lit(False)), F.coalesce(label == 0, F.lit(False))
    return [F.count_if(one & p).alias("tp"), F.count_if(zero & ~p).alias("tn"), F.count_if(zero & p).alias("fp"), F.count_if(one & ~p).alias("fn")]


def percent(part: Column, whole: Column) -> Column:
    return F.round(ratio(part * 100.0, whole), 6)


def detector_metrics(rows: DataFrame, *by: str, label: str = "label", pred: str = "pred") -> DataFrame:
    """Counts, accuracy, recall and false-positive rate in percent, 0 over an empty set.

    Labels other than 0 and 1 count only in the total.
    """
    c = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), *cells(F.col(label), F.col(pred)))
    return c.select(
        *by, "total", *CELLS,
        percent(F.col("tp") + F.col("tn"), F.col("total")).alias("accuracy"),
        percent(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"),
        percent(F.col("fp"), F.col("fp") + F.col("tn")).alias("fpr"),
    )


def union_metrics(votes: DataFrame, detectors: list[str], label: str = "label") -> DataFrame:
    """Metrics of every OR-combination of detectors; votes has one boolean column per detector."""
    sets = [s for k in range(1, len(detectors) + 1) for s in combinations(detectors, k)]
    each = F.array(*[F.struct(F.lit("+".join(s)).alias("detectors"), F.greatest(*[F.coalesce(F.col(c), F.lit(False)).cast("int") for c in s], F.lit(0)).alias("vote")) for s in sets])
    rows = votes.select(label, F.explode(each).alias("x")).select(label, "x.*")
    return detector_metrics(rows, "detectors", label=label, pred="vote")


def classification(rows: DataFrame, *by: str, label: str = "label", pred: str = "pred", digits: int = 4) -> DataFrame:
    """accuracy, precision, recall, f1 and the four cells."""
    c = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), *cells(F.col(label), F.col(pred)))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select(
        *by,
        "total",
        F.round(ratio(tp + F.col("tn"), F.col("total")), digits).alias("accuracy"),
        F.round(ratio(tp, tp + fp), digits).alias("precision"),
        F.round(ratio(tp, tp + fn), digits).alias("recall"),
        F.round(ratio(tp * 2, tp * 2 + fp + fn), digits).alias("f1"),
        *CELLS,
    )


def confusion(rows: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """(actual, pred_0, pred_1)."""
    return rows.groupBy(F.col(label).alias("actual")).agg(F.count_if(F.col(pred) == 0).alias("pred_0"), F.count_if(F.col(pred) == 1).alias("pred_1"))


def error_type(label: Column, pred: Column) -> Column:
    return F.when((label == 0) & (pred == 1), "FP").when((label == 1) & (pred == 0), "FN").otherwise("OK")


def misclassified(rows: DataFrame, *keep: str, label: str = "label", pred: str = "pred") -> DataFrame:
    return rows.filter(F.col(label) != F.col(pred)).select(*keep, F.col(label).alias("actual"), F.col(pred).alias("predicted"), error_type(F.col(label), F.col(pred)).alias("error_type"))


def misclassified_summary(wrong: DataFrame, key: str) -> DataFrame:
    """Per record: in how many folds it was wrong, and which."""
    return wrong.groupBy(key).agg(
        F.count(F.lit(1)).alias("wrong_folds"),
        F.count_if(F.col("error_type") == "FP").alias("fp_count"),
        F.count_if(F.col("error_type") == "FN").alias("fn_count"),
        F.array_join(F.array_sort(F.collect_list("fold")), ",").alias("fold_list"),
    )


def wrong_first(wrong: DataFrame, key: str) -> DataFrame:
    """Misclassified records in the order of the report: most wrong folds first, then by name."""
    return wrong.orderBy(F.desc("wrong_folds"), key)


def first_groups(groups: DataFrame, group: str, k: int = 5) -> DataFrame:
    """The first ``k`` groups by name, as a report of mixed or leaking groups shows them."""
    return groups.orderBy(group).limit(k)


def fold_metrics(rows: DataFrame, fold: str = "fold") -> DataFrame:
    """Per fold: sizes, class counts, rounded metrics. The training side is the whole less the fold."""
    c = classification(rows, fold)
    size = rows.groupBy(fold).agg(F.count_if(F.col("label") == 0).alias("test_innocent"), F.count_if(F.col("label") == 1).alias("test_malicious"))
    whole = rows.agg(F.struct(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == 0).alias("zero"), F.count_if(F.col("label") == 1).alias("one"))).scalar()
    return (
        c.join(size, fold)
        .withColumn("w", whole)
        .select(
            fold,
            (F.col("w.n") - F.col("total")).alias("train_size"),
            F.col("total").alias("test_size"),
            (F.col("w.zero") - F.col("test_innocent")).alias("train_innocent"),
            (F.col("w.one") - F.col("test_malicious")).alias("train_malicious"),
            "test_innocent", "test_malicious", "accuracy", "precision", "recall", "f1", "tn", "fp", "fn", "tp",
        )
    )


def fold_summary(folds: DataFrame) -> DataFrame:
    """(metric, mean, std, min, max) of the rounded metrics of all folds; population deviation."""
    named = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in ("accuracy", "precision", "recall", "f1")])
    r = lambda c, n: F.round(c, 6).alias(n)
    return folds.select(F.explode(named).alias("x")).groupBy(F.col("x.metric").alias("metric")).agg(r(F.avg("x.v"), "mean"), r(F.stddev_pop("x.v"), "std"), r(F.min("x.v"), "min"), r(F.max("x.v"), "max"))


def fold_leakage(rows: DataFrame, group: str, fold: str = "fold") -> DataFrame:
    """Groups found in more than one fold, with their number of folds."""
    return rows.select(group, fold).distinct().groupBy(group).agg(F.count(F.lit(1)).alias("folds")).filter(F.col("folds") > 1)


def mixed_label_groups(rows: DataFrame, group: str) -> DataFrame:
    return rows.filter(F.col("label").isNotNull()).select(group, "label").distinct().groupBy(group).agg(F.count(F.lit(1)).alias("labels")).filter(F.col("labels") > 1)


def group_sizes(rows: DataFrame, group: str) -> DataFrame:
    """One row: number of groups and the least, median and greatest size."""
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.count(F.lit(1)).alias("groups"), F.min("n").alias("least"), F.floor(F.percentile("n", F.lit(0.5))).alias("median"), F.max("n").alias("greatest"))


def prediction_table(rows: DataFrame, *keep: str) -> DataFrame:
    name = lambda c: F.when(F.col(c) == 0, "innocent").when(F.col(c) == 1, "malicious")
    return rows.select(*keep, F.col("pred").alias("predicted"), name("pred").alias("predicted_label"), F.col("label").alias("actual"), name("label").alias("actual_label"), (F.col("pred") == F.col("label")).alias("correct"))
