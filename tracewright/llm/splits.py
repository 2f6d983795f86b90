"""Splits that keep related records together.

Records are grouped by an entity (here the skill in their file name, followed through renames by
pointer doubling). Groups become components of fixed weights, and largest differencing combines the
extreme weights into many equal bins, which are then given whole to the splits.

Nothing about single groups reaches the driver or one task: groups are hashed into shards of about
``SHARD`` groups, each shard is differenced into ``BINS`` bins by itself, the bins of ``SHARD // BINS``
shards are differenced again, and so on until ``BINS`` bins are left. Only those are given to splits on
the driver. A group that holds a third of all rows is one weight, whatever its number of rows.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.runtime import cut, written

SHARD = 20_000
BINS = 100
SPLITS = (("train", 0.8), ("validation", 0.1), ("test", 0.1))
WEIGHTS = ("w0", "w1", "w2")


def one_form(name: Column) -> Column:
    """A skill name in lower case with one ``-`` for each run of hyphen, underscore, dot or blank."""
    return F.regexp_replace(F.lower(name), r"[-_.\s]+", "-")


def skill_of(file_name: Column) -> Column:
    """What stands before the last ``_prompt_<number>`` ahead of ``_audit-logs.log``, or all before that."""
    numbered = F.regexp_extract(file_name, r"(?is)^(.*)_prompt_\d+_audit-logs\.log$", 1)
    bare = F.regexp_replace(file_name, r"(?i)_audit-logs\.log$", "")
    return F.when(file_name.rlike(r"(?is)^.*_prompt_\d+_audit-logs\.log$"), numbered).otherwise(bare)


def followed_renames(catalog: DataFrame) -> DataFrame:
    """(name, last): every renamed skill and where its renames end, both in one form.

    Pointers are doubled, so chains of length n take log2(n) rounds. Of several renames of a skill the
    one added last holds. A skill renamed to itself is not renamed; renames in a circle end at the
    circle's least name.
    """
    hops = cut(
        catalog.select(one_form(F.col("skill")).alias("name"), one_form(F.col("renamed_to")).alias("last"), "added_at")
        .filter(F.col("name").isNotNull() & F.col("last").isNotNull() & (F.col("name") != F.col("last")))
        .groupBy("name")
        .agg(F.max(F.struct("added_at", "last"))["last"].alias("last"))
        .withColumn("least", F.least("name", "last"))
    )
    rounds = math.ceil(math.log2(hops.count() + 1)) + 1
    for _ in range(rounds):
        onward = hops.select(F.col("name").alias("last"), F.col("last").alias("further"), F.col("least").alias("least_further"))
        hops = cut(
            hops.join(onward, "last", "left").select(
                "name",
                F.coalesce("further", "last").alias("last"),
                F.least("least", "least_further").alias("least"),
                F.col("further").isNotNull().alias("moved"),
            )
        )
        if hops.filter("moved").isEmpty():
            return hops.select("name", "last")
        hops = hops.drop("moved")
    circle = hops.select(F.col("name").alias("last"), F.col("least").alias("circle"))
    return hops.join(circle, "last", "left").select("name", F.coalesce("circle", "last").alias("last"))


def grouped_samples(samples: DataFrame, catalog: DataFrame) -> DataFrame:
    """(file_name, group_key, label): each distinct non-null file name with its skill after all renames.

    label is that of the record built last. An empty table gives an empty result.
    """
    named = samples.filter(F.col("file_name").isNotNull()).groupBy("file_name").agg(F.max(F.struct("built_at", "label"))["label"].alias("label"))
    skills = named.withColumn("name", one_form(skill_of(F.col("file_name"))))
    return skills.join(followed_renames(catalog), "name", "left").select("file_name", F.coalesce("last", "name").alias("group_key"), "label")


def difference(weights: np.ndarray, bins: int) -> np.ndarray:
    """The bin of each row of ``weights`` (items x classes) by largest differencing of their totals.

    Each item starts as a partition with one filled bin. Again and again the two partitions with the
    widest spread are combined, the heaviest bins of one with the lightest of the other.
    """
    n = len(weights)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    totals = weights.sum(1).astype(float)
    heap = []
    for i in range(n):
        heap.append((-totals[i], i, [(totals[i], (i,))]))
    heapq.heapify(heap)
    serial = n
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        room = bins - len(a)
        if len(b) <= room:  # b's bins go on empty bins of a
            merged = a + b
        else:  # b's heaviest on a's empty bins, its others on a's lightest
            rest = b[room:]
            k = len(rest)
            merged = a[: len(a) - k] + [(x[0] + y[0], (x[1], y[1])) for x, y in zip(a[len(a) - k :], reversed(rest))] + b[:room]
        merged.sort(key=lambda x: -x[0])
        low = merged[-1][0] if len(merged) == bins else 0.0
        heapq.heappush(heap, (-(merged[0][0] - low), serial, merged))
        serial += 1
    out = np.zeros(n, dtype=np.int64)
    for j, (_, members) in enumerate(heap[0][2]):
        todo = [members]
        while todo:
            x = todo.pop()
            if isinstance(x, tuple):
                todo += x
            else:
                out[x] = j
    return out


def balanced_bins(components: DataFrame, bins: int = BINS, shard: int = SHARD) -> tuple[DataFrame, list]:
    """((key, bin), [(bin, w0, w1, w2)]): components (key, w0, w1, w2) in ``bins`` bins of about equal weight."""
    level = written(components.select("key", *WEIGHTS), "components")
    shards = max(1, math.ceil(level.count() / shard))
    out = "item string, bin bigint, w0 bigint, w1 bigint, w2 bigint, at bigint"

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("item").reset_index(drop=True)
        pdf["bin"] = difference(pdf[list(WEIGHTS)].to_numpy(), bins)
        pdf["at"] = key[0]
        return pdf[["item", "bin", *WEIGHTS, "at"]]

    items = level.select(F.col("key").alias("item"), *WEIGHTS).withColumn("at", F.pmod(F.xxhash64("item"), F.lit(shards)))
    chain: DataFrame | None = None
    while True:
        placed = written(items.groupBy("at").applyInPandas(one, out), "bins")
        name = F.concat_ws(":", F.col("at").cast("string"), F.col("bin").cast("string"))
        step = placed.select("item", name.alias("into"))
        chain = step.select(F.col("item").alias("key"), "into") if chain is None else chain.join(step.withColumnRenamed("into", "next"), chain["into"] == F.col("item")).select("key", F.col("next").alias("into"))
        sums = placed.groupBy("at", "bin").agg(*[F.sum(w).cast("bigint").alias(w) for w in WEIGHTS])
        if shards == 1:
            final = [(f"{r['at']}:{r['bin']}", *(r[w] for w in WEIGHTS)) for r in sums.collect()]  # at most ``bins`` rows
            return chain.select("key", F.col("into").alias("bin")), sorted(final)
        fan = max(2, shard // bins)
        shards = math.ceil(shards / fan)
        items = sums.select(name.alias("item"), *WEIGHTS, F.floor(F.col("at") / F.lit(fan)).alias("at"))


def bins_to_splits(bins: list, splits=SPLITS) -> dict[str, str]:
    """Whole bins given to splits so that every weight class comes near its target share.

    The heaviest bin goes first, each to the split that is then least off; then bins are moved and
    swapped as long as that brings the shares nearer.
    """
    if not bins:
        return {}
    w = np.array([b[1:] for b in bins], dtype=float)
    goal = np.outer([s for _, s in splits], w.sum(0))
    scale = 1 / np.maximum(goal, 1.0)
    at = np.zeros(len(bins), dtype=int)
    have = np.zeros_like(goal)

    def off(h: np.ndarray) -> float:
        return float(((h - goal) ** 2 * scale).sum() + ((h.sum(1) - goal.sum(1)) ** 2 / np.maximum(goal.sum(1), 1)).sum())

    for i in sorted(range(len(bins)), key=lambda i: (-w[i].sum(), bins[i][0])):
        gaps = (goal.sum(1) - have.sum(1)) / np.maximum(goal.sum(1), 1)
        fits = [k for k in range(len(splits)) if have[k].sum() + w[i].sum() <= goal[k].sum() * 1.0000001]
        k = max(fits or range(len(splits)), key=lambda k: gaps[k] if fits else goal[k].sum() - have[k].sum())
        at[i] = k
        have[k] += w[i]
    best = off(have)
    for _ in range(20):
        changed = False
        for i in range(len(bins)):
            for k in range(len(splits)):
                if k != at[i]:
                    h = have.copy()
                    h[at[i]] -= w[i]
                    h[k] += w[i]
                    if (o := off(h)) < best - 1e-9:
                        have, best, changed = h, o, True
                        at[i] = k
            for j in range(i):
                if at[i] != at[j]:
                    h = have.copy()
                    h[at[i]] += w[j] - w[i]
                    h[at[j]] += w[i] - w[j]
                    if (o := off(h)) < best - 1e-9:
                        have, best, changed = h, o, True
                        at[i], at[j] = at[j], at[i]
        if not changed:
            break
    return {bins[i][0]: splits[at[i]][0] for i in range(len(bins))}


def grouped_split(records: DataFrame, splits=SPLITS, bins: int = BINS, shard: int = SHARD) -> DataFrame:
    """records (key column ``group_key``, ``label``) with ``split``; all records of a group share it.

    Shares are met in records, with those of label 0, label 1 and any other label alike as far as whole
    groups allow. A null group is a group of its own.
    """
    records = written(records, "records")
    key = F.coalesce(F.concat(F.lit("k"), F.col("group_key")), F.lit("null"))
    zero, one = F.coalesce(F.col("label") == 0, F.lit(False)), F.coalesce(F.col("label") == 1, F.lit(False))
    components = records.groupBy(key.alias("key")).agg(F.count_if(zero).alias("w0"), F.count_if(one).alias("w1"), F.count_if(~zero & ~one).alias("w2"))
    placed, totals = balanced_bins(components, bins, shard)
    given = bins_to_splits(totals, splits)
    spark = records.sparkSession
    table = spark.createDataFrame(list(given.items()), "bin string, split string")  # at most ``bins`` rows
    by_key = placed.join(F.broadcast(table), "bin").select(F.col("key").alias("__key"), "split")
    return records.drop("split").withColumn("__key", key).join(by_key, "__key", "left").drop("__key")
