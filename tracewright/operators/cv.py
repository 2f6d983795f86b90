"""Group-stratified folds: groups stay whole, folds alike in size and classes."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARD = 20_000


def group_folds(rows: DataFrame, group: str, label: str, folds: int = 10, seed: int = 42, shard: int = SHARD) -> DataFrame:
    """(group, fold): each group, largest first, to the fold whose class counts it leaves least uneven.

    Only groups with their class counts are placed. They are hashed into shards of about ``shard`` groups,
    placed shard by shard in parallel, and balanced in each, hence in all. Ties go by seeded hash.
    """
    groups = rows.filter(F.col(group).isNotNull()).groupBy(group).agg(F.count_if(F.col(label) == 0).alias("n0"), F.count_if(F.col(label) == 1).alias("n1"), F.count(F.lit(1)).alias("n"))
    shards = max(1, math.ceil(groups.count() / shard))
    at = F.pmod(F.xxhash64(F.col(group), F.lit(seed)), F.lit(shards))

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n", "tie"], ascending=[False, True]).reset_index(drop=True)
        have = [[0, 0] for _ in range(folds)]
        size = [0] * folds
        goal = [max(pdf["n0"].sum() / folds, 1e-9), max(pdf["n1"].sum() / folds, 1e-9)]
        out = []
        for n0, n1, n in zip(pdf["n0"], pdf["n1"], pdf["n"]):
            cost = [((h[0] + n0) / goal[0]) ** 2 - (h[0] / goal[0]) ** 2 + ((h[1] + n1) / goal[1]) ** 2 - (h[1] / goal[1]) ** 2 for h in have]
            k = min(range(folds), key=lambda k: (cost[k], size[k], k))
            have[k][0] += n0
            have[k][1] += n1
            size[k] += n
            out.append(k)
        return pd.DataFrame({group: pdf[group], "fold": out})

    return groups.withColumn("tie", F.xxhash64(F.col(group), F.lit(seed + 1))).groupBy(at.alias("at")).applyInPandas(place, f"{group} string, fold int")
