"""Linear SVM with squared hinge loss: fit over aggregated gradients of dense or sparse rows, scoring as an expression or a join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.runtime import written


def linear_score(features: Column, weights, intercept: float) -> Column:
    """sum(w x) + b in order of position, inside code generation."""
    total = None
    for i, w in enumerate(weights):
        part = F.get(features, F.lit(i)) * F.lit(float(w))
        total = part if total is None else total + part
    return total + F.lit(float(intercept))


def sparse_scores(rows: DataFrame, weights: DataFrame, key: str, intercept: float) -> DataFrame:
    """(key, score, predicted) of long features (key, idx, value) against (idx, weight): join, sum, threshold."""
    s = rows.join(weights, "idx").groupBy(key).agg(F.sum(F.col("value") * F.col("weight")).alias("s"))
    score = F.col("s") + F.lit(intercept)
    return s.select(key, score.alias("score"), (score > 0).cast("int").alias("predicted"))


def balanced_weights(rows: DataFrame, label: str = "label") -> dict[int, float]:
    """n / (2 n_class) per class."""
    n = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    total = sum(n.values())
    return {k: total / (len(n) * v) for k, v in n.items()}


def fit(rows: DataFrame, features: str, label: str, c: float = 1.0, rounds: int = 60, tolerance: float = 1e-6) -> tuple[np.ndarray, float]:
    """(weights, intercept) of min |w|^2 / 2 + C sum c_i max(0, 1 - y f(x))^2, the intercept regularised.

    Newton steps with backtracking: each step sums loss, gradient and the Hessian of the active rows in one
    pass over Arrow batches, added up on the workers in a tree. Sums have the square of the number of features; for
    many features there is ``fit_sparse``.
    """
    cost = balanced_weights(rows, label)
    data = rows.select(features, label).filter(F.col(features).isNotNull() & F.col(label).isin(0, 1))
    width = len(data.first()[0]) + 1

    def sums(w: np.ndarray, hessian: bool) -> np.ndarray:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(1 + width + (width * width if hessian else 0))
            for b in batches:
                if not len(b):
                    continue
                x = np.hstack([np.stack(b[features].to_numpy()), np.ones((len(b), 1))])
                y = np.where(b[label].to_numpy() == 1, 1.0, -1.0)
                k = np.where(y > 0, cost.get(1, 1.0), cost.get(0, 1.0)) * c
                gap = np.maximum(0, 1 - y * (x @ w))
                total[0] += (k * gap * gap).sum()
                total[1 : 1 + width] += x.T @ (-2 * k * gap * y)
                if hessian:
                    on = gap > 0
                    total[1 + width :] += (x[on].T @ (x[on] * (2 * k[on])[:, None])).ravel()
            yield pd.DataFrame({"s": [total.tobytes()]})

        return data.mapInPandas(run, "s binary").rdd.map(lambda r: np.frombuffer(bytes(r[0]))).treeReduce(np.add)

    w = np.zeros(width)
    for _ in range(rounds):
        s = sums(w, True)
        loss = s[0] + w @ w / 2
        gradient = s[1 : 1 + width] + w
        if np.abs(gradient).max() < tolerance * max(1.0, abs(loss)):
            break
        step = np.linalg.solve(s[1 + width :].reshape(width, width) + np.eye(width), gradient)
        size = 1.0
        while size > 1e-4:
            trial = w - size * step
            if sums(trial, False)[0] + trial @ trial / 2 <= loss - 1e-4 * size * (gradient @ step):
                break
            size /= 2
        w = w - size * step
    return w[:-1], float(w[-1])


def fit_sparse(rows: DataFrame, indices: str, values: str, label: str, width: int, c: float = 1.0, rounds: int = 200, tolerance: float = 1e-4, memory: int = 10) -> tuple[np.ndarray, float]:
    """As ``fit``, for rows of array columns ``indices`` (below ``width``) and ``values``.

    Limited-memory BFGS with backtracking: each step sums loss and gradient in one pass, added up on the
    workers in a tree; nothing is as large as the square of ``width``.
    """
    cost = balanced_weights(rows, label)
    data = written(rows.select(indices, values, label).filter(F.col(label).isin(0, 1)), "svm-rows")
    spark = rows.sparkSession

    def loss_at(w: np.ndarray) -> tuple[float, np.ndarray]:
        shared = spark.sparkContext.broadcast(w)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(width + 2)
            w = shared.value
            for b in batches:
                if not len(b):
                    continue
                row = np.repeat(np.arange(len(b)), b[indices].map(len).to_numpy())
                at, x = np.concatenate(b[indices].to_list()).astype(np.int64), np.concatenate(b[values].to_list()).astype(float)
                y = np.where(b[label].to_numpy() == 1, 1.0, -1.0)
                k = np.where(y > 0, cost.get(1, 1.0), cost.get(0, 1.0)) * c
                gap = np.maximum(0, 1 - y * (np.bincount(row, x * w[at], len(b)) + w[-1]))
                slope = -2 * k * gap * y
                total[0] += (k * gap * gap).sum()
                total[1:-1] += np.bincount(at, x * slope[row], width)
                total[-1] += slope.sum()
            yield pd.DataFrame({"s": [total.tobytes()]})

        s = data.mapInPandas(run, "s binary").rdd.map(lambda r: np.frombuffer(bytes(r[0]))).treeReduce(np.add)
        shared.unpersist()
        return float(s[0] + w @ w / 2), s[1:] + w

    w = np.zeros(width + 1)
    loss, gradient = loss_at(w)
    first = np.abs(gradient).max()
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        if np.abs(gradient).max() <= tolerance * max(first, 1e-12):
            break
        step, shares = gradient.copy(), []
        for s, y in reversed(past):
            shares.append((s @ step) / (s @ y))
            step -= shares[-1] * y
        step *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1 / max(1.0, float(np.linalg.norm(gradient)))
        for (s, y), a in zip(past, reversed(shares)):
            step += (a - (y @ step) / (s @ y)) * s
        size = 1.0
        while True:
            trial, trial_gradient = loss_at(w - size * step)
            if trial <= loss - 1e-4 * size * (gradient @ step) or size < 1e-6:
                break
            size /= 2
        moved, turned = -size * step, trial_gradient - gradient
        w, loss, gradient = w + moved, trial, trial_gradient
        if moved @ turned > 1e-12 * (turned @ turned):
            past = [*past, (moved, turned)][-memory:]
        if size < 1e-6:
            break
    return w[:-1], float(w[-1])
