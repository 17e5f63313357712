"""Bounded samples of labelled documents, and the small models fitted on them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """Documents with their 0/1 ``label``: at most ``per_class`` of each class, those of smallest hashed id.

    Labels that are null or neither 0 nor 1, and null ids, take no part; of
    repeated labels of one id the larger counts. The sample of ids is at most
    2 * per_class rows, so it is broadcast.
    """
    clean = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).alias("y"))
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    picked = clean.where("y = 0").orderBy(*order).limit(per_class).unionByName(clean.where("y = 1").orderBy(*order).limit(per_class))
    return docs.withColumn("doc_id", F.col("doc_id").cast("long")).join(F.broadcast(picked), "doc_id")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Weights of a ridge logistic regression (the last is the unpenalised intercept), by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    weight = np.ones(len(x)) if weight is None else weight
    penalty = np.append(np.full(x.shape[1] - 1, ridge), 1e-6)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (weight * (y - p)) - penalty * w)
        w += step * min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w


def logits(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


def held_out(ids: np.ndarray, every: int = 4) -> np.ndarray:
    """One row in ``every`` by hashed id."""
    from munjang.llm.kernels import U64, mix

    return mix(ids.astype(np.int64).view(U64)) % U64(every) == 0
