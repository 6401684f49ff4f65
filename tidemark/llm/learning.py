"""What the classifiers share: bounded training rows, logistic regression, standardising."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, held_out


def sample_ids(labels: DataFrame, label: str, most: int) -> DataFrame:
    """(id, label) of at most ``most`` labelled rows that are not held out, lowest hash first. A row
    without an id, label or with a held-out id is never used."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out())
    return usable.select(F.col("doc_id").cast("long").alias("id"), F.col(label).cast("int").alias("label")).orderBy(F.xxhash64("id"), "id", "label").limit(most)


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(label, text) of the sampled labelled rows. The ids, at most ``most``, are broadcast; no text
    is dealt out."""
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    return cut(texts.join(F.broadcast(sample_ids(labels, label, most)), "id").select("label", "text"))


class Scale:
    """Centre and spread of each feature, kept from being zero."""

    def __init__(self, x: np.ndarray):
        self.mean = x.mean(axis=0) if len(x) else np.zeros(x.shape[1])
        self.spread = np.maximum(x.std(axis=0), 1e-3) if len(x) else np.ones(x.shape[1])

    @classmethod
    def of(cls, mean: np.ndarray, spread: np.ndarray) -> Scale:
        """From figures that were found elsewhere."""
        made = cls(np.zeros((0, len(mean))))
        made.mean, made.spread = mean, np.maximum(spread, 1e-3)
        return made

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.spread, -8, 8)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights, the last one the constant, by Newton's method; one class only gives a constant."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    w[-1] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-3
    for _ in range(rounds):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w
