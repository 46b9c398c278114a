"""Small fits on bounded samples of labelled rows, and the samples themselves."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unit(*columns) -> Column:
    """A number in [0, 1) from a hash of the columns."""
    return F.pmod(F.xxhash64(*columns, F.lit(17)), F.lit(1 << 30)) / (1 << 30)


def labelled_sample(labels: DataFrame, label: str, bound: int) -> tuple[DataFrame, dict[int, int]]:
    """``doc_id, label`` of about ``bound`` labelled documents of each label, by hash of the id;
    and how many documents have each label.

    Rows without an id or label are left out; of several labels of a document the largest counts.
    """
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("label"))
    )
    share = F.lit(0.0)
    totals = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect() if r["label"] in (0, 1)}
    for value, n in totals.items():
        share = F.when(F.col("label") == value, min(1.0, bound / n)).otherwise(share)
    return known.where(unit("doc_id") < share), totals


def logistic(x: np.ndarray, y: np.ndarray, totals: dict[int, int], penalty: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights of a logistic fit by Newton steps, and its mean log-loss; the last column of x should be ones.

    Rows weigh so that the labels have the shares of ``totals``, whatever the sample's bound did.
    """
    n = np.array([max((y == 0).sum(), 1), max((y == 1).sum(), 1)])
    true = np.array([totals.get(0, 1), totals.get(1, 1)], float)
    weight = (true / true.sum() / n)[y.astype(int)] * len(y)
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + penalty * w
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + (penalty + 1e-9) * np.eye(len(w)), grad)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    p = np.clip(sigmoid(x @ w), 1e-9, 1 - 1e-9)
    return w, float(-(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).mean())


class Packed:
    """An array that travels compressed: tables of counts are mostly zeros."""

    def __init__(self, values: np.ndarray):
        self.values = values

    def __getstate__(self):
        return zlib.compress(np.ascontiguousarray(self.values).tobytes(), 1), self.values.dtype.str, self.values.shape

    def __setstate__(self, state):
        raw, kind, shape = state
        self.values = np.frombuffer(zlib.decompress(raw), kind).reshape(shape)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def dual_descent(
    rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, size: int, cost: float = 1.0, rounds: int = 12, seed: int = 7
) -> np.ndarray:
    """Weights (bias last) of a linear hinge-loss model by dual coordinate descent.

    rows are (indices, values); y is -1 or 1. Each label's cost is scaled to balance them.
    """
    w = np.zeros(size + 1)
    alpha = np.zeros(len(rows))
    n = np.array([(y < 0).sum(), (y > 0).sum()], float)
    limit = np.where(y > 0, cost * len(y) / (2 * max(n[1], 1)), cost * len(y) / (2 * max(n[0], 1)))
    norms = np.array([float(v @ v) + 1.0 for _, v in rows])
    order = np.arange(len(rows))
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        rng.shuffle(order)
        moved = 0.0
        for i in order.tolist():
            idx, v = rows[i]
            gap = y[i] * (float(w[idx] @ v) + w[size]) - 1
            new = min(max(alpha[i] - gap / norms[i], 0.0), limit[i])
            delta = new - alpha[i]
            if delta:
                alpha[i] = new
                w[idx] += delta * y[i] * v
                w[size] += delta * y[i]
                moved = max(moved, abs(delta))
        if moved < 1e-4:
            break
    return w
