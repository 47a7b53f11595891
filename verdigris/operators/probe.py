"""Multinomial logistic regression on any number of rows: gradients summed by Spark, steps taken by the driver.

A step needs the loss and its gradient, numbers as many as the weights. Every task adds up those of its rows, Spark adds up
the tasks', and only the sum comes to the driver. Rows never do.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.operators import evaluation
from verdigris.operators.classifiers import softmax
from verdigris.operators.graphs import written

#: Steps at most, pairs that the search direction is built from, and the largest part of the gradient that ends the search.
STEPS, MEMORY, FLAT = 200, 10, 1e-9
#: Sums of tasks are added up in so many groups first.
GROUPS = 32
#: C of the penalty 1 / (2 C n) times the squared weights, as tried.
GRID = (1.0, 10.0, 100.0)

Objective = Callable[[np.ndarray], tuple[float, np.ndarray]]


def sums(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray]:
    """Summed cross entropy of rows x with classes y under weights w [classes, dim + 1], bias last, and its gradient."""
    x = np.hstack([x, np.ones((len(x), 1))])
    z = x @ w.T
    z -= z.max(1, keepdims=True)
    p = np.exp(z)
    total = p.sum(1)
    at = np.arange(len(y))
    loss = float((np.log(total) - z[at, y]).sum())
    p /= total[:, None]
    p[at, y] -= 1
    return loss, p.T @ x


def summed(rows: DataFrame, w: np.ndarray, parts: int | None = None) -> tuple[float, np.ndarray, int]:
    """sums() over all of rows (v, y), and their number. parts: the partitions of rows, if known; few go to the driver as they are."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, grad, n = 0.0, np.zeros_like(w), 0
        for b in batches:
            if b.num_rows:
                part, g = sums(np.stack(b.column("v").to_numpy(zero_copy_only=False)).astype(np.float64), b.column("y").to_numpy(), w)
                loss, grad, n = loss + part, grad + g, n + b.num_rows
        yield pa.RecordBatch.from_pydict({"loss": [loss], "n": [n], "grad": pa.array([grad.tobytes()], pa.binary())})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        grad = np.sum([np.frombuffer(g) for g in pdf["grad"]], axis=0)
        return pd.DataFrame({"loss": [pdf["loss"].sum()], "n": [pdf["n"].sum()], "grad": [grad.tobytes()]})

    own = rows.mapInArrow(each, "loss double, n bigint, grad binary")
    if parts is None or parts > GROUPS:
        own = own.withColumn("deal", F.spark_partition_id() % GROUPS).groupBy("deal").applyInPandas(add, "loss double, n bigint, grad binary")
    few = own.toPandas()
    return float(few["loss"].sum()), np.sum([np.frombuffer(g) for g in few["grad"]], axis=0).reshape(w.shape) if len(few) else np.zeros_like(w), int(few["n"].sum())


def minimum(objective: Objective, start: np.ndarray, steps: int = STEPS, flat: float = FLAT) -> np.ndarray:
    """Where a convex function (value and gradient) is least, by limited-memory quasi-Newton steps.

    The direction is the gradient times an estimate of the inverse curvature from the last steps. A step is halved until
    it lowers the value by a share of what the gradient promises; first steps are of length 1 at most.
    """
    w = start
    value, grad = objective(w)
    moves, turns = [], []
    for _ in range(steps):
        if np.abs(grad).max() <= flat:
            break
        d, kept = grad.copy(), []
        for s, t in zip(reversed(moves), reversed(turns)):
            a = (s * d).sum() / (s * t).sum()
            d -= a * t
            kept.append(a)
        d = d * ((moves[-1] * turns[-1]).sum() / (turns[-1] ** 2).sum() if moves else min(1.0, 1.0 / np.linalg.norm(grad)))
        for s, t, a in zip(moves, turns, reversed(kept)):
            d += (a - (t * d).sum() / (s * t).sum()) * s
        slope, size = -(grad * d).sum(), 1.0
        while True:
            new_value, new_grad = objective(w - size * d)
            if new_value <= value + 1e-4 * size * slope or size < 1e-10:
                break
            size /= 2
        if new_value > value:
            break
        step, turn = -size * d, new_grad - grad
        w, value, grad = w + step, new_value, new_grad
        if (step * turn).sum() > 1e-18:
            moves, turns = [*moves, step][-MEMORY:], [*turns, turn][-MEMORY:]
    return w


def penalised(total: Callable[[np.ndarray], tuple[float, np.ndarray, int]], c: float) -> Objective:
    """Mean loss and penalty from summed losses; the bias, the last column, has none."""

    def objective(w: np.ndarray) -> tuple[float, np.ndarray]:
        loss, grad, n = total(w)
        own = w.copy()
        own[:, -1] = 0.0
        return loss / n + (own * own).sum() / (2 * c * n), grad / n + own / (c * n)

    return objective


def labelled(df: DataFrame, vector: str, label: str) -> DataFrame:
    """v, y of the rows that have both."""
    return df.select(F.col(vector).alias("v"), F.col(label).cast("int").alias("y")).filter("v is not null and y is not null")


def fit(df: DataFrame, classes: int, c: float = 1.0, vector: str = "embedding", label: str = "label", start: np.ndarray | None = None, flat: float = FLAT) -> np.ndarray:
    """Weights [classes, dim + 1] of a probe fitted to all rows of df, labels 0 to classes - 1; bias last.

    Rows without a vector or label take no part. Without rows all weights are 0. Classes without rows get the least score.
    df is read once for each step: keep it in a table.
    """
    rows = labelled(df, vector, label)
    dim = rows.agg(F.max(F.size("v"))).first()[0]
    if dim is None:
        return np.zeros((classes, 1))
    parts = rows.rdd.getNumPartitions()
    return minimum(penalised(lambda w: summed(rows, w, parts), c), np.zeros((classes, dim + 1)) if start is None else start, flat=flat)


def predict(df: DataFrame, w: np.ndarray, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key, pred, conf of every row with a vector: the class of largest probability, and that; ties to the smaller class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.stack(b.column("v").to_numpy(zero_copy_only=False)).astype(np.float64)
                p = softmax(x @ w[:, :-1].T + w[:, -1])
                yield pa.RecordBatch.from_pydict({"id": b.column("id"), "pred": pa.array(p.argmax(1).astype(np.int32)), "conf": pa.array(p.max(1))})

    rows = df.select(F.col(key).alias("id"), F.col(vector).alias("v")).filter("v is not null")
    return rows.mapInArrow(run, f"id {df.schema[key].dataType.simpleString()}, pred int, conf double").withColumnRenamed("id", key)


def fit_tuned(df: DataFrame, tune: DataFrame, classes: int, grid: tuple[float, ...] = GRID, key: str = "vec_id", vector: str = "embedding", label: str = "label", flat: float = 1e-5) -> tuple[np.ndarray, float]:
    """fit() of the C in grid that has the best macro-F1 on tune, the first of equal ones, and that C. Each fit starts from the one before,
    and ends where no part of the gradient is above flat."""
    rows, held = written(df.select(key, vector, label), "probe"), written(tune.select(key, vector, label), "tune")
    best, w = None, None
    for c in grid:
        w = fit(rows, classes, c, vector, label, w, flat)
        cells = evaluation.confusion(predict(held, w, key, vector).join(held.select(key, label), key), classes, label)
        score = evaluation.summary(cells).first()["macro_f1"] or 0.0
        if best is None or score > best[0]:
            best = (score, w, c)
    return best[1], best[2]
