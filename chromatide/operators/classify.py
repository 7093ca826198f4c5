"""A fitted classifier over vectors: multinomial logistic regression, its sums made in tasks.

The loss ``mean(-log softmax(W x)[y]) + l2 / 2 * |W|^2`` (an intercept is part of
x and of the penalty) is strictly convex, so its minimum does not depend on the
layout of the rows. Each pass adds up one gradient in each task; sums by position bring classes x dims numbers to the driver, which holds
nothing else. Steps are L-BFGS steps started from the fixed curvature bound
``(X'X / 2n + l2)``; a step that does not lower the loss is replaced by the
bound's own step, which always does.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from chromatide.operators.common import materialize

#: Most parameters (classes x dims, and dims x dims) that a model may have.
MAX_PARAMETERS = 1 << 22
MEMORY = 8


@dataclass
class SoftmaxModel:
    """Classes in ascending order, weights (classes x (dims + 1), intercept last) and the loss after each pass."""
    classes: list
    weights: np.ndarray
    losses: list[float]


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equally long lists as a matrix with a column of ones at its end."""
    x = np.asarray(column.flatten(), np.float64).reshape(len(column), -1)
    return np.hstack([x, np.ones((len(x), 1))])


def _summed(rows: DataFrame, part, size: int) -> np.ndarray:
    """Sum over all batches of ``part(batch)``, a vector of ``size`` numbers: one partial vector for each task."""
    def partial(batches):
        total = np.zeros(size)
        for b in batches:
            total += part(b)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], ["at", "v"])
    sums = rows.mapInArrow(partial, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros(size)
    out[sums["at"].to_numpy()] = sums["v"].to_numpy()
    return out


def _softmax(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    top = z.max(axis=1, keepdims=True)
    e = np.exp(z - top)
    total = e.sum(axis=1, keepdims=True)
    return e / total, (top + np.log(total))[:, 0]


def loss_and_gradient(rows: DataFrame, weights: np.ndarray, n: int, l2: float) -> tuple[float, np.ndarray]:
    """Loss and gradient at ``weights`` over ``rows`` (y = class number, x = vector)."""
    sent = rows.sparkSession.sparkContext.broadcast(weights)

    def part(batch):
        if not batch.num_rows:
            return 0.0
        w, x, y = sent.value, _matrix(batch.column("x")), np.asarray(batch.column("y"))
        z = x @ w.T
        p, log_total = _softmax(z)
        at = np.arange(len(y))
        loss = (log_total - z[at, y]).sum()
        p[at, y] -= 1
        return np.append((p.T @ x).ravel(), loss)
    sums = _summed(rows, part, weights.size + 1)
    sent.unpersist()
    loss = sums[-1] / n + l2 / 2 * float((weights ** 2).sum())
    return loss, sums[:-1].reshape(weights.shape) / n + l2 * weights


def usable_rows(df: DataFrame, label: str, vec: str) -> tuple[list, DataFrame, int]:
    """Classes, rows (y, x) and dims. Rows with a null label, a null, short or empty vector or a null or non-finite part are left out."""
    x = df.select(F.col(label).alias("label"), F.col(vec).cast("array<double>").alias("x"))
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    x = x.where(F.col("label").isNotNull() & (F.size("x") > 0) & finite)
    dims = x.agg(F.max(F.size("x"))).first()[0] or 0
    x = x.where(F.size("x") == dims)
    most = MAX_PARAMETERS // (dims + 1)
    classes = sorted(r[0] for r in x.select("label").distinct().limit(most + 1).collect())
    if len(classes) > most or (dims + 1) ** 2 > MAX_PARAMETERS:
        raise ValueError("the model would have too many parameters")
    known = df.sparkSession.createDataFrame([(c, i) for i, c in enumerate(classes)], x.select("label").schema.add("y", IntegerType()))
    return classes, x.join(F.broadcast(known), "label").select("y", "x"), dims


def fit_softmax(df: DataFrame, label: str, vec: str, l2: float = 1e-3, tol: float = 1e-5, passes: int = 60) -> SoftmaxModel:
    """M12 fit: weights whose gradient has no part above ``tol`` (or the last after ``passes``); no rows give no classes."""
    classes, rows, dims = usable_rows(df, label, vec)
    shape = (len(classes), dims + 1)
    if not classes:
        return SoftmaxModel([], np.zeros(shape), [])
    rows = materialize(rows)
    n = rows.count()

    def square(batch):
        if not batch.num_rows:
            return 0.0
        x = _matrix(batch.column("x"))
        return (x.T @ x).ravel()
    bound = _summed(rows, square, (dims + 1) ** 2).reshape(dims + 1, dims + 1) / (2 * n) + l2 * np.eye(dims + 1)
    lower = np.linalg.inv(bound)

    w = np.zeros(shape)
    loss, grad = loss_and_gradient(rows, w, n, l2)
    losses, memory = [loss], []
    while np.abs(grad).max() > tol and len(losses) < passes:
        direction = _two_loop(grad, memory, lower)
        step = w - direction
        new_loss, new_grad = loss_and_gradient(rows, step, n, l2)
        if new_loss > loss and memory:
            memory, step = [], w - grad @ lower
            new_loss, new_grad = loss_and_gradient(rows, step, n, l2)
        moved, turned = step - w, new_grad - grad
        if (moved * turned).sum() > 0:
            memory = [*memory[1 - MEMORY:], (moved, turned)]
        w, loss, grad = step, new_loss, new_grad
        losses.append(loss)
    return SoftmaxModel(classes, w, losses)


def _two_loop(grad: np.ndarray, memory: list, lower: np.ndarray) -> np.ndarray:
    """L-BFGS direction from the kept (move, change of gradient) pairs over the curvature bound, scaled to the last pair."""
    q, shares = grad.copy(), []
    for moved, turned in reversed(memory):
        a = (moved * q).sum() / (moved * turned).sum()
        q -= a * turned
        shares.append(a)
    q = q @ lower
    if memory:
        moved, turned = memory[-1]
        q *= (moved * turned).sum() / (turned * (turned @ lower)).sum()
    for (moved, turned), a in zip(memory, reversed(shares)):
        q += (a - (turned * q).sum() / (moved * turned).sum()) * moved
    return q


def score_softmax(df: DataFrame, model: SoftmaxModel, vec: str, pred: str = "pred", score: str = "p_max") -> DataFrame:
    """M12 score: add the likeliest class (ties to the smaller) and its probability; null for a vector the model cannot take.

    Columns of those two names are replaced, others pass through.
    """
    sent = df.sparkSession.sparkContext.broadcast(model.weights)
    dims = model.weights.shape[1] - 1

    @F.pandas_udf("at int, p double")
    def judge(vectors: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame({"at": pd.array([None] * len(vectors), "Int32"), "p": np.full(len(vectors), np.nan)})
        good = np.array([v is not None and len(v) == dims and len(sent.value) > 0
                         and bool(np.isfinite(np.asarray(v, np.float64)).all()) for v in vectors], bool)
        if good.any():
            x = np.stack([np.asarray(v, np.float64) for v in vectors[good]])
            p, _ = _softmax(x @ sent.value[:, :-1].T + sent.value[:, -1])
            out.loc[good, "at"] = p.argmax(axis=1)
            out.loc[good, "p"] = p.max(axis=1)
        return out

    free = "_j"
    while free in {c.lower() for c in df.columns}:
        free += "_"
    names = F.array(*[F.lit(c) for c in model.classes]) if model.classes else F.array().cast("array<string>")
    judged = df.withColumn(free, judge(F.col(vec).cast("array<double>")))
    out = judged.withColumn(pred, F.get(names, F.col(free)["at"])).withColumn(score, F.when(F.col(free)["at"].isNotNull(), F.col(free)["p"]))
    return out.drop(free)
