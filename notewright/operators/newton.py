"""Weighted, L2-regularised logistic models by Newton steps, one aggregate over the rows a step.

A step needs the loss, its gradient and its Hessian at the present coefficients. Tasks add them
up over their rows and leave one row a cell; the sums meet on the driver, where the system is
solved. A step that would raise the loss is halved. The fit ends when the expected gain of a
step is below a part in 10**12 of the loss, and is an error if that does not happen.

A model of many classes and entries has a Hessian of (classes * entries) squared; CELLS bounds it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.linalg import DenseMatrix, DenseVector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

# Sums that one task may leave behind: 16 MB.
CELLS = 1 << 20
_TOLERANCE = 1e-12
# Rows multiplied at once.
_ROWS = 4096


@dataclass(frozen=True)
class LinearModel:
    """Coefficients and intercepts, a row a class; two classes have one row, for the second."""

    weights: np.ndarray
    steps: int

    @property
    def coefficientMatrix(self) -> DenseMatrix:  # noqa: N802 - the name used by the models of Spark ML
        rows = self.weights[:, :-1]
        return DenseMatrix(*rows.shape, rows.ravel(order="F"))

    @property
    def coefficients(self) -> DenseVector:
        return DenseVector(self.weights[0, :-1])

    @property
    def intercept(self) -> float:
        return float(self.weights[0, -1])

    def probability(self, vector: Column) -> Column:
        """The probabilities of the classes in order, null where the vector is."""
        weights = self.weights

        @F.pandas_udf(ArrayType(DoubleType()))
        def score(vectors: pd.Series) -> pd.Series:
            known = vectors.notna().to_numpy()
            out = np.full(len(vectors), None, dtype=object)
            if known.any():
                rows = np.stack(vectors[known].to_numpy()).astype(np.float64)
                for at, row in zip(np.flatnonzero(known), _probabilities(np.hstack([rows, np.ones((len(rows), 1))]), weights)):
                    out[at] = row
            return pd.Series(out)

        return score(vector)


def cells(classes: int, entries: int) -> int:
    """Sums of a step: the blocks of the Hessian on and above its diagonal, the gradient and the loss."""
    rows, size = (1 if classes == 2 else classes), entries + 1
    return rows * (rows + 1) // 2 * size * size + rows * size + 1


def _probabilities(rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
    scores = rows @ weights.T
    if len(weights) == 1:
        scores = np.hstack([np.zeros((len(rows), 1)), scores])
    scores -= scores.max(axis=1, keepdims=True)
    parts = np.exp(scores)
    return parts / parts.sum(axis=1, keepdims=True)


def _sums(rows: np.ndarray, label: np.ndarray, share: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Loss, gradient and upper blocks of the Hessian over some rows."""
    every = _probabilities(rows, weights)
    loss = -(share * np.log(np.maximum(every[np.arange(len(rows)), label], 1e-300))).sum()
    first = every.shape[1] - len(weights)
    probability = every[:, first:]
    error = share[:, None] * (probability - (label[:, None] == np.arange(first, every.shape[1])))
    parts = [np.array([loss]), (error.T @ rows).ravel()]
    for a in range(len(weights)):
        for b in range(a, len(weights)):
            bend = share * probability[:, a] * ((a == b) - probability[:, b])
            parts.append((rows.T @ (rows * bend[:, None])).ravel())
    return np.concatenate(parts)


def _aggregate(table: DataFrame, weights: np.ndarray) -> np.ndarray:
    """``_sums`` over all rows of ``table`` (``features``, ``label``, ``weight``)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for start in range(0, batch.num_rows, _ROWS):
                part = batch.slice(start, _ROWS)
                rows = part.column(0).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                rows = np.hstack([rows, np.ones((len(rows), 1))])
                found = _sums(rows, part.column(1).to_numpy().astype(np.int64), part.column(2).to_numpy(), weights)
                total = found if total is None else total + found
        if total is not None:
            yield pa.record_batch([pa.array(np.arange(len(total))), pa.array(total)], names=["cell", "value"])

    found = table.mapInArrow(run, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(found.num_rows)
    out[found.column("cell").to_numpy()] = found.column("value").to_numpy()
    return out


def _penalised(sums: np.ndarray, weights: np.ndarray, penalty: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss, gradient and Hessian with the penalty: ``penalty / 2`` times the squared norm, intercepts free.

    With more than two classes equal shifts of all intercepts change nothing; their sum is held at zero.
    """
    classes, size = weights.shape
    norm = np.ones_like(weights)
    norm[:, -1] = 0
    loss = sums[0] + penalty / 2 * float((norm * weights ** 2).sum())
    gradient = sums[1:1 + classes * size].reshape(classes, size) + penalty * norm * weights
    hessian = np.zeros((classes, size, classes, size))
    at = 1 + classes * size
    for a in range(classes):
        for b in range(a, classes):
            block = sums[at:at + size * size].reshape(size, size)
            hessian[a, :, b, :], hessian[b, :, a, :] = block, block.T
            at += size * size
    if classes > 1:
        shift = weights[:, -1].sum()
        loss += penalty / 2 * shift ** 2
        gradient[:, -1] += penalty * shift
        hessian[:, -1, :, -1] += penalty
    hessian = hessian.reshape(classes * size, -1) + penalty * np.diag(norm.ravel())
    return loss, gradient.ravel(), hessian


def fit(table: DataFrame, classes: int, entries: int, penalty: float, max_steps: int) -> LinearModel:
    """The model of least penalised loss over ``table``: ``features`` (array), ``label`` (class number), ``weight``."""
    weights = np.zeros((1 if classes == 2 else classes, entries + 1))
    loss, gradient, hessian = _penalised(_aggregate(table, weights), weights, penalty)
    for step in range(1, max_steps + 1):
        move = np.linalg.solve(hessian + 1e-12 * np.trace(hessian) / len(hessian) * np.eye(len(hessian)), gradient)
        gain = float(gradient @ move)
        if gain <= _TOLERANCE * max(1.0, abs(loss)):
            # The last step is taken all the same: it doubles the right digits.
            return LinearModel(weights - move.reshape(weights.shape), step)
        for halvings in range(30):
            tried = weights - (move * 0.5 ** halvings).reshape(weights.shape)
            found = _penalised(_aggregate(table, tried), tried, penalty)
            if found[0] <= loss + 1e-12 * abs(loss):
                break
        else:
            raise ValueError("no step lowers the loss")
        weights, (loss, gradient, hessian) = tried, found
    raise ValueError(f"the fit did not settle in {max_steps} steps")
