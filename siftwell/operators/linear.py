"""A logistic regression with an absolute penalty, by proximal Newton steps: tens of passes over its rows, not thousands.

A step's quadratic model has the exact second derivatives, which every task adds up for its rows; its minimum under the penalty is
found on the driver by coordinates, and one more pass has the objective at all halved steps.  The objective is Spark's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from siftwell.session import materialise

BLOCK = 4096
"""Rows that are packed into one row of a table."""
STEPS = 0.5 ** np.arange(12)
SUM_BYTES = 64 << 20
"""Bytes of all tasks' second derivatives that the driver may add up."""


def fits_driver(rows: int, width: int, piece: int) -> bool:
    pieces = max(1, -(-rows * 8 * width // piece))
    return pieces * (width + 2) ** 2 * 8 <= SUM_BYTES


def _packed(fit: DataFrame) -> DataFrame:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, len(whole), BLOCK):
                batch = whole.slice(start, BLOCK)
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
                columns = [x, *(batch.column(c).to_numpy(zero_copy_only=False) for c in (1, 2))]
                yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(c, "float64").tobytes()], pa.binary()) for c in columns], names=["x", "y", "w"])

    rows = fit.select(vector_to_array("features"), F.col("label").cast("double"), F.col("weight").cast("double"))
    return materialise(rows.mapInArrow(pack, "x binary, y binary, w binary"), "packed")


def _summed(packed: DataFrame, each) -> np.ndarray:
    """The sum over all rows of the array that ``each`` gives for a block (x with a column of ones, y, w)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for k in range(len(batch)):
                x, y, w = (np.frombuffer(batch.column(c)[k].as_buffer(), "float64") for c in ("x", "y", "w"))
                found = each(np.hstack((x.reshape(len(y), -1), np.ones((len(y), 1)))), y, w)
                total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["s"])

    return sum(np.frombuffer(r.s, "float64") for r in packed.mapInArrow(run, "s binary").collect())  # one row per task


def _inner(gradient: np.ndarray, second: np.ndarray, at: np.ndarray, l1: np.ndarray, l2: np.ndarray) -> np.ndarray:
    """The minimum of the quadratic model with the penalties, by coordinates."""
    step, moved = np.zeros(len(at)), np.zeros(len(at))  # moved: second @ step
    for _ in range(500):
        largest = 0.0
        for j in range(len(at)):
            curve = second[j, j] + l2[j]
            old = at[j] + step[j]
            aim = curve * old - (gradient[j] + moved[j] + l2[j] * old)
            new = np.sign(aim) * max(abs(aim) - l1[j], 0.0) / curve
            if new != old:
                step[j] += new - old
                moved += second[j] * (new - old)
                largest = max(largest, curve * (new - old) ** 2)
        if largest < 1e-14:
            break
    return step


def fit_logistic(fit: DataFrame, penalty: float, share: float, most: int = 100, tolerance: float = 1e-8) -> tuple[np.ndarray, float]:
    """Coefficients and intercept that minimise the weighted mean loss + penalty (share |b| + (1 - share) b^2 / 2) over rows (label, weight, features)."""
    packed = _packed(fit)
    sums = _summed(packed, lambda x, y, w: np.append(w @ x, w @ y))
    width, total, ones = len(sums) - 2, sums[-2], sums[-1]
    free = np.append(np.ones(width), 0.0)
    l1, l2 = penalty * share * free, penalty * (1 - share) * free
    at = np.zeros(width + 1)
    if not 0 < ones < total:
        return at[:-1], float("inf") if ones else float("-inf")
    at[-1] = np.log(ones / (total - ones))

    def penalties(b):
        return (l1 * np.abs(b)).sum() + (l2 * b * b).sum() / 2

    def slopes(x, y, w, at=None):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -700, 700)))
        return np.concatenate(((w * (p - y)) @ x, (x.T @ (x * (w * p * (1 - p))[:, None])).ravel()))

    for _ in range(most):
        here = at.copy()
        found = _summed(packed, lambda x, y, w: slopes(x, y, w, here)) / total
        gradient, second = found[: width + 1], found[width + 1 :].reshape(width + 1, -1)
        step = _inner(gradient, second + np.eye(width + 1) * 1e-12, at, l1, l2)

        def losses(x, y, w):
            margin, more = x @ here, x @ step
            return np.array([w @ (np.logaddexp(0, m := margin + t * more) - y * m) for t in (0.0, *STEPS)])

        value = _summed(packed, losses) / total + [penalties(at + t * step) for t in (0.0, *STEPS)]
        best = value.argmin()
        if not best:
            break
        at = at + STEPS[best - 1] * step
        if value[0] - value[best] < tolerance * max(abs(value[best]), 1e-12):
            break
    return at[:-1], float(at[-1])
