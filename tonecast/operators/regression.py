"""Multinomial logistic regression of many rows, whose steps send the driver one compact sum."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from operator import add

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.linalg import DenseMatrix, DenseVector
from pyspark.ml.wrapper import JavaParams
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonecast.operators.features import entries
from tonecast.session import materialize

# cells of a block, and the most rows of a task
_BLOCK = 500_000
_TASK_ROWS = 25_000
# tasks that add up a step's sum, each a range of the features
_SLICES = 8
# steps kept to estimate curvature, and steps over which the objective is compared to tell convergence
_MEMORY, _WINDOW = 30, 10
_COLUMNS = {"starts": "int64", "indices": "int32", "values": "float64", "y": "int32", "w": "float64"}


def _packing():
    """Function for tasks; defined inside, so that workers need not import this package."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of Arrow batches as blocks: row starts, indices, values, classes and weights in one buffer each."""
        for batch in batches:
            cells, y, w = (batch.column(c) for c in ("entries", "_y", "_w"))
            ends = np.concatenate([[0], np.cumsum(np.diff(cells.offsets.to_numpy()))])
            flat = cells.flatten()
            index, value = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("index", "value"))
            y, w = (c.to_numpy(zero_copy_only=False) for c in (y, w))
            cuts = np.flatnonzero(np.diff(ends[:-1] // _BLOCK)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(y)]):
                a, b = ends[lo], ends[hi]
                block = ends[lo:hi + 1] - a, index[a:b], value[a:b], y[lo:hi], w[lo:hi]
                yield pa.RecordBatch.from_pydict({name: pa.array([part.astype(kind).tobytes()], pa.binary())
                                                  for (name, kind), part in zip(_COLUMNS.items(), block)})
    return pack


def _blocks(rows: DataFrame, total: int) -> RDD:
    """Blocks of numpy arrays, kept for all steps; lost ones are read again from the shared folder."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    tasks = max(-(-total // _TASK_ROWS), min(cores, -(-total // (_TASK_ROWS // 10))))
    dealt = rows.select("features", "_y", "_w").repartition(tasks).select(entries(F.col("features")).alias("entries"), "_y", "_w")
    packed = materialize(dealt.mapInArrow(_packing(), ", ".join(f"{c} binary" for c in _COLUMNS)), "instances")
    return (packed.rdd.map(lambda r: tuple(np.frombuffer(r[c], kind) for c, kind in _COLUMNS.items()))
            .persist(StorageLevel.MEMORY_AND_DISK))


def _added(parts: RDD) -> tuple[np.ndarray, np.ndarray]:
    """Sums over all tasks. Ranges of features are added by one task each and leave it in single precision."""
    found = dict(parts.reduceByKey(add, _SLICES).mapValues(lambda s: s.astype("float32") if s.ndim == 2 else s).collect())
    return np.concatenate([found[k] for k in range(_SLICES)], axis=1).astype("float64"), found[-1]


def _curvature(blocks: RDD, weights: np.ndarray, intercepts: np.ndarray) -> tuple[np.ndarray, float, float]:
    """Summed curvature of the loss by the coefficients of each feature and by the intercepts, means over the classes; sum of the weights."""
    sc = blocks.context
    sent = sc.broadcast((weights, intercepts))

    def part(own: Iterator[tuple]) -> Iterator[tuple[int, np.ndarray]]:
        coefficients, shifts = sent.value
        kinds, size = coefficients.shape
        sums, tail = np.zeros((1, size)), np.zeros(2)
        for starts, index, value, y, w in own:
            sizes = np.diff(starts)
            row = np.repeat(np.arange(len(y)), sizes)
            z = np.stack([np.bincount(row, coefficients[k][index] * value, len(y)) + shifts[k] for k in range(kinds)], axis=1)
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            bend = w * (p * (1 - p)).mean(axis=1)
            sums[0] += np.bincount(index, bend[row] * value * value, size)
            tail += bend.sum(), w.sum()
        yield from [(-1, tail), *enumerate(np.array_split(sums, _SLICES, axis=1))]
    sums, tail = _added(blocks.mapPartitions(part))
    sent.destroy()
    return sums[0], float(tail[0]), float(tail[1])


def _losses(blocks: RDD, weights: np.ndarray, intercepts: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Summed loss and its gradient by coefficients and intercepts.

    Both add up to zero over the classes, as do all their steps, so the last class is neither sent nor computed.
    """
    sc = blocks.context
    sent = sc.broadcast((weights[:-1], intercepts[:-1]))

    def part(own: Iterator[tuple]) -> Iterator[tuple[int, np.ndarray]]:
        coefficients, shifts = sent.value
        first, size = coefficients.shape
        sums, tail = np.zeros((first, size)), np.zeros(first + 1)
        for starts, index, value, y, w in own:
            sizes = np.diff(starts)
            filled = sizes > 0
            z = np.zeros((len(y), first + 1))
            for k in range(first):
                if len(index):
                    z[filled, k] = np.add.reduceat(coefficients[k][index] * value, starts[:-1][filled])
                z[:, k] += shifts[k]
            z[:, first] = -z[:, :first].sum(axis=1)
            z -= z.max(axis=1, keepdims=True)
            p = np.exp(z)
            total = p.sum(axis=1)
            tail[first] += (w * (np.log(total) - z[np.arange(len(y)), y])).sum()
            p /= total[:, None]
            p[np.arange(len(y)), y] -= 1
            p *= w[:, None]
            for k in range(first):
                sums[k] += np.bincount(index, np.repeat(p[:, k], sizes) * value, size)
                tail[k] += p[:, k].sum()
        yield from [(-1, tail), *enumerate(np.array_split(sums, _SLICES, axis=1))]

    sums, tail = _added(blocks.mapPartitions(part))
    sent.destroy()
    whole = lambda a: np.concatenate([a, -a.sum(axis=0, keepdims=True)])
    return float(tail[-1]), whole(sums), whole(tail[:-1])


def _direction(gradient: np.ndarray, kept: list[tuple[np.ndarray, np.ndarray]], curvature: np.ndarray) -> np.ndarray:
    """Quasi-Newton direction (L-BFGS) from the curvature along the axes, the last steps and their changes of the gradient."""
    q, shares = -gradient, []
    for step, change in reversed(kept):
        shares.append((step @ q) / (change @ step))
        q = q - shares[-1] * change
    if not kept:
        return q / curvature / max(1.0, np.sqrt(q @ (q / curvature)))
    step, change = kept[-1]
    q = q / curvature * ((step @ change) / (change @ (change / curvature)))
    for (step, change), share in zip(kept, reversed(shares)):
        q = q + step * (share - (change @ q) / (change @ step))
    return q


def _minimise(objective, bend, point: np.ndarray, max_iter: int, tolerance: float) -> tuple[np.ndarray, int]:
    """Minimum of a smooth convex function and the steps taken; as many as ``max_iter`` if it has not converged.

    ``bend`` gives the curvature along the axes. It is asked at the start and after 8, 16, 32 ... steps.
    """
    value, gradient = objective(point)
    curvature = bend(point)
    kept, values = [], [value]
    for done in range(max_iter):
        if done >= 8 and not done & (done - 1):
            curvature = bend(point)
        q = _direction(gradient, kept, curvature)
        slope, length, low, high = gradient @ q, 1.0, 0.0, None
        for _ in range(30):
            at, slant = objective(point + length * q)
            if at > value + 1e-4 * length * slope:
                high = length
            elif slant @ q < 0.9 * slope:
                low = length
            else:
                break
            length = 2 * length if high is None else (low + high) / 2
        else:
            # rounding hides what is left to gain: once more without the memory, then it is the minimum
            if not kept:
                return point, done
            kept = []
            continue
        kept = [*kept, (length * q, slant - gradient)][-_MEMORY:]
        point, value, gradient = point + length * q, at, slant
        values.append(value)
        if len(values) > _WINDOW and values[-1 - _WINDOW] - value <= tolerance * abs(value):
            return point, done + 1
    return point, max_iter


def fit(rows: DataFrame, kinds: int, size: int, total: int, penalty: float, max_iter: int,
        tolerance: float) -> tuple[LogisticRegressionModel, int]:
    """Model of ``total`` rows (features, class ``_y`` of ``kinds``, weight ``_w``) and the steps it took.

    Minimises the mean weighted loss plus ``penalty / 2`` times the squared coefficients, as ``LogisticRegression`` does
    without standardisation, from zero. A step sends the driver ``4 * (kinds - 1) * size`` bytes, whatever the number of
    rows and tasks.
    """
    blocks = _blocks(rows, total)

    def split(point: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return point[:-kinds].reshape(kinds, size), point[-kinds:]

    def bend(point: np.ndarray) -> np.ndarray:
        by_weight, by_intercept, weight = _curvature(blocks, *split(point))
        return np.concatenate([np.tile(penalty + by_weight / weight, kinds), np.full(kinds, max(by_intercept / weight, 1e-12))])

    weight = _curvature(blocks, *split(np.zeros(kinds * size + kinds)))[2]

    def objective(point: np.ndarray) -> tuple[float, np.ndarray]:
        weights, intercepts = split(point)
        loss, by_weight, by_intercept = _losses(blocks, weights, intercepts)
        gradient = np.concatenate([(by_weight / weight + penalty * weights).ravel(), by_intercept / weight])
        return loss / weight + penalty / 2 * (weights * weights).sum(), gradient

    point, steps = _minimise(objective, bend, np.zeros(kinds * size + kinds), max_iter, tolerance)
    blocks.unpersist()
    weights, intercepts = split(point)
    matrix, shifts = DenseMatrix(kinds, size, weights.ravel(order="F")), DenseVector(intercepts)
    java = JavaParams._new_java_obj("org.apache.spark.ml.classification.LogisticRegressionModel",
                                    f"regression_{uuid.uuid4().hex[:12]}", matrix, shifts, kinds, True)
    return LogisticRegressionModel(java), steps
