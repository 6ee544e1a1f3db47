"""Networks fitted over numpy matrices.

The trainer of Spark's multilayer perceptron runs a job for each evaluation of the loss, and a
fit evaluates it a thousand times. Where a job would take longer than what it computes, one task
fits alone here; else each evaluation is a stage over matrices that Spark keeps, spread over all
cores, and the driver takes the steps. Loss, first weights, blocks, steps and the end are those
of Spark's trainer.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

log = logging.getLogger(__name__)
#: Blocks of rows that are worth a task, rows that are kept as one matrix, and rows of one step.
LEAST_BLOCKS, KEPT_ROWS, STEP_ROWS = 8, 8192, 512
#: Rows times weights that one task fits alone: an evaluation takes about as long as the job that would spread it.
ALONE = 200_000_000
_PACKED = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("rows", pa.binary())])


class StepFailed(Exception):
    """No step along a direction lowers the loss enough."""


def _within(a: tuple, b: tuple) -> float:
    """The least point of the cubic through both ends (place, value, slope), kept off the ends."""
    with np.errstate(all="ignore"):
        d1 = a[2] + b[2] - 3 * np.float64(a[1] - b[1]) / (a[0] - b[0])
        d2 = np.sqrt(d1 * d1 - a[2] * b[2])
        t = float(b[0] - (b[0] - a[0]) * (b[2] + d2 - d1) / (b[2] - a[2] + 2 * d2))
    low, high = a[0] + 0.1 * (b[0] - a[0]), a[0] + 0.9 * (b[0] - a[0])
    return low if t < low else high if t > high else t


def _step(at: Callable[[float], tuple], first: float, tries: int = 10, c1: float = 1e-4, c2: float = 0.9) -> float:
    """A step under the strong Wolfe conditions, by Breeze's search; ``at``: place -> (place, value, slope)."""
    low = start = at(0.0)
    if start[2] > 0:
        raise StepFailed("the direction leads up")
    too_high = lambda c, least: c[1] > start[1] + c1 * c[0] * start[2] or c[1] >= least
    flat = lambda c: abs(c[2]) <= c2 * abs(start[2])

    def between(low, high):
        for _ in range(tries):
            c = at(_within(high, low) if low[0] > high[0] else _within(low, high))
            if too_high(c, low[1]):
                high = c
            elif flat(c):
                return c[0]
            else:
                if c[2] * (high[0] - low[0]) >= 0:
                    high = low
                low = c
        raise StepFailed("no step between two that bracket one")

    t = first
    for i in range(tries):
        c = at(t)
        if not math.isfinite(c[1]):
            t /= 2
            continue
        if too_high(c, low[1] if i else math.inf):
            return between(low, c)
        if flat(c):
            return t
        if c[2] >= 0:
            return between(c, low)
        low, t = c, t * 1.5
    raise StepFailed("the loss falls on and on")


def _direction(gradient: np.ndarray, steps: list, changes: list) -> np.ndarray:
    """Minus the gradient times what the last steps, newest first, tell of the inverse Hessian."""
    scale, out, seen = 1.0, gradient.copy(), []
    if steps:
        sy = steps[0] @ changes[0]
        if sy < 0 or math.isnan(sy):
            raise StepFailed("the slope fell along a step")
        scale = sy / (changes[0] @ changes[0])
    for s, y in zip(steps, changes):
        rho = s @ y
        a = (s @ out) / rho
        if math.isnan(a):
            raise StepFailed("a step of no length")
        out -= a * y
        seen.append((a, rho, s, y))
    out *= scale
    for a, rho, s, y in reversed(seen):
        out += (a - (y @ out) / rho) * s
    return -out


def minimise(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, most: int, tolerance: float, memory: int = 10, window: int = 20) -> tuple[np.ndarray, int]:
    """The point that L-BFGS reaches from ``x`` and its steps, as Breeze takes them and ends.

    It ends after ``most`` steps, or where the loss stays within ``tolerance`` of the first one over
    ``window`` steps, or the gradient is as small against the loss, or two searches fail in a row.
    """
    last: list = [None, None]

    def known(at):
        if last[0] is None or not np.array_equal(last[0], at):
            last[:] = at.copy(), loss(at)
        return last[1]

    value, gradient = known(x)
    first, seen, steps, changes, taken, failed = value, [math.inf], [], [], 0, False
    with np.errstate(all="ignore"):
        while taken < most and not (len(seen) > 1 and abs(value - max(seen)) <= tolerance * first) and not np.linalg.norm(gradient) <= max(tolerance * value, 1e-8):
            try:
                toward = _direction(gradient, steps, changes)

                def at(t, x=x, toward=toward):
                    v, g = known(x + t * toward)
                    return t, v, float(g @ toward)
                size = _step(at, 1.0 if taken else 1 / float(np.linalg.norm(toward)))
                if size * np.linalg.norm(gradient) < 1e-10:
                    raise StepFailed("a step too short")
            except StepFailed as reason:
                if failed:
                    break
                log.info("starting again without the last steps: %s", reason)
                failed, steps, changes = True, [], []
                continue
            new = x + size * toward
            v, g = known(new)
            steps, changes = [new - x, *steps][:memory], [g - gradient, *changes][:memory]
            x, value, gradient, taken, failed = new, v, g, taken + 1, False
            seen = [*seen, value][-window:]
    return x, taken


class Network:
    """A network of sigmoid layers under a softmax, with room for the outputs of a step."""

    def __init__(self, layers: Sequence[int]):
        self.layers = layers
        self.outputs, self.deltas, self.slopes = ([np.empty((STEP_ROWS, n)) for n in layers[1:]] for _ in range(3))

    def _parts(self, flat: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Views of each layer's weights and biases, in the order in which Spark keeps them."""
        out, at = [], 0
        for n, m in zip(self.layers, self.layers[1:]):
            out.append((flat[at:at + n * m].reshape(n, m), flat[at + n * m:at + n * m + m]))
            at += n * m + m
        return out

    def add(self, weights: np.ndarray, values: np.ndarray, label: np.ndarray, weight: np.ndarray, total: np.ndarray) -> None:
        """Add the gradient of the weighted rows to ``total``, and their loss to its last number."""
        layers, sums, top = self._parts(weights), self._parts(total), len(self.layers) - 2
        against = [(-w, -b) for w, b in layers[:-1]]
        with np.errstate(all="ignore"):
            for start in range(0, len(values), STEP_ROWS):
                x, said, weighs = values[start:start + STEP_ROWS], label[start:start + STEP_ROWS].astype(np.int64), weight[start:start + STEP_ROWS, None]
                n, below = len(x), x
                for i, (w, b) in enumerate([*against, layers[-1]]):
                    out = np.matmul(below, w, out=self.outputs[i][:n])
                    out += b
                    if i == top:
                        out -= out.max(axis=1, keepdims=True)
                        np.exp(out, out=out)
                        out /= out.sum(axis=1, keepdims=True)
                    else:
                        np.exp(out, out=out)
                        out += 1.0
                        np.reciprocal(out, out=out)
                    below = out
                target = np.zeros((n, self.layers[-1]))
                target[np.arange(n), said] = 1.0
                total[-1] -= (weighs * target * np.log(below)).sum()
                delta = np.subtract(below, target, out=self.deltas[top][:n])
                delta *= weighs
                for i in range(top, -1, -1):
                    under = self.outputs[i - 1][:n] if i else x
                    sums[i][0][...] += under.T @ delta
                    sums[i][1][...] += delta.sum(axis=0)
                    if i:
                        slope = np.subtract(1.0, under, out=self.slopes[i - 1][:n])
                        slope *= under
                        delta = np.matmul(delta, layers[i][0].T, out=self.deltas[i - 1][:n])
                        delta *= slope


def _packed(size: int, width: int):
    """The rows of a part in blocks of ``size``, as its trainer would stack them; each a matrix of values and class."""
    def run(batches: Iterator[pa.RecordBatch]):
        part, block, held = TaskContext.get().partitionId(), 0, np.empty((0, width + 1))

        def packed(full):
            nonlocal block, held
            found = []
            while len(held) >= size or (full and len(held)):
                found.append((part, block, held[:size].tobytes()))
                held, block = held[size:], block + 1
            return [pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), _PACKED)], schema=_PACKED)] if found else []

        for b in batches:
            rows = np.column_stack([b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width), b.column(1).to_numpy(zero_copy_only=False)])
            held = np.concatenate([held, rows])
            yield from packed(False)
        yield from packed(True)

    return run


def _matrices(width: int):
    """The blocks of a task in larger matrices of values, class and weight: each block weighs 1, be it short."""
    def run(blocks: Iterator):
        held, rows = [], 0
        for block in blocks:
            matrix = np.frombuffer(block["rows"]).reshape(-1, width + 1)
            held.append(np.column_stack([matrix, np.full(len(matrix), 1 / len(matrix))]))
            rows += len(matrix)
            if rows >= KEPT_ROWS:
                yield np.concatenate(held)
                held, rows = [], 0
        if held:
            yield np.concatenate(held)

    return run


def _summed(layers: Sequence[int], blocks: int):
    """For some weights: one row a task, the gradient and, behind it, the loss of its matrices."""
    def at(weights: np.ndarray):
        def run(matrices: Iterator[np.ndarray]):
            network, total = Network(layers), np.zeros(len(weights) + 1)
            for m in matrices:
                network.add(weights, m[:, :-2], m[:, -2], m[:, -1] / blocks, total)
            yield total

        return run

    return at


def _loss(totals: Iterator[np.ndarray]) -> tuple[float, np.ndarray]:
    total = sum(totals)
    return float(total[-1]), total[:-1]


def _alone(layers: Sequence[int], blocks: int, start: np.ndarray, most: int, tolerance: float):
    """The weights that one task finds, which holds all matrices."""
    def run(matrices: Iterator[np.ndarray]):
        held, over = list(matrices), _summed(layers, blocks)
        yield minimise(lambda weights: _loss(over(weights)(held)), start, most, tolerance)

    return run


class Perceptron(MultilayerPerceptronClassifier):
    """Spark's multilayer perceptron, with the passes of its ``l-bfgs`` solver over numpy matrices."""

    def _fit(self, dataset: DataFrame):
        if self.getSolver() != "l-bfgs" or not self.getMaxIter():
            return super()._fit(dataset)
        layers, cores = self.getLayers(), dataset.sparkSession.sparkContext.defaultParallelism
        rows = dataset.select(vector_to_array(self.getFeaturesCol()).alias("x"), F.col(self.getLabelCol()).cast("double").alias("y"))
        packed = rows.mapInArrow(_packed(self.getBlockSize(), layers[0]), "part int, block int, rows binary")
        blocks = packed.count()
        if not blocks:
            return super()._fit(dataset)
        start = super(Perceptron, self.copy({self.maxIter: 0}))._fit(dataset).weights.toArray()  # also checks the rows
        alone = blocks * self.getBlockSize() * len(start) <= ALONE
        # In order, so that reruns add up alike.
        spread = packed.repartition(1 if alone else max(1, min(cores, blocks // LEAST_BLOCKS))).sortWithinPartitions("part", "block")
        kept, over, ends = spread.rdd.mapPartitions(_matrices(layers[0])), _summed(layers, blocks), (self.getMaxIter(), self.getTol())
        if alone:
            weights, steps = kept.mapPartitions(_alone(layers, blocks, start, *ends)).first()
        else:
            kept.persist(StorageLevel.MEMORY_AND_DISK)
            try:
                weights, steps = minimise(lambda weights: _loss(kept.mapPartitions(over(weights)).collect()), start, *ends)
            finally:
                kept.unpersist()
        log.info("network fitted in %s steps", steps)
        return self._copyValues(super(Perceptron, self.copy({self.maxIter: 0, self.initialWeights: weights}))._fit(dataset))
