"""Mergeable moments and quantile sketches of number columns, as tasks run them.

Only numpy and Arrow are imported here, so that workers start fast.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

#: Values of one weight that a sketch holds before it halves them.
SKETCH = 1024
#: A wanted rank is looked for so far around its place in the sketch, as a share of all rows.
AROUND = 4 / SKETCH


class Sketch:
    """Values with weights 1, 2, 4, …; a full level is sorted and every other value moves up.

    Halving starts at the first and the second value in turn, so that its errors even out.
    """

    def __init__(self):
        self.levels: list[np.ndarray] = []
        self.turn = 0

    def add(self, values: np.ndarray, level: int = 0) -> None:
        while len(self.levels) <= level:
            self.levels.append(np.zeros(0))
        held = np.concatenate([self.levels[level], values])
        if len(held) >= 2 * SKETCH:
            held = np.sort(held)
            even = len(held) & ~1
            self.turn ^= 1
            up, held = held[self.turn : even : 2], held[even:]
            self.levels[level] = held
            self.add(up, level + 1)
        else:
            self.levels[level] = held

    def merge(self, other: Sketch) -> None:
        for level, values in enumerate(other.levels):
            self.add(values, level)

    def around(self, ranks: Sequence[int], n: int) -> list[tuple[float, float]]:
        """For each 1-based rank of ``n``, values between which it lies."""
        values = np.concatenate(self.levels)
        order = np.argsort(values, kind="stable")
        upto = np.cumsum(np.repeat([2.0**i for i in range(len(self.levels))], [len(v) for v in self.levels])[order])
        values = values[order]
        slack = 0 if len(self.levels) == 1 else n * AROUND  # one level holds all values
        out = []
        for rank in ranks:
            low, high = np.searchsorted(upto, [rank - slack, rank + slack])
            out.append((float(values[low]) if rank - slack > 1 else -math.inf, float(values[high]) if high < len(values) else math.inf))
        return out


@dataclass
class Summary:
    """Of ``k`` columns: counts, extremes, central moments, sketches; of pairs, over the rows where both are there: counts, means, co-moments."""

    k: int
    paired: bool
    sketched: bool = True
    n: np.ndarray = field(init=False)
    total: np.ndarray = field(init=False)  # plain sums: exact for whole numbers
    low: np.ndarray = field(init=False)
    high: np.ndarray = field(init=False)
    mean: np.ndarray = field(init=False)
    m2: np.ndarray = field(init=False)
    m3: np.ndarray = field(init=False)
    m4: np.ndarray = field(init=False)
    sketches: list[Sketch] = field(init=False)
    pairs: np.ndarray | None = field(init=False)  # n, mean of the first, its squares, products

    def __post_init__(self):
        self.n, self.total, self.mean, self.m2, self.m3, self.m4 = (np.zeros(self.k) for _ in range(6))
        self.low, self.high = np.full(self.k, np.inf), np.full(self.k, -np.inf)
        self.sketches = [Sketch() for _ in range(self.k)]
        self.pairs = np.zeros((4, self.k, self.k)) if self.paired else None

    @classmethod
    def of(cls, x: np.ndarray, paired: bool, sketched: bool) -> Summary:
        """Of the rows of one batch; NaN stands for a missing value."""
        s = cls(x.shape[1], paired, sketched)
        here = np.isfinite(x)
        s.n = here.sum(0).astype(float)
        some = np.maximum(s.n, 1)
        s.total = np.where(here, x, 0.0).sum(0)
        s.mean = s.total / some
        apart = np.where(here, x - s.mean, 0.0)
        s.m2, s.m3, s.m4 = (apart**2).sum(0), (apart**3).sum(0), (apart**4).sum(0)
        s.low, s.high = np.where(here, x, np.inf).min(0, initial=np.inf), np.where(here, x, -np.inf).max(0, initial=-np.inf)
        for i in range(s.k if sketched else 0):
            s.sketches[i].add(x[here[:, i], i])
        if paired:
            both = here.astype(float)
            n = both.T @ both
            sums, over = apart.T @ both, np.maximum(n, 1)
            s.pairs = np.stack([n, s.mean[:, None] + sums / over, (apart**2).T @ both - sums**2 / over, apart.T @ apart - sums * sums.T / over])
        return s

    def merge(self, o: Summary) -> None:
        n = np.maximum(self.n + o.n, 1)
        d = np.where((self.n > 0) & (o.n > 0), o.mean - self.mean, 0.0)
        a, b = self.n, o.n
        self.m4 = (self.m4 + o.m4 + d**4 * a * b * (a * a - a * b + b * b) / n**3
                   + 6 * d**2 * (a * a * o.m2 + b * b * self.m2) / n**2 + 4 * d * (a * o.m3 - b * self.m3) / n)
        self.m3 = self.m3 + o.m3 + d**3 * a * b * (a - b) / n**2 + 3 * d * (a * o.m2 - b * self.m2) / n
        self.m2 = self.m2 + o.m2 + d**2 * a * b / n
        self.mean = np.where(a > 0, self.mean + d * b / n, o.mean)
        self.total = self.total + o.total
        self.n, self.low, self.high = a + b, np.minimum(self.low, o.low), np.maximum(self.high, o.high)
        for mine, theirs in zip(self.sketches, o.sketches):
            mine.merge(theirs)
        if self.pairs is not None:
            (pa_, ma, xa, ca), (pb, mb, xb, cb) = self.pairs, o.pairs
            total = np.maximum(pa_ + pb, 1)
            d = np.where((pa_ > 0) & (pb > 0), mb - ma, 0.0)
            self.pairs = np.stack([pa_ + pb, np.where(pa_ > 0, ma + d * pb / total, mb), xa + xb + d**2 * pa_ * pb / total, ca + cb + d * d.T * pa_ * pb / total])

    def skewness(self, i: int) -> float | None:
        """Bias-corrected; none below three values or on a constant."""
        n, m2 = self.n[i], self.m2[i]
        if n < 3 or self.low[i] == self.high[i]:
            return None
        return float(math.sqrt(n) * self.m3[i] / m2**1.5 * math.sqrt(n * (n - 1)) / (n - 2))

    def kurtosis(self, i: int) -> float | None:
        """Bias-corrected excess; none below four values or on a constant."""
        n, m2 = self.n[i], self.m2[i]
        if n < 4 or self.low[i] == self.high[i]:
            return None
        return float(((n + 1) * (n * self.m4[i] / m2**2 - 3) + 6) * (n - 1) / ((n - 2) * (n - 3)))

    def correlation(self, i: int, j: int) -> float | None:
        """Pearson; none if either column is constant where both are there: then only rounding is left of its squares."""
        n, x, y = self.pairs[0, i, j], self.pairs[2, i, j], self.pairs[2, j, i]
        for squares, c in ((x, i), (y, j)):
            if n == 0 or squares <= n * max(abs(self.low[c]), abs(self.high[c])) ** 2 * 1e-28:
                return None
        return float(self.pairs[3, i, j] / math.sqrt(x) / math.sqrt(y))


def matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype("float64")


def folded(table: int, k: int, paired: bool, sketched: bool):
    """One partial summary a task, under the number of its table."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Summary(k, paired, sketched)
        for batch in batches:
            if batch.num_rows:
                total.merge(Summary.of(matrix(batch), paired, sketched))
        yield pa.RecordBatch.from_arrays([pa.array([table], pa.int32()), pa.array([pickle.dumps(total)], pa.binary())], names=["table", "part"])

    return run


def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partials of one table made one as they stream in."""
    totals: dict[int, Summary] = {}
    for batch in batches:
        for table, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            part = pickle.loads(value)
            if table in totals:
                totals[table].merge(part)
            else:
                totals[table] = part
    for table, total in totals.items():
        yield pa.RecordBatch.from_arrays([pa.array([table], pa.int32()), pa.array([pickle.dumps(total)], pa.binary())], names=["table", "part"])


def inside(ranges: Sequence[tuple[int, float, float]], first: int = 0):
    """(slot, value, cnt): rows of each range by value, and under a null value those below it; slots count from ``first``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        below = np.zeros(len(ranges), np.int64)
        held: list[list[np.ndarray]] = [[] for _ in ranges]
        size = 0

        def told(slots: Sequence[int]) -> Iterator[pa.RecordBatch]:
            for slot in slots:
                if held[slot]:
                    values, counts = np.unique(np.concatenate(held[slot]), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), first + slot, np.int32)), pa.array(values), pa.array(counts.astype(np.int64))], names=["slot", "value", "cnt"])
                    held[slot] = []

        for batch in batches:
            x = matrix(batch)
            for slot, (column, low, high) in enumerate(ranges):
                values = x[:, column]
                below[slot] += int((values < low).sum())
                part = values[(values >= low) & (values <= high) & np.isfinite(values)]
                if len(part):
                    held[slot].append(part + 0.0)  # -0.0 equals 0.0
                    size += len(part)
            if size > 1 << 20:
                yield from told(range(len(ranges)))
                size = 0
        yield from told(range(len(ranges)))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + len(ranges)), pa.int32()), pa.nulls(len(ranges), pa.float64()), pa.array(below)], names=["slot", "value", "cnt"])

    return run
