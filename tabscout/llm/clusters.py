"""k-means on integer vectors by Shallot search, one pass over blocks of vectors a round.

Each vector keeps its nearest and second-nearest centroid with an upper bound of the first
distance and a lower bound of every other. Bounds move with the centroids. Only where they
no longer decide, the vector is looked at: both remembered centroids are measured, the
closer one is the middle of the search, and its neighbours are met in order of distance
while they can still come before the second best found so far. What is met is compared as
exact integers, so that ties go to the smaller number.

Blocks hold their vectors' state and are cached between rounds. Their lineage has no
shuffle, so that a lost executor's blocks are made again from the input; after
``CUT_AFTER`` rounds it is cut by a written table. The driver gets one number a centroid and
component each round.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.storagelevel import StorageLevel

from tabscout.llm.common import stored
from tabscout.llm.vectors import int_rows, scaled

#: Rounds after which the blocks are written and read again.
CUT_AFTER = 20
#: Relative error that bounds allow for.
SLACK = 1e-9
BLOCKS = "ids binary, no_id binary, codes binary, nearest binary, second binary, upper binary, lower binary, sums binary"


def most(dimension: int) -> int:
    """Larger scaled components make a vector unusable: squared distances stay within 2 ** 62 (64 components: 2 ** 27)."""
    return min(math.isqrt(2**60 // max(dimension, 1)), 2**30)


def _squared(codes: np.ndarray, centroids: np.ndarray, which: np.ndarray) -> np.ndarray:
    apart = codes - centroids[which]
    return np.einsum("ij,ij->i", apart, apart)


def shallot(codes: np.ndarray, centroids: np.ndarray, nearest: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, ...]:
    """Nearest and second-nearest centroid of each row and both squared distances, from a first guess of the two."""
    k = len(centroids)
    a, b = nearest.copy(), second.copy()
    da, db = _squared(codes, centroids, a), _squared(codes, centroids, b)
    swap = (db < da) | (db == da) & (b < a)
    a[swap], b[swap], da[swap], db[swap] = b[swap], a[swap], db[swap], da[swap]
    apart = np.sqrt(((centroids[:, None] - centroids[None]).astype(np.float64) ** 2).sum(2))
    order = np.argsort(apart, axis=1, kind="stable")
    middle, guess, reach = a.copy(), b.copy(), np.sqrt(da.astype(np.float64))  # of the search: where it starts
    for m in np.unique(middle).tolist():
        live = np.flatnonzero(middle == m)
        for c in order[m].tolist():
            # The ball around the middle shrinks as better second ones are found.
            live = live[apart[m, c] <= (reach[live] + np.sqrt(db[live].astype(np.float64))) * (1 + SLACK)]
            if len(live) == 0:
                break
            if c == m:
                continue
            met = live[guess[live] != c]
            d = _squared(codes[met], centroids, np.full(len(met), c))
            first = (d < da[met]) | (d == da[met]) & (c < a[met])
            at = met[first]
            b[at], db[at] = a[at], da[at]
            a[at], da[at] = c, d[first]
            next_ = ~first & ((d < db[met]) | (d == db[met]) & (c < b[met]))
            b[met[next_]], db[met[next_]] = c, d[next_]
    return a, b, da, db


class Round:
    """What a task needs for one assignment: the centroids, and how far each came since the last one."""

    def __init__(self, centroids: np.ndarray, before: np.ndarray | None):
        self.centroids = centroids
        if before is None:
            self.moved = None
        else:
            self.moved = np.sqrt(((centroids - before).astype(np.float64) ** 2).sum(1)) * (1 + SLACK)
        apart = np.sqrt(((centroids[:, None] - centroids[None]).astype(np.float64) ** 2).sum(2))
        np.fill_diagonal(apart, np.inf)
        self.half = apart.min(1) / 2 * (1 - SLACK) if len(centroids) > 1 else np.full(1, np.inf)

    def assign(self, codes: np.ndarray, state: tuple[np.ndarray, ...] | None) -> tuple[np.ndarray, ...]:
        """nearest, second, upper, lower of each row."""
        n, k = len(codes), len(self.centroids)
        if k == 1:
            return np.zeros(n, np.int32), np.zeros(n, np.int32), np.zeros(n), np.full(n, np.inf)
        if state is None or self.moved is None:
            a, b, upper, lower = np.zeros(n, np.int32), np.ones(n, np.int32), np.full(n, np.inf), np.zeros(n)
        else:
            a, b, upper, lower = (s.copy() for s in state)
            far = np.argsort(-self.moved, kind="stable")
            others = np.where(a == far[0], self.moved[far[1]], self.moved[far[0]])  # the farthest move of any other centroid
            upper, lower = upper + self.moved[a], np.maximum(lower - others, 0) * (1 - SLACK)
        open_ = np.flatnonzero(upper >= np.maximum(lower, self.half[a]))
        if state is not None and len(open_):
            # Measured anew, the upper bound may decide after all.
            upper[open_] = np.sqrt(_squared(codes[open_], self.centroids, a[open_]).astype(np.float64)) * (1 + SLACK)
            open_ = open_[upper[open_] >= np.maximum(lower[open_], self.half[a[open_]])]
        if len(open_):
            na, nb, da, db = shallot(codes[open_], self.centroids, a[open_], b[open_])
            a[open_], b[open_] = na, nb
            upper[open_], lower[open_] = np.sqrt(da.astype(np.float64)) * (1 + SLACK), np.sqrt(db.astype(np.float64)) * (1 - SLACK)
        return a, b, upper, lower


def _blocks(scale: int, dimension: int):
    """Usable vectors of each batch as blocks without state."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in int_rows(batches):
            kept, codes = scaled(batch.column(1), scale, most).get(dimension, (None, None))
            if kept is not None:
                ids = batch.column(0).take(pa.array(kept))
                values = [ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), np.asarray(ids.is_null()).astype(np.int8), codes.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([*[pa.array([v.tobytes()], pa.binary()) for v in values], *[pa.nulls(1, pa.binary())] * 5],
                                                 names=["ids", "no_id", "codes", "nearest", "second", "upper", "lower", "sums"])

    return run


def _step(now: Round, dimension: int):
    """Blocks with their state after an assignment, and each block's sums: by centroid, the count and the components."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(now.centroids)
        for batch in batches:
            for row in batch.to_pylist():
                codes = np.frombuffer(row["codes"], np.int32).reshape(-1, dimension).astype(np.int64)
                state = None
                if row["nearest"] is not None:
                    state = tuple(np.frombuffer(row[c], t) for c, t in (("nearest", np.int32), ("second", np.int32), ("upper", np.float64), ("lower", np.float64)))
                a, b, upper, lower = now.assign(codes, state)
                sums = np.zeros((k, dimension + 1), np.int64)
                for c in np.unique(a).tolist():
                    sums[c, 0] = (a == c).sum()
                    sums[c, 1:] = codes[a == c].sum(0)
                out = [row["ids"], row["no_id"], row["codes"], *[v.tobytes() for v in (a, b, upper, lower, sums)]]
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in out], names=["ids", "no_id", "codes", "nearest", "second", "upper", "lower", "sums"])

    return run


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of all blocks of a task, one row a number."""
    total = None
    for batch in batches:
        for value in batch.column(0).to_pylist():
            sums = np.frombuffer(value, np.int64).astype(object)  # no overflow, however many blocks
            total = sums if total is None else total + sums
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int64()), pa.array([Decimal(int(v)) for v in total], pa.decimal128(38, 0))], names=["i", "v"])


def _members(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                codes = np.frombuffer(row["codes"], np.int32).reshape(-1, centroids.shape[1]).astype(np.int64)
                a = np.frombuffer(row["nearest"], np.int32)
                ids = pa.array(np.frombuffer(row["ids"], np.int64), mask=np.frombuffer(row["no_id"], np.int8) == 1)
                yield pa.RecordBatch.from_arrays([ids, pa.array(a), pa.array(_squared(codes, centroids, a))], names=["id", "cluster", "distance"])

    return run


def first_centroids(points: DataFrame, k: int, seed: int, scale: int, dimension: int, id_: str, vector: str) -> np.ndarray:
    """The ``k`` usable vectors whose hash of seed and id comes first; equal ids by their components."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_).cast("bigint").cast("string"), F.lit(""))), 256)
    times = F.transform(F.col(vector).cast("array<double>"), lambda x: x * F.lit(float(scale)))
    usable = F.forall(times, lambda x: F.coalesce((x >= -most(dimension)) & (x < most(dimension) + 1), F.lit(False)))  # NaN is above all numbers
    codes = F.transform(times, lambda x: F.floor(x).cast("bigint"))
    kept = points.where((F.size(vector) == dimension) & usable).select(key.alias("key"), codes.alias("codes"))
    return np.array([r["codes"] for r in kept.orderBy("key", "codes").limit(k).collect()], np.int64).reshape(-1, dimension)


def kmeans(points: DataFrame, k: int = 8, rounds: int = 10, scale: int = 1024, dimension: int = 64, seed: int = 3, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Per usable row of ``points``: id, cluster, distance (squared), n, cluster_inertia, inertia, centroid (components).

    Components become floor(scale * x). Rows take part whose vector has exactly ``dimension``
    components, none null, non-finite or, scaled, beyond ``most(dimension)``. ``k`` of them (all, if
    fewer) start as centroids: those whose SHA-256 of ``seed:id`` comes first. Each round
    assigns every vector to its nearest centroid (ties: smaller number) and replaces each
    centroid that has vectors by their componentwise floor(sum / count); then all are assigned
    once more. Repeated rows are so many vectors. A null id hashes as no characters. Other
    columns are not looked at. An inertia beyond 64 bits is null. Without usable rows the result is empty.
    """
    spark = points.sparkSession
    shape = "id bigint, cluster int, distance bigint, n bigint, cluster_inertia bigint, inertia bigint, centroid array<bigint>"
    centroids = first_centroids(points, k, seed, scale, dimension, id_, vector)
    if len(centroids) == 0:
        return spark.createDataFrame([], shape)
    blocks = points.select(F.col(id_).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v")).mapInArrow(_blocks(scale, dimension), BLOCKS)
    before, held = None, None
    for number in range(rounds + 1):
        blocks = blocks.mapInArrow(_step(Round(centroids, before), dimension), BLOCKS)
        last = number == rounds
        if last or number % CUT_AFTER == CUT_AFTER - 1:
            blocks = stored(blocks, "clusters")
            new = None
        else:
            new = blocks.persist(StorageLevel.MEMORY_AND_DISK)
        if not last:
            totals = blocks.select("sums").mapInArrow(_opened, "i bigint, v decimal(38,0)").groupBy("i").agg(F.sum("v").alias("v"))
            flat = {r["i"]: int(r["v"]) for r in totals.collect()}  # a number a centroid and component
            sums = [[flat[c * (dimension + 1) + j] for j in range(dimension + 1)] for c in range(len(centroids))]
            before, centroids = centroids, np.array([[v // s[0] for v in s[1:]] if s[0] else old.tolist() for s, old in zip(sums, centroids)], np.int64)
        if held is not None:
            held.unpersist()
        held = new
    members = blocks.select("ids", "no_id", "codes", "nearest").mapInArrow(_members(centroids), "id bigint, cluster int, distance bigint")
    sizes = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.try_sum("distance").alias("cluster_inertia"))
    facts = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cluster int, centroid array<bigint>")
    whole = sizes.agg(F.try_sum("cluster_inertia").alias("inertia"))
    # At most k rows, and one.
    told = sizes.join(F.broadcast(facts), "cluster").select("*", whole.scalar().alias("inertia"))
    return members.join(F.broadcast(told), "cluster").select("id", "cluster", "distance", "n", "cluster_inertia", "inertia", "centroid")
