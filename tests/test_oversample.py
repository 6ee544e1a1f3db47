"""Exact neighbours by rings, the work they take, and the rows made between them."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabscout.operators.oversample import nearest, smote


def brute(x, labels, ids, k):
    out = set()
    for i in range(len(x)):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        mine = sorted((d[j], ids[j]) for j in range(len(x)) if labels[j] == labels[i] and j != i)
        out |= {(labels[i], ids[i], r + 1, o, round(v, 9)) for r, (v, o) in enumerate(mine[:k])}
    return out


@pytest.mark.parametrize("block,pivots", [(2048, None), (16, 4), (7, 30)])
def test_neighbours_are_exact(spark, block, pivots):
    rng = np.random.default_rng(block)
    x = np.concatenate([rng.normal(c, 0.5, (60, 3)) for c in (0, 4, 30)] + [rng.integers(0, 3, (27, 3)) + np.arange(27)[:, None] * 1e-3, np.full((1, 3), 100.0)])
    labels = ["a" if i % 5 else "b" for i in range(len(x))]
    labels[0], labels[1] = "alone", "two"
    labels[2] = "two"
    ids = [f"p{i}" for i in range(len(x))]
    points = spark.createDataFrame([(lab, i, v.tolist()) for lab, i, v in zip(labels, ids, x)], "label string, pid string, vec array<double>")
    got = {(r["label"], r["pid"], r["rank"], r["other"], round(r["distance"], 9)) for r in nearest(points, 4, pivots, block).collect()}
    assert got == brute(x, labels, ids, 4)


def test_work_is_below_quadratic(spark):
    """Four times the points meet far less than sixteen times the pairs of row and ring."""
    rng = np.random.default_rng(2)

    def pairs(n):
        centre = rng.uniform(0, 100, (n // 50, 4))
        x = centre[rng.integers(0, len(centre), n)] + rng.normal(0, 0.3, (n, 4))
        met = []
        points = spark.createDataFrame([("a", str(i), v.tolist()) for i, v in enumerate(x)], "label string, pid string, vec array<double>")
        nearest(points, 3, block=32, met=met).count()
        return sum(m.count() for m in met)
    few, many = pairs(1000), pairs(4000)
    assert many < 8 * few and many * 32 < 4000 * 4000 / 4


def test_vectors_without_clusters_are_moved_a_few_times(spark, tmp_path):
    """Where bounds rule out nothing, asking rows are not copied for each ring: what is kept on disk stays near the table's size."""
    context, n, dim = spark.sparkContext, 3000, 16
    before = context.getCheckpointDir()
    context.setCheckpointDir(str(tmp_path))
    try:
        x = np.random.default_rng(6).normal(size=(n, dim))
        points = spark.createDataFrame([("a", str(i), v.tolist()) for i, v in enumerate(x)], "label string, pid string, vec array<double>")
        assert nearest(points, 5).count() == 5 * n
    finally:
        if before:
            context.setCheckpointDir(before)
    kept = sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(tmp_path) for f in files)
    assert kept < 10 * n * (8 * dim + 100)


def test_copies_repeated_rows_and_gaps(spark):
    """Copies fill many blocks; each of two equal rows is one; rows of one id do not meet; vectors with gaps are no neighbours."""
    x = [[0.0, 0.0]] * 60 + [[float(i % 3), float(i % 4)] for i in range(60)]
    ids = [f"p{i:03d}" for i in range(120)]
    x, ids = x + x[:7] + x[100:], ids + ids[:7] + ids[100:]
    odd = [("a", "o1", None), ("a", "o2", [float("nan"), 0.0]), ("a", "o3", [None, 0.0]), ("a", "o4", [float("inf"), 0.0]), (None, "o5", [0.0, 0.0])]
    points = spark.createDataFrame([("a", i, v) for i, v in zip(ids, x)] + odd, "label string, pid string, vec array<double>")
    want, at = [], np.array(x)
    for one in sorted(set(ids)):
        met = [(np.sqrt(((at[i] - at[j]) ** 2).sum()), ids[j], x[j]) for i in range(len(x)) if ids[i] == one for j in range(len(x)) if ids[j] != one]
        want += [(one, rank + 1, other, round(d, 9), v) for rank, (d, other, v) in enumerate(sorted(met)[:4])]
    for block, pivots in ((2048, None), (16, None), (8, 5)):
        got = [(r.pid, r["rank"], r.other, round(r.distance, 9), r.vec) for r in nearest(points, 4, pivots, block).collect()]
        assert sorted(got) == want


def test_new_rows_lie_between_a_row_and_a_neighbour(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, int(i % 6 == 0), v.tolist()) for i, v in enumerate(rng.normal(0, 1, (120, 3)))], "id long, y int, v array<double>")
    out = smote(df, "v", "y", "id").collect()
    rare = np.array([r["v"] for r in out if r["y"] == 1 and not r["synthetic"]])
    made = [np.array(r["v"]) for r in out if r["synthetic"]]
    assert len(made) == 100 - 20
    d = np.sqrt(((rare[:, None] - rare[None]) ** 2).sum(2))
    near = np.argsort(d, axis=1, kind="stable")[:, 1:6]
    for m in made:
        best = min(np.linalg.norm(a + t * (b - a) - m) for i, a in enumerate(rare) for b in rare[near[i]]
                   for t in [np.clip((m - a) @ (b - a) / ((b - a) @ (b - a)), 0, 1)])
        assert best < 1e-9


def test_rows_with_gaps_are_kept_and_give_no_new_ones(spark):
    rows = [(i, int(i % 5 == 0), [float(i), float(i * i % 7)]) for i in range(60)] + [(60, 1, None), (61, 1, [float("nan"), 1.0]), (62, 1, [None, 1.0])]
    out = smote(spark.createDataFrame(rows, "id long, y int, v array<double>"), "v", "y", "id").collect()
    made = [r["v"] for r in out if r["synthetic"]]
    assert len(made) == 48 - 15 and all(np.isfinite(v).all() for v in made)
    assert sum(r["y"] == 1 and not r["synthetic"] for r in out) == 15
