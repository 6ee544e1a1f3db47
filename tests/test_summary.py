"""Mergeable summaries and exact ranks against whole sorts."""

import math
import random

import numpy as np
import pytest

from tabscout.functions.moments import SKETCH, Sketch, Summary
from tabscout.plans import summary as su


def column(kind, n, rng):
    return {"normal": rng.normal(5, 2, n), "sorted": np.sort(rng.normal(0, 1, n)), "hot": np.where(rng.random(n) < 0.6, 3.0, rng.normal(0, 9, n)),
            "few": rng.integers(0, 5, n).astype(float), "large": 1e9 + rng.random(n), "constant": np.full(n, 0.1), "gaps": np.where(rng.random(n) < 0.3, np.nan, rng.random(n)),
            "none": np.full(n, np.nan)}[kind]


KINDS = ["normal", "sorted", "hot", "few", "large", "constant", "gaps", "none"]


@pytest.mark.parametrize("n", [1, 3, 50, 5000])
def test_merged_parts_equal_the_whole(n):
    rng = np.random.default_rng(n)
    x = np.column_stack([column(k, n, rng) for k in KINDS])
    total = Summary(len(KINDS), True)
    for start in range(0, n, max(1, n // 7)):
        total.merge(Summary.of(x[start : start + max(1, n // 7)], True, True))
    for i, k in enumerate(KINDS):
        v = x[np.isfinite(x[:, i]), i]
        assert total.n[i] == len(v)
        if len(v):
            assert (total.low[i], total.high[i]) == (v.min(), v.max()) and math.isclose(total.mean[i], v.mean(), rel_tol=1e-12)
        if len(v) > 3 and k != "constant" and len(set(v)) > 1:
            d = v - v.mean()
            g1, g2 = (d**3).mean() / (d**2).mean() ** 1.5, (d**4).mean() / (d**2).mean() ** 2 - 3
            m = len(v)
            near = 1e-3 if k == "large" else 1e-6  # doubles near 1e9 are 1e-7 apart
            assert math.isclose(total.skewness(i), g1 * math.sqrt(m * (m - 1)) / (m - 2), rel_tol=near, abs_tol=near)
            assert math.isclose(total.kurtosis(i), ((m + 1) * g2 + 6) * (m - 1) / ((m - 2) * (m - 3)), rel_tol=near, abs_tol=near)
        else:
            assert total.kurtosis(i) is None
    for i in range(len(KINDS)):
        for j in range(i + 1, len(KINDS)):
            both = np.isfinite(x[:, i]) & np.isfinite(x[:, j])
            a, b = x[both, i], x[both, j]
            got = total.correlation(i, j)
            if len(a) < 2 or len(set(a)) == 1 or len(set(b)) == 1:
                assert got is None
            else:
                assert math.isclose(got, np.corrcoef(a, b)[0, 1], rel_tol=1e-4, abs_tol=1e-6)


@pytest.mark.parametrize("kind", ["normal", "sorted", "hot", "few"])
def test_sketch_finds_ranks(kind):
    rng = np.random.default_rng(3)
    x = column(kind, 200_000, rng)
    parts = []
    for part in np.array_split(x, 13):
        s = Sketch()
        for batch in np.array_split(part, 5):
            s.add(batch)
        parts.append(s)
    for s in parts[1:]:
        parts[0].merge(s)
    assert sum(map(len, parts[0].levels)) < 2 * SKETCH * len(parts[0].levels)
    ordered, ranks = np.sort(x), [1, 1000, 50_000, 100_000, 150_001, 200_000]
    for rank, (low, high) in zip(ranks, parts[0].around(ranks, len(x))):
        assert low <= ordered[rank - 1] <= high
        assert kind in ("hot", "few") or ((x >= low) & (x <= high)).mean() < 0.02


@pytest.mark.parametrize("rows", [su.DRIVER_ROWS, 0])
def test_exact_quantiles_and_fences(spark, monkeypatch, rows):
    monkeypatch.setattr(su, "DRIVER_ROWS", rows)
    rng = np.random.default_rng(7)
    x = np.column_stack([column(k, 30_000, rng) for k in KINDS])
    x[:5, 0] = 1e6  # far values
    df = spark.createDataFrame([tuple(None if math.isnan(v) else float(v) for v in r) for r in x], ", ".join(f"{k} double" for k in KINDS)).repartition(5)
    found = su.summarize(df, KINDS)
    got = su.exact(df, KINDS, found, [0.0, 0.25, 0.5, 0.75, 1.0], (1, 3))
    for i, k in enumerate(KINDS):
        v = x[np.isfinite(x[:, i]), i]
        if len(v) == 0:
            assert k not in got.quantiles
            continue
        q = np.quantile(v, [0, 0.25, 0.5, 0.75, 1])
        assert np.allclose(got.quantiles[k], q, rtol=1e-12)
        q1, q3 = got.quantiles[k][1], got.quantiles[k][3]
        low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        assert got.beyond[k] == (low, high, int(((v < low) | (v > high)).sum()))


def test_ranks_that_the_sketch_misses_are_found(spark, monkeypatch):
    """A sketch that is wrong, or ranges that hold too many rows, change the work and not the result."""
    rng = random.Random(1)
    values = [rng.gauss(0, 1) for _ in range(20_000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    found = su.summarize(df, ["v"])
    want = np.quantile(values, [0.25, 0.5, 0.75]).tolist()
    monkeypatch.setattr(Sketch, "around", lambda self, ranks, n: [(5.0, 6.0) for _ in ranks])
    wrong = su.exact(df, ["v"], found, [0.25, 0.5, 0.75], (0, 2))
    assert np.allclose(wrong.quantiles["v"], want)
    beyond = wrong.beyond["v"]
    assert beyond[2] == sum(v < beyond[0] or v > beyond[1] for v in values)
    monkeypatch.undo()
    monkeypatch.setattr(su, "FINAL_ROWS", 10)
    assert np.allclose(su.exact(df, ["v"], found, [0.25, 0.5, 0.75]).quantiles["v"], want)
