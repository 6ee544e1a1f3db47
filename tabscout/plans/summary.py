"""Number columns in two scans: mergeable summaries first, then exact ranks inside known ranges.

The first scan folds every Arrow batch into moments, co-moments of column pairs and a
quantile sketch, one partial a task, and merges partials in two streaming steps. The sketch
says within which values a wanted rank lies. The second scan counts the rows below each
such range and collects the few values inside it with their counts, so that quantiles and
the numbers of values beyond fences are exact. Ranks that a sketch has misjudged, or ranges
that hold too many rows, are left to ``select_ranks``.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window as W, functions as F

from tabscout.functions.moments import Summary, folded, inside, merged
from tabscout.functions.text import ref
from tabscout.plans.durable import durable, local_rows
from tabscout.plans.orderstats import FINAL_ROWS, select_ranks


def _numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[ref(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])


def summarize(df: DataFrame, columns: Sequence[str], paired: bool = True, sketched: bool = True) -> Summary:
    """One scan of ``columns`` as doubles; missing, NaN and infinite values are left out."""
    return summarize_all([(df, columns)], paired, sketched)[0]


def summarize_all(tables: Sequence[tuple[DataFrame, Sequence[str]]], paired: bool = True, sketched: bool = True) -> list[Summary]:
    """The same of several tables, in one job."""
    out = [Summary(len(columns), paired, sketched) for _, columns in tables]
    shape = "table int, part binary"
    parts = [_numbers(df, columns).mapInArrow(folded(t, len(columns), paired, sketched), shape) for t, (df, columns) in enumerate(tables) if columns]
    if not parts:
        return out
    middle = max(1, math.isqrt(int(parts[0].sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    # Partials are merged one by one as they stream in, first in a few tasks, then in one.
    first = reduce(DataFrame.unionByName, parts).repartition(middle).mapInArrow(merged, shape)
    for row in first.repartition(1).mapInArrow(merged, shape).collect():  # one row a table
        out[row["table"]] = pickle.loads(row["part"])
    return out


#: Counted values inside all ranges that the driver looks through itself.
DRIVER_ROWS = 100_000


@dataclass
class Exact:
    quantiles: dict[str, list[float]]
    beyond: dict[str, tuple[float, float, int]]  # fences, and the values outside of them


def exact(df: DataFrame, columns: Sequence[str], summary: Summary, probs: Sequence[float], fences: tuple[int, int] | None = None, k: float = 1.5) -> Exact:
    """Linearly interpolated quantiles of each column, in one more scan.

    ``fences`` names two of the ``probs``, the quartiles: the values beyond ``k`` times their
    distance from them are counted in the same scan.
    """
    return exact_all([(df, columns, summary)], probs, fences, k)[0]


def _wanted(summary: Summary, probs: Sequence[float], fences, k: float) -> tuple[list, list]:
    """(column, rank), with the range that must hold it; for fences, with the range that must hold them and no rank."""
    wanted, ranges = [], []
    for i in np.flatnonzero(summary.n > 0).tolist():
        n = int(summary.n[i])
        ranks = sorted({f((n - 1) * p) + 1 for p in probs for f in (math.floor, math.ceil)})
        near = summary.sketches[i].around(ranks, n)
        wanted += [(i, r) for r in ranks]
        ranges += [(i, *a) for a in near]
        if fences:
            at = dict(zip(ranks, near))
            clamp = lambda v: min(max(v, summary.low[i]), summary.high[i])
            (a, b), (c, d) = ((clamp(at[math.floor((n - 1) * probs[f]) + 1][0]), clamp(at[math.ceil((n - 1) * probs[f]) + 1][1])) for f in fences)
            wanted += [(i, None)] * 2
            ranges += [(i, a - k * (d - a), b - k * max(c - b, 0)), (i, c + k * max(c - b, 0), d + k * (d - a))]
    return wanted, ranges


def exact_all(tables: Sequence[tuple[DataFrame, Sequence[str], Summary]], probs: Sequence[float], fences: tuple[int, int] | None = None, k: float = 1.5) -> list[Exact]:
    """``exact`` of several tables, in one job while their summaries hold."""
    out, plans, first = [Exact({}, {}) for _ in tables], [], 0
    for t, (df, columns, summary) in enumerate(tables):
        wanted, ranges = _wanted(summary, probs, fences, k)
        if ranges:
            plans.append((t, _numbers(df, columns), wanted, ranges, first))
            first += len(ranges)
    if not plans:
        return out
    scans = [numbers.mapInArrow(inside(ranges, start), "slot int, value double, cnt bigint") for _, numbers, _, ranges, start in plans]
    held = _held(durable(reduce(DataFrame.unionByName, scans).groupBy("slot", "value").agg(F.sum("cnt").alias("cnt"))))
    asked, of, missed = [], {}, {}
    for t, _, wanted, _, start in plans:
        for slot, (i, rank) in enumerate(wanted, start):
            below, here = held.sums.get(slot, (0, 0))
            if rank is not None and below < rank <= below + here and here <= FINAL_ROWS:
                asked.append((slot, int(rank - below)))
                of[slot] = t, i, rank
            elif rank is not None:
                missed.setdefault(t, {}).setdefault(f"c{i}", []).append(rank)
    value_of = {of[slot]: value for slot, value in held.values(asked).items()}
    for t, numbers, wanted, ranges, start in plans:
        _, columns, summary = tables[t]
        if t in missed:
            more = select_ranks(numbers.select(*missed[t]), missed[t])
            value_of.update({(t, int(c[1:]), rank): value for (c, rank), (value, _) in more.items()})
        able = np.flatnonzero(summary.n > 0).tolist()
        for i in able:
            n, q = int(summary.n[i]), []
            for p in probs:
                place = (n - 1) * p
                low, high = (value_of[t, i, f(place) + 1] for f in (math.floor, math.ceil))
                q.append(low + (high - low) * (place - math.floor(place)))
            out[t].quantiles[columns[i]] = q
        if fences:
            _count_beyond(out[t], held, columns, able, wanted, ranges, start, summary, fences, k, numbers)
    return out


class _Few:
    """The counted values inside all ranges, few enough for the driver."""

    def __init__(self, found: DataFrame):
        table = found.toArrow()
        slot, value, cnt = (table.column(c).to_numpy() for c in ("slot", "value", "cnt"))
        order = np.lexsort((value, slot))  # the count below a range, under NaN, comes last
        slot, value, cnt = slot[order], value[order], cnt[order]
        self.sums, self.parts = {}, {}
        for s in np.unique(slot).tolist():
            here = slot == s
            inside = here & ~np.isnan(value)
            self.parts[s] = value[inside], np.cumsum(cnt[inside])
            self.sums[s] = int(cnt[here & np.isnan(value)].sum()), int(cnt[inside].sum())

    def values(self, asked: list[tuple[int, int]]) -> dict[int, float]:
        return {s: float(self.parts[s][0][np.searchsorted(self.parts[s][1], local)]) for s, local in asked}

    def upto(self, edges: list[tuple[int, float, int]]) -> dict[int, int]:
        out = {}
        for s, edge, side in edges:
            values, running = self.parts.get(s, (np.zeros(0), np.zeros(0)))
            at = np.searchsorted(values, edge, side="right" if side else "left")
            out[s] = int(running[at - 1]) if at else 0
        return out


class _Many:
    """The same, left in Spark."""

    def __init__(self, found: DataFrame):
        self.found, self.inside = found, found.where("value IS NOT NULL")
        sums = found.groupBy("slot").agg(F.sum(F.when(F.col("value").isNull(), F.col("cnt"))).alias("below"), F.sum(F.when(F.col("value").isNotNull(), F.col("cnt"))).alias("here"))
        self.sums = {r["slot"]: (r["below"] or 0, r["here"] or 0) for r in sums.collect()}  # a row a slot

    def values(self, asked: list[tuple[int, int]]) -> dict[int, float]:
        if not asked:
            return {}
        small = self.inside.join(F.broadcast(local_rows(self.found.sparkSession, asked, "slot int, local bigint")), "slot")  # a row a rank
        running = F.sum("cnt").over(W.partitionBy("slot").orderBy("value").rowsBetween(W.unboundedPreceding, W.currentRow))  # at most FINAL_ROWS values a slot
        hits = small.withColumn("upto", running).where("local <= upto AND local > upto - cnt").select("slot", "value").collect()
        return {h["slot"]: h["value"] for h in hits}

    def upto(self, edges: list[tuple[int, float, int]]) -> dict[int, int]:
        if not edges:
            return {}
        near = self.inside.join(F.broadcast(local_rows(self.found.sparkSession, edges, "slot int, edge double, side int")), "slot")  # two rows a column
        counted = near.where("CASE WHEN side = 0 THEN value < edge ELSE value <= edge END").groupBy("slot").agg(F.sum("cnt").alias("n")).collect()
        return {r["slot"]: r["n"] for r in counted}


def _held(found: DataFrame) -> _Few | _Many:
    return _Few(found) if found.count() <= DRIVER_ROWS else _Many(found)


def _count_beyond(out: Exact, held: _Few | _Many, columns, able, wanted, ranges, start: int, summary: Summary, fences, k: float, numbers: DataFrame) -> None:
    bounds = {}
    for i in able:
        q1, q3 = (out.quantiles[columns[i]][f] for f in fences)
        bounds[i] = (q1 - (q3 - q1) * k, q3 + (q3 - q1) * k)
    slots = {i: [s for s, (c, rank) in enumerate(wanted) if c == i and rank is None] for i in able}
    sure = [i for i in able if all(ranges[s][1] <= b <= ranges[s][2] for s, b in zip(slots[i], bounds[i]))]
    edges = [(start + slots[i][side], bounds[i][side], side) for i in sure for side in (0, 1)]
    inside_of = held.upto(edges)
    for i in sure:
        low, high = (start + s for s in slots[i])
        below = held.sums.get(low, (0, 0))[0] + inside_of.get(low, 0)
        upto = held.sums.get(high, (0, 0))[0] + inside_of.get(high, 0)
        out.beyond[columns[i]] = (*bounds[i], int(below + summary.n[i] - upto))
    rest = [i for i in able if i not in sure]
    if rest:  # a fence outside the range that the sketch gave
        row = numbers.agg(*[F.count_if((F.col(f"c{i}") < bounds[i][0]) | (F.col(f"c{i}") > bounds[i][1])).alias(f"n{i}") for i in rest]).first()
        out.beyond.update({columns[i]: (*bounds[i], row[f"n{i}"]) for i in rest})
