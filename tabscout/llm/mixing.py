"""Mix sources to target weights by balanced sampling with the cube method.

Each source gets a target in words. All its rows are taken floor(rate) times, and the rest
of the rate is an inclusion probability, equal within the source. The cube method's flight
phase moves these probabilities to 0 or 1 along the null space of the balancing constraints
(words and rows), block by block; what stays fractional, two rows a block at most, is
gathered and moved again, until one block a source is left, whose last rows are landed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tabscout.llm.common import cut, id_of, text_key, text_of

# The weights that sources take in turn, in code point order.
WEIGHTS = (5, 2, 1)
#: Rows of a block of the flight phase.
BLOCK = 2000
#: Closer than this to 0 or 1 a probability has arrived.
EPS = 1e-9


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``sizes`` (source, source_size) with ``target``: shares by weight, at most ``most`` times the size.

    What exceeds the limit is shared again by weight. The result is the least of the limit and
    one level times the weight; sources that reach their limit first come first in the order
    of limit by weight, so the level follows from running sums. One row per source.
    """
    w = F.array([F.lit(float(x)) for x in weights])
    everything = Window.partitionBy(F.lit(0))
    by_name = sizes.withColumn("w", F.get(w, ((F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)).cast("int")))
    cap = by_name.withColumn("cap", most * F.col("source_size"))
    upto = everything.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    level = ((share * F.sum("source_size").over(everything) - (F.sum("cap").over(upto) - F.col("cap")))
             / (F.sum("w").over(everything) - (F.sum("w").over(upto) - F.col("w"))))
    # A source is full if the level that holds once all before it are full reaches its limit. The level
    # rises up to the first that is not, which sets it, and would fall after it.
    stepped = cap.withColumn("level", level).withColumn("full", F.col("level") * F.col("w") >= F.col("cap"))
    final = F.max(F.when(~F.col("full"), F.col("level"))).over(everything)
    return stepped.withColumn("final", final).select(
        "source", "source_size", F.when(F.col("full") | F.col("final").isNull(), F.col("cap")).otherwise(F.least(F.col("final") * F.col("w"), F.col("cap"))).alias("target"))


def flight(pi: np.ndarray, constraints: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Move ``pi`` to 0 or 1 along vectors that leave ``constraints @ pi`` as it is; at most as many stay as there are constraints."""
    pi, q = pi.copy(), constraints.shape[0]
    active = [i for i in range(len(pi)) if EPS < pi[i] < 1 - EPS]
    held, rest = active[: q + 1], iter(active[q + 1 :])
    while len(held) == q + 1:
        a = constraints[:, held]
        if q == 2:
            v = np.array([a[0, 1] * a[1, 2] - a[0, 2] * a[1, 1], a[0, 2] * a[1, 0] - a[0, 0] * a[1, 2], a[0, 0] * a[1, 1] - a[0, 1] * a[1, 0]])
        else:
            v = np.linalg.svd(a)[2][-1]
        if not np.abs(v).max() > 1e-12:  # the constraints agree on these rows: any vector that both leave alone
            v = np.linalg.svd(a)[2][-1]
        v /= np.abs(v).max()
        p = pi[held]
        move = np.abs(v) > EPS
        up, down = np.where(v > 0, 1 - p, p)[move] / np.abs(v[move]), np.where(v > 0, p, 1 - p)[move] / np.abs(v[move])
        u, d = up.min(), down.min()
        p = p + v * (u if rng.random() * (u + d) < d else -d)
        pi[held] = p
        still = []
        for i in held:
            if pi[i] < EPS or pi[i] > 1 - EPS:
                pi[i] = round(pi[i])
                if (nxt := next(rest, None)) is not None:
                    still.append(nxt)
            else:
                still.append(i)
        held = still
    return pi


def land(pi: np.ndarray, size: np.ndarray, rng: np.random.Generator, trades: int = 4) -> np.ndarray:
    """Round the last rows so that their words come nearest to what the probabilities say; ties by chance.

    In a small source even the best rounding can be far off, as one row may hold much of the
    words. Then a few trades of a taken row for another, or for none, close the gap.
    """
    left = [i for i in range(len(pi)) if EPS < pi[i] < 1 - EPS]
    if not left:
        return pi
    wanted = (pi * size).sum()
    pi = pi.copy()
    rest = wanted - (np.delete(pi, left) * np.delete(size, left)).sum()
    ways = [[b >> j & 1 for j in range(len(left))] for b in range(1 << len(left))]
    pi[left] = min(ways, key=lambda w: (abs(np.dot(w, size[left]) - rest), rng.random()))
    for _ in range(trades):
        gap = (pi * size).sum() - wanted
        taken, free = np.append(np.flatnonzero(pi > 0.5), -1), np.append(np.flatnonzero(pi <= 0.5), -1)
        out, into = np.append(size[taken[:-1]], 0.0), np.append(size[free[:-1]], 0.0)
        order = np.argsort(into, kind="stable")
        near = np.searchsorted(into[order], out - gap)
        pairs = [(abs(gap - out[i] + into[order[j]]), i, order[j]) for i in range(len(out)) for j in (near[i] - 1, near[i]) if 0 <= j < len(order)]
        best, i, j = min(pairs)
        if best >= abs(gap):
            break
        if taken[i] >= 0:
            pi[taken[i]] = 0
        if free[j] >= 0:
            pi[free[j]] = 1
    return pi


def _move(seed: int, last: bool):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["r", "d", "k", "size"], kind="stable", ignore_index=True)
        rng = np.random.default_rng([seed, int(block["block"].iat[0]) & 0xFFFFFFFF, int(block["r"].iat[0]) & 0xFFFFFFFF])
        pi, size = block["pi"].to_numpy(float), block["size"].to_numpy(float)
        scale = max(size.mean(), 1.0)
        pi = flight(pi, np.vstack([size / scale, block["copies"].to_numpy(float)]), rng)
        if last:
            pi = land(pi, size, rng)
        return block.assign(pi=pi)

    return run


def cube_sample(units: DataFrame, seed: int = 7, block: int = BLOCK) -> DataFrame:
    """``units`` (source, d, k, size, copies, pi) with pi at 0 or 1, balanced by source over size and copies.

    ``d`` and ``k`` tell units apart. Rounds: blocks of about ``block`` rows by hash; what
    stays fractional goes to the next round, a few thousandths of it at a time.
    """
    schema = "source string, d bigint, k bigint, size bigint, copies bigint, pi double, r bigint, block int"
    rest = units.withColumn("r", F.xxhash64(F.lit(seed), "d", "k", "size"))
    biggest = units.groupBy("source").count().agg(F.max("count")).first()[0] or 0
    done, level = [], 0
    while True:
        blocks = max(1, -(-biggest // block))
        last = blocks == 1
        dealt = rest.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), F.lit(level), "r"), F.lit(blocks)).cast("int"))
        moved = dealt.select("source", "d", "k", "size", "copies", "pi", "r", "block").groupBy("source", "block").applyInPandas(_move(seed + level, last), schema).drop("block")
        if last:
            done.append(moved)
            break
        moved = cut(moved)
        done.append(moved.where((F.col("pi") <= EPS) | (F.col("pi") >= 1 - EPS)))
        rest = moved.where((F.col("pi") > EPS) & (F.col("pi") < 1 - EPS))
        biggest = rest.groupBy("source").count().agg(F.max("count")).first()[0] or 0
        level += 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.drop("r")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 7,
        doc: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per distinct (id, text, source): ``d``, ``k``, ``source``, ``size``, ``source_size``, ``target`` and ``times``.

    ``times`` is how often each of its rows is taken, at most ``most`` rounded up. Null text
    has size 0, null source is a source of its own (last), a null id is an id like others.
    Repeated rows share one decision and weigh as many as they are. A source of size 0 has
    target 0 and takes nothing. An empty table gives no rows.
    """
    body = text_of(text)
    rows = docs.select(id_of(doc).alias("d"), text_key(body).alias("k"), F.col(source).cast("string").alias("source"), word_count(body).alias("size"))
    units = cut(rows.groupBy("source", "d", "k", "size").agg(F.count("*").alias("copies")))
    sizes = units.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"))
    aims = cut(targets(sizes, weights, share, most)).select(F.col("source").alias("s"), "source_size", "target")
    rated = units.join(aims, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(rate + 1e-12)
    rated = rated.withColumns({"whole": whole.cast("bigint"), "pi": F.greatest(rate - whole, F.lit(0.0))})
    settled = rated.where(F.col("pi") <= EPS).select("source", "d", "k", "size", "copies", F.lit(0.0).alias("pi"))
    moving = rated.where(F.col("pi") > EPS).select("source", "d", "k", (F.col("size") * F.col("copies")).alias("size"), "copies", "pi")
    sampled = cube_sample(moving, seed).withColumn("size", (F.col("size") / F.col("copies")).cast("bigint"))
    chosen = sampled.unionByName(settled)
    out = chosen.join(aims.withColumn("whole", F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0) + 1e-12).cast("bigint")),
                      F.col("source").eqNullSafe(F.col("s")))
    return out.select("d", "k", "source", "size", "source_size", "target", (F.col("whole") + F.round("pi").cast("bigint")).alias("times"))


def with_times(docs: DataFrame, mixed: DataFrame, columns: list[Column], doc: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``columns`` of each row of ``docs`` with what ``mixed`` says of it."""
    body = text_of(text)
    rows = docs.select(*columns, F.struct(id_of(doc).alias("d"), text_key(body).alias("k"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("s"),
                                          F.col(source).isNull().alias("no")).alias("__mix"))
    said = mixed.select(F.struct("d", "k", F.coalesce("source", F.lit("")).alias("s"), F.col("source").isNull().alias("no")).alias("__mix"),
                        F.struct("size", "source_size", "target", "times").alias("__said"))
    return rows.join(said, "__mix").drop("__mix")
