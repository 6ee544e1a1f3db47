"""Exact order statistics without a global sort and without one-task groups.

A value with rank r is found in three narrow steps: cut the value range into
buckets, count rows per bucket (a small aggregate), then look only into the few
buckets that hold a wanted rank. Bucket cuts come from a quantile sketch of the whole
data, so every round leaves a known small share of the rows, sorted or not. They only
balance the work: counts and values are exact whatever the cuts are.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tabscout.plans import sizing
from tabscout.plans.durable import durable, lookup

BUCKETS = 1024
# Rows that one task may sort when the wanted buckets have been found.
FINAL_ROWS = 2_000_000
COLUMNS_PER_PASS = 16
# Rows of a bucket of md5 order, about.
MD5_BUCKET = 65_536


def _and(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def same_keys(left: str, right: str, keys: Sequence[str]) -> list[Column]:
    """Null-safe equality of ``keys`` between two aliased frames."""
    return [F.col(f"{left}.`{k}`").eqNullSafe(F.col(f"{right}.`{k}`")) for k in keys]


def cut_points(df: DataFrame, columns: Sequence[str]) -> dict[str, list[float]]:
    """Split points per double column, from a sketch of all its rows: no bucket holds more than about 2 / BUCKETS of them."""
    shares = F.array(*[F.lit(i / BUCKETS) for i in range(BUCKETS + 1)])
    row = df.agg(*[F.percentile_approx(f"`{c}`", shares, 2 * BUCKETS).alias(f"s{i}") for i, c in enumerate(columns)]).first()
    result = {}
    for i, c in enumerate(columns):
        values = np.array(row[i] or [], dtype="float64")
        points, counts = np.unique(values[np.isfinite(values)], return_counts=True)
        # A value filling several cuts is hot: close its bucket right above it.
        hot = np.nextafter(points[counts > 1], np.inf)
        inner = np.union1d(points, hot).tolist() or [0.0]
        result[c] = [-math.inf, *inner, math.inf]
    return result


def with_buckets(df: DataFrame, cuts: dict[str, list[float]], suffix: str) -> DataFrame:
    """Add ``<column><suffix>``: the index of the bucket each value falls into."""
    return Bucketizer(
        inputCols=list(cuts),
        outputCols=[c + suffix for c in cuts],
        splitsArray=list(cuts.values()),
        handleInvalid="keep",
    ).transform(df)


def quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    keys: Sequence[str] = (),
    small_bytes: int | None = None,
) -> DataFrame:
    """Exact, linearly interpolated quantiles of numeric columns, per key.

    Returns ``keys..., column, n, q`` with ``q`` an array in the order of ``probs``;
    nulls are skipped and a column without values gives no row. Inputs estimated above
    ``small_bytes`` never bring a whole column or group to one task.
    """
    columns, probs, keys = list(columns), list(probs), list(keys)
    if not columns:
        return df.limit(0).select(*_cols(keys), F.lit("").alias("column"), F.lit(0).cast("bigint").alias("n"), F.array().cast("array<double>").alias("q"))
    numbers = [F.col(f"`{c}`").cast("double") for c in columns]
    data = df.select(*_cols(keys), *[F.when(~F.isnan(v), v).alias(f"__v{i}") for i, v in enumerate(numbers)])
    small = sizing.is_small(data, small_bytes)
    if not small and not keys:
        return _narrowed_quantiles(data, columns, probs)
    group = [*keys, "__column"]
    freq = _melt(data, columns, keys)
    found = _interpolate(_running_counts(freq, group), group, probs) if small else _ranged_quantiles(freq, group, probs)
    names = F.array(*[F.lit(c) for c in columns])
    return found.select(*_cols(keys), F.element_at(names, F.col("__column") + 1).alias("column"), "n", "q")


def _cols(names):
    return [F.col(f"`{k}`") for k in names]


def _melt(data: DataFrame, columns, keys=()) -> DataFrame:
    """keys..., __column (position), value, cnt: equal values of a column (and key) collapsed to one row."""
    cells = F.array(*[F.struct(F.lit(i).alias("__column"), F.col(f"__v{i}").alias("value")) for i in range(len(columns))])
    return (data.select(*_cols(keys), F.inline(cells)).where("value is not null")
            .groupBy(*_cols([*keys, "__column"]), "value").agg(F.count(F.lit(1)).alias("cnt")))


def _running_counts(freq: DataFrame, group) -> DataFrame:
    ordered = W.partitionBy(*_cols(group)).orderBy("value")
    return freq.withColumns({"upto": F.sum("cnt").over(ordered.rowsBetween(W.unboundedPreceding, W.currentRow)),
                             "n": F.sum("cnt").over(ordered.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))})


def _interpolate(running: DataFrame, group, probs) -> DataFrame:
    """Read quantiles off rows (value, upto, n) that include every wanted rank."""
    aggs = []
    for i, p in enumerate(probs):
        position = (F.col("n") - 1) * F.lit(float(p))
        aggs += [F.min(F.when(F.col("upto") >= F.floor(position) + 1, F.col("value"))).alias(f"lo{i}"),
                 F.min(F.when(F.col("upto") >= F.ceil(position) + 1, F.col("value"))).alias(f"hi{i}")]
    found = running.groupBy(*_cols(group), "n").agg(*aggs)
    values = []
    for i, p in enumerate(probs):
        position = (F.col("n") - 1) * F.lit(float(p))
        values.append(F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * (position - F.floor(position)))
    return found.select(*_cols(group), "n", F.array(*values).alias("q"))


def _ranged_quantiles(freq: DataFrame, group, probs) -> DataFrame:
    """Many groups, any of them large: sort by range, then look only into the slices that hold a rank."""
    # Slices must not move between the two reads below.
    ranged = durable(freq.repartitionByRange(*_cols(group), "value").withColumn("part", F.spark_partition_id()))
    slices = ranged.groupBy(*_cols(group), "part").agg(F.sum("cnt").alias("size"))
    whole = W.partitionBy(*_cols(group))
    placed = slices.withColumns({"last": F.sum("size").over(whole.orderBy("part")), "n": F.sum("size").over(whole)})
    ranks = F.array_distinct(F.flatten(F.array(*[
        F.array(F.floor((F.col("n") - 1) * F.lit(float(p))) + 1, F.ceil((F.col("n") - 1) * F.lit(float(p))) + 1) for p in probs])))
    holding = placed.where(F.exists(ranks, lambda r: (r > F.col("last") - F.col("size")) & (r <= F.col("last"))))
    inside = ranged.alias("l").join(lookup(holding).alias("r"), _and(same_keys("l", "r", [*group, "part"]))) \
        .select(*[F.col(f"l.`{k}`") for k in group], "l.part", "l.value", "l.cnt", "r.n", (F.col("r.last") - F.col("r.size")).alias("before"))
    local = F.sum("cnt").over(W.partitionBy(*_cols(group), "part").orderBy("value").rowsBetween(W.unboundedPreceding, W.currentRow))
    return _interpolate(inside.withColumn("upto", F.col("before") + local), group, probs)


def _narrowed_quantiles(data: DataFrame, columns, probs) -> DataFrame:
    """Whole columns: find the buckets holding the wanted ranks, then look only inside them."""
    counts = data.agg(*[F.count(f"__v{i}").alias(f"n{i}") for i in range(len(columns))]).first()
    rows = []
    for start in range(0, len(columns), COLUMNS_PER_PASS):
        chunk = [i for i in range(start, min(start + COLUMNS_PER_PASS, len(columns))) if counts[i]]
        wanted = {f"__v{i}": sorted({f((counts[i] - 1) * p) + 1 for p in probs for f in (math.floor, math.ceil)}) for i in chunk}
        found = select_ranks(data.select(*wanted), wanted, sizes=[counts[i] for i in chunk]) if wanted else {}
        for i in chunk:
            q = []
            for p in probs:
                position = (counts[i] - 1) * p
                lo, hi = (found[f"__v{i}", f(position) + 1][0] for f in (math.floor, math.ceil))
                q.append(lo + (hi - lo) * (position - math.floor(position)))
            rows.append((columns[i], counts[i], [float(v) for v in q]))
    return data.sparkSession.createDataFrame(rows, "column string, n long, q array<double>")  # one row per column


def select_ranks(data: DataFrame, wanted: dict[str, list[int]], final_rows: int | None = None,
                 sizes: Sequence[int] | None = None) -> dict[tuple[str, int], tuple[float, int]]:
    """(value, rows below it) at the 1-based ``wanted`` ranks of each double column; nulls are skipped.

    Each round counts the rows of every bucket and keeps the buckets that hold a rank as
    the columns of the next round, so the rows looked at shrink by the bucket count.
    ``sizes``: the non-null rows of each column, where they are known.
    """
    columns = list(wanted)
    final_rows = FINAL_ROWS if final_rows is None else final_rows
    if sizes is None:
        sizes = data.agg(*[F.count(f"`{c}`").alias(f"n{i}") for i, c in enumerate(columns)]).first()
    if max(sizes) <= final_rows:
        cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("value")) for c in columns])
        freq = data.select(F.inline(cells)).where("value is not null").groupBy("column", "value").agg(F.count(F.lit(1)).alias("cnt"))
        running = _running_counts(freq, ["column"])
        ask = F.lit(None).cast("array<bigint>")
        for c, ranks in wanted.items():
            ask = F.when(F.col("column") == c, F.array(*[F.lit(r).cast("bigint") for r in ranks])).otherwise(ask)
        hits = running.withColumn("rank", F.explode(F.filter(ask, lambda r: (r <= F.col("upto")) & (r > F.col("upto") - F.col("cnt")))))
        return {(h["column"], h["rank"]): (h["value"], h["below"])
                for h in hits.select("column", "rank", "value", (F.col("upto") - F.col("cnt")).alias("below")).collect()}
    cuts = cut_points(data, columns)
    bucketed = with_buckets(data, cuts, "__b")
    cells = F.array(*[F.struct(F.lit(i).alias("c"), F.col(f"`{c}__b`").cast("int").alias("b"), F.col(f"`{c}`").isNotNull().alias("ok")) for i, c in enumerate(columns)])
    counted = bucketed.select(F.inline(cells)).where("ok").groupBy("c", "b").agg(F.count(F.lit(1)).alias("n")).collect()  # columns x buckets
    result, parts, asked, held = {}, {}, {}, []
    for i, c in enumerate(columns):
        before = 0
        for b, n in sorted((r["b"], r["n"]) for r in counted if r["c"] == i):
            inside = [r for r in wanted[c] if before < r <= before + n]
            low, high = cuts[c][b], cuts[c][b + 1]
            if inside and high == math.nextafter(low, math.inf):
                result.update({(c, r): (low, before) for r in inside})
            elif inside:
                name = f"p{len(parts)}"
                parts[name] = F.when((F.col(f"`{c}`") >= low) & ((F.col(f"`{c}`") < high) | F.lit(high == math.inf)), F.col(f"`{c}`")).alias(name)
                asked[name] = (c, before, inside)
                held.append(n)
            before += n
    if parts:
        names = list(parts)
        deeper = data.select(*parts.values()).where(reduce(lambda a, b: a | b, [F.col(n).isNotNull() for n in names]))
        found = select_ranks(deeper, {n: [r - asked[n][1] for r in asked[n][2]] for n in names}, final_rows, held)
        for (name, rank), (value, below) in found.items():
            c, before, _ = asked[name]
            result[c, rank + before] = (value, below + before)
    return result


def tie_key(column: Column) -> Column:
    """Uniform, engine-independent order for rows that compare equal."""
    return F.md5(column.cast("string").cast("binary"))


def every_nth(df: DataFrame, order: str, key: str, points: int, columns: Sequence[str]) -> DataFrame:
    """Rows 1, 1+s, 1+2s, … of ``df`` ordered by (``order``, md5 of ``key``).

    ``s`` is max(1, rows // points), so fewer than twice ``points`` rows are drawn.
    Returns ``idx`` (0-based) and ``columns``; ``order`` is a number, date or time. Only
    order and key are sorted, in range partitions whose offsets make places of them; the
    rows drawn are then fetched by key, which tells the rows apart (of equal ones, any).
    """
    kind = dict(df.dtypes)[order]
    x = F.col(f"`{order}`")
    if kind.startswith("timestamp"):
        x = F.unix_micros(x.cast("timestamp"))
    elif kind == "date":
        x = F.unix_date(x)
    data = df.select(*_cols(columns), x.cast("double").alias("__x"), F.col(f"`{key}`").alias("__key")).where("__x is not null and not isnan(__x)")
    placed = durable(with_position(data.select("__x", tie_key(F.col("__key")).alias("__t"), "__key"), [F.col("__x"), F.col("__t"), F.col("__key")], "place"))
    rows = placed.count()
    step = max(1, rows // points)
    drawn = placed.where((F.col("place") - 1) % step == 0).select(F.col("__x").alias("__at"), F.col("__key").alias("__of"), (F.col("place") - 1).alias("idx"))
    # Fewer than twice ``points`` rows.
    found = data.join(F.broadcast(drawn), (F.col("__x") == F.col("__at")) & F.col("__key").eqNullSafe(F.col("__of")))
    return found.select("idx", *_cols(columns)).dropDuplicates(["idx"])


def md5_cutoffs(df: DataFrame, label: str, key: str, ranks: Column, per_label: DataFrame | None = None) -> DataFrame:
    """Per label, the (md5, key) of the rows at 1-based ``ranks`` in md5 order.

    ``ranks`` is an array expression over ``n`` (rows of the label) and the columns of
    ``per_label``. md5 is uniform, so its first hex digits cut every label, however
    large, into even buckets, and only the buckets that hold a rank are sorted.
    """
    labelled = df.where(F.col(f"`{label}`").isNotNull())
    # So many hex digits that a bucket stays small even if one label has all rows.
    digits = max(4, math.ceil(math.log(max(labelled.count(), 1) / MD5_BUCKET + 1, 16)))
    rows = labelled.select(F.col(f"`{label}`").alias("label"), tie_key(F.col(f"`{key}`")).alias("__t"),
                           F.col(f"`{key}`").alias("__k")).withColumn("bucket", F.substring("__t", 1, digits))
    counts = rows.groupBy("label", "bucket").agg(F.count(F.lit(1)).alias("size"))
    whole = W.partitionBy("label").orderBy("bucket")
    placed = counts.withColumns({
        "upto": F.sum("size").over(whole.rowsBetween(W.unboundedPreceding, W.currentRow)),
        "n": F.sum("size").over(whole.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))})
    carried = []
    if per_label is not None:
        placed = placed.join(per_label, "label")
        carried = [c for c in per_label.columns if c != "label"]
    wanted = (placed.withColumn("pair", F.explode(F.arrays_zip(
        F.sequence(F.lit(1), F.size(ranks)).alias("i"), ranks.alias("rank"))))
        .where("pair.rank > upto - size and pair.rank <= upto")
        .select("label", "bucket", "n", "pair.i", *carried, (F.col("pair.rank") - F.col("upto") + F.col("size")).alias("local")))
    targets = lookup(wanted.select("label", "bucket").distinct())  # a bucket per label and rank: counted, so rows stay where they are
    # Rows with the same key are collapsed, so a key with very many copies is one row here.
    inside = rows.join(targets, ["label", "bucket"], "left_semi").groupBy("label", "bucket", "__t", "__k").agg(F.count(F.lit(1)).alias("cnt"))
    order = W.partitionBy("label", "bucket").orderBy("__t", "__k").rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = inside.withColumn("last", F.sum("cnt").over(order))
    return (ranked.join(wanted, ["label", "bucket"]).where("local > last - cnt and local <= last")
            .select("label", "n", "i", *carried, F.struct("__t", "__k").alias("cut")))


def with_position(df: DataFrame, order: Sequence[Column], name: str = "position") -> DataFrame:
    """Every row's place (from 1) in an order without ties; range partitions are sorted in parallel, offsets added."""
    ranged = durable(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    sizes = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__size"))
    offsets = sizes.select("__part", (F.sum("__size").over(W.orderBy("__part")) - F.col("__size")).alias("__before"))  # one row a part
    local = F.row_number().over(W.partitionBy("__part").orderBy(*order))
    return ranged.withColumn("__local", local).join(offsets, "__part").select(*_cols(df.columns), (F.col("__before") + F.col("__local")).cast("bigint").alias(name))


def dense_ids(distinct: DataFrame, column: str) -> DataFrame:
    """0-based position of each value of ``column`` in sorted order.

    ``distinct`` holds every value once. Range partitions are sorted in parallel;
    only one offset per partition is computed centrally.
    """
    ranged = durable(distinct.select(F.col(f"`{column}`").alias("value"))
                     .repartitionByRange("value").withColumn("part", F.spark_partition_id()))
    sizes = ranged.groupBy("part").agg(F.count("*").alias("size"))
    offsets = sizes.select("part", (F.sum("size").over(W.orderBy("part")) - F.col("size")).alias("offset"))
    local = F.row_number().over(W.partitionBy("part").orderBy("value"))
    return (ranged.withColumn("local", local).join(offsets, "part")
            .select("value", (F.col("offset") + F.col("local") - 1).cast("bigint").alias("code")))
