"""Oversampling rare classes between exact nearest neighbours.

Points are grouped around pivots, sorted by their distance from the pivot and cut into
blocks of at most ``BLOCK``: a block is a ring of one pivot's cell. A block first meets
itself, which bounds the distance of each point's k-th neighbour and tells which other
blocks may hold closer ones. Neighbouring blocks ask together: every block that one of a
group's points needs is sent to the group once, closest first, and each point compares
itself only while its tightening bound admits the ring. So what is moved is a few times
the table, however many rings a point admits; only the comparing grows with the square of
a class where nothing can be ruled out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tabscout.functions.text import ref
from tabscout.plans.durable import durable, lookup, scratch_path
from tabscout.plans.orderstats import md5_cutoffs, tie_key

MOST_PIVOTS = 2048
BLOCK = 2048
SEVERE_RATIO = 3
NEIGHBOURS = 5
#: Points that ask together: at least, unless the class is smaller, and at most.
FEWEST_ASKING, MOST_ASKING = 256, 1 << 16
#: Groups of a label that ask, and so copies of its blocks, at most; more only where groups would exceed MOST_ASKING.
GROUPS = 8
#: Distances that a task holds at a time.
TILE = 1 << 18
#: Points that a task sorts into blocks.
PACKED = 1 << 16


def _distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    return np.stack([np.sqrt(((x - p) ** 2).sum(axis=1)) for p in points], axis=1)


def _closest(d: np.ndarray, inner, outer) -> np.ndarray:
    """How close a ring comes to points at distance ``d`` from its pivot, less what rounding may add."""
    return np.maximum(np.maximum(d - outer, inner - d) - 1e-11 * (d + outer), 0)


def _admits(near: np.ndarray, bound: np.ndarray) -> np.ndarray:
    return near <= bound * (1 + 1e-9) + 1e-9


def _finite(vec: str) -> Column:
    return F.coalesce(F.forall(vec, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))


def _compact(x: np.ndarray) -> np.ndarray:
    """Vectors as floats where these hold them."""
    with np.errstate(over="ignore"):
        short = x.astype(np.float32)
    return short if (short == x).all() else x


def _vectors(packed: list[bytes], dim: int) -> np.ndarray:
    kinds = {len(v) == 8 * dim for v in packed}
    if len(kinds) > 1:
        return np.stack([np.frombuffer(v, np.float64 if len(v) == 8 * dim else np.float32).astype(np.float64) for v in packed])
    return np.frombuffer(b"".join(packed), np.float64 if kinds == {True} else np.float32).reshape(len(packed), dim).astype(np.float64)


BLOCKS = "label string, cell int, n int, dim int, inner double, outer double, pids array<string>, vecs binary"


def _pack(block: int):
    """Sorted points as blocks, a row each: points of one cell, in order of distance from its pivot."""
    kinds = pa.schema([("label", pa.string()), ("cell", pa.int32()), ("n", pa.int32()), ("dim", pa.int32()), ("inner", pa.float64()),
                       ("outer", pa.float64()), ("pids", pa.list_(pa.string())), ("vecs", pa.binary())])

    def row(at: tuple, held: list) -> pa.RecordBatch:
        pids, x, dist = (np.concatenate(c) for c in zip(*held))
        values = [at[0], at[1], len(x), x.shape[1], dist.min(), dist.max(), pids.tolist(), _compact(x).tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, kinds)], schema=kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, at = [], 0, None
        for batch in batches:
            labels, cells = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("label", "cell"))
            if not len(labels):
                continue
            dims = batch.column("dim").to_numpy()
            if (dims != dims[0]).any():
                raise ValueError("vectors of different lengths")
            points = batch.column("pid").to_numpy(zero_copy_only=False), _vectors(batch.column("vec").to_pylist(), int(dims[0])), batch.column("dist").to_numpy()
            edges = [0, *(np.flatnonzero((labels[1:] != labels[:-1]) | (cells[1:] != cells[:-1])) + 1).tolist(), len(labels)]
            for start, end in zip(edges[:-1], edges[1:]):
                if at != (labels[start], cells[start]):
                    if held:
                        yield row(at, held)
                    held, size, at = [], 0, (labels[start], cells[start])
                while start < end:
                    taken = min(block - size, end - start)
                    held.append([c[start : start + taken] for c in points])
                    start, size = start + taken, size + taken
                    if size == block:
                        yield row(at, held)
                        held, size = [], 0
        if held:
            yield row(at, held)

    return run


class _Block:
    """A block as tasks read it."""

    def __init__(self, row: dict):
        self.number, self.cell, self.inner, self.outer = row["number"], row["cell"], row["inner"], row["outer"]
        self.pids = np.array(row["pids"], dtype=object)
        kind = np.float64 if len(row["vecs"]) == 8 * row["n"] * row["dim"] else np.float32
        self.x = np.frombuffer(row["vecs"], kind).reshape(row["n"], row["dim"]).astype(np.float64)
        self.bounds = None if row.get("bounds") is None else np.frombuffer(row["bounds"], np.float64)


class _Asking:
    """Points that ask, and the ``k`` nearest of what they have met."""

    def __init__(self, x: np.ndarray, pids: np.ndarray, bound: np.ndarray, k: int):
        self.x, self.pids, self.bound, self.k = x, pids, bound.copy(), k
        self.found = [np.zeros(0, np.int64), np.zeros(0), np.zeros(0, object), np.zeros(0, np.int64), np.zeros(0, np.int64)]  # asking point, distance, other, its block and place
        self.waiting: list[list[np.ndarray]] = []
        self.many = 0

    def meet(self, other: _Block, asking: np.ndarray) -> None:
        """The points ``asking`` meet a block. A matrix product rules out most of it; the others get their distance component by component."""
        k, y, ids = self.k, other.x, other.pids
        own = int(pd.Series(ids).value_counts(dropna=False).iloc[0])  # points of one id do not meet: so many places may be lost
        # Copies lie together, in order of their ids: the first ones stand for all.
        new = np.concatenate([[True], (y[1:] != y[:-1]).any(axis=1)])
        run = np.arange(len(y)) - np.maximum.accumulate(np.where(new, np.arange(len(y)), 0))
        kept = np.flatnonzero(run < k + own)
        y, ids = y[kept], ids[kept]
        n, short = y.shape[1], np.finfo(np.float32)
        with np.errstate(over="ignore", under="ignore", invalid="ignore"):
            # |x|^2 + |y|^2 - 2xy in one product of floats; what overflows is ruled out by nothing.
            centre = y.mean(axis=0)
            yc = (y - centre).astype(np.float32)
            yy = (yc**2).sum(axis=1)
            right = np.column_stack([yc, np.ones(len(y), np.float32), yy]).T.copy()
            step = max(1, TILE // len(y))
            for a in range(0, len(asking), step):
                at = asking[a : a + step]
                xc = (self.x[at] - centre).astype(np.float32)
                xx = (xc**2).sum(axis=1)
                rough = np.column_stack([-2 * xc, xx, np.ones(len(at), np.float32)]) @ right
                error = 16 * (n + 8) * (short.eps * (xx + yy.max()).astype(float) + short.tiny)  # of the squares
                far = rough > (self.bound[at] ** 2 + error).astype(np.float32)[:, None]
                close = np.flatnonzero(~far)
                i = close // len(y)
                loose = np.flatnonzero(np.bincount(i, minlength=len(at)) > 2 * (k + own))
                if len(loose) and len(y) > k + own:
                    some = rough[loose]
                    kth = np.partition(some, k + own - 1, axis=1)[:, k + own - 1]
                    far[loose] |= some > (kth + 2 * error[loose]).astype(np.float32)[:, None]
                    close = np.flatnonzero(~far)
                    i = close // len(y)
                j, most = close % len(y), max(1, 4 * TILE // max(n, 1))
                for b in range(0, len(i), most):
                    self._measure(at[i[b : b + most]], j[b : b + most], y, ids, kept, other.number)

    def _measure(self, q: np.ndarray, j: np.ndarray, y: np.ndarray, ids: np.ndarray, places: np.ndarray, number: int) -> None:
        d = np.sqrt(((self.x[q] - y[j]) ** 2).sum(axis=1))
        able = np.flatnonzero(np.isfinite(d) & (d <= self.bound[q]) & (self.pids[q] != ids[j]))
        if len(able):
            q, j = q[able], j[able]
            self.waiting.append([q, d[able], ids[j], np.full(len(q), number), places[j]])
            self.many += len(q)
            if self.many > max(4096, self.k * len(self.x) // 2):
                self.settle()

    def settle(self) -> None:
        """Keep the k nearest of each point; ties go to the smaller id."""
        if not self.waiting:
            return
        q, d, ids, number, place = (np.concatenate(c) for c in zip(self.found, *self.waiting))
        order = np.lexsort((d, q))
        if ((q[order][1:] == q[order][:-1]) & (d[order][1:] == d[order][:-1])).any():
            order = pd.DataFrame({"q": q, "d": d, "id": ids}).sort_values(["q", "d", "id"], na_position="first").index.to_numpy()
        q, d, ids, number, place = (c[order] for c in (q, d, ids, number, place))
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        last = rank == self.k - 1
        self.bound[q[last]] = np.minimum(self.bound[q[last]], d[last])
        self.found, self.waiting, self.many = [c[rank < self.k] for c in (q, d, ids, number, place)], [], 0


def _reach(k: int, centres: np.ndarray):
    """What a block knows of its neighbours from itself: a bound for each point, and the blocks that these admit with how close they come."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in range(batch.num_rows):
                part = batch.slice(one, 1)
                block = _Block(part.drop_columns(["heads"]).to_pylist()[0])
                asking = _Asking(block.x, block.pids, np.full(len(block.x), np.inf), k)
                asking.meet(block, np.arange(len(block.x)))
                asking.settle()
                numbers, cells, inner, outer = (part.column("heads").flatten().field(c).to_numpy() for c in ("number", "cell", "inner", "outer"))
                used, of = np.unique(cells, return_inverse=True)
                least = np.full(len(numbers), np.inf)
                step = max(1, TILE // max(len(numbers), 1))
                for a in range(0, len(block.x), step):
                    d = _distances(block.x[a : a + step], centres[used])[:, of]
                    near = _closest(d, inner, outer)
                    least = np.minimum(least, np.where(_admits(near, asking.bound[a : a + step, None]), near, np.inf).min(axis=0))
                able = np.flatnonzero(np.isfinite(least))
                met = [{"target": int(numbers[i]), "near": float(least[i])} for i in able.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array([block.number]), pa.array([asking.bound.tobytes()], pa.binary()),
                                                  pa.array([met], pa.list_(pa.struct([("target", pa.int64()), ("near", pa.float64())])))], names=["number", "bounds", "met"])

    return run


FOUND = "label string, pid string, other string, distance double, block bigint, place int"
MET = "label string, pid string, block bigint"


def _searching(k: int, centres: np.ndarray, pairs: bool = False):
    """Asking blocks, then the blocks they meet, of each group in turn; the ``k`` nearest of every asking point, or who met what."""
    def told(label: str, asking: _Asking) -> Iterator[pa.RecordBatch]:
        asking.settle()
        q, d, ids, number, place = asking.found
        for a in range(0, len(q), 10_000):
            s = slice(a, a + 10_000)
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(q[s]), pa.string()), pa.array(asking.pids[q[s]], pa.string()), pa.array(ids[s], pa.string()),
                                              pa.array(d[s]), pa.array(number[s]), pa.array(place[s].astype(np.int32))], names=["label", "pid", "other", "distance", "block", "place"])

    def visit(label: str, asking: _Asking, block: _Block) -> Iterator[pa.RecordBatch]:
        d = _distances(asking.x, centres[block.cell : block.cell + 1])[:, 0]
        at = np.flatnonzero(_admits(_closest(d, block.inner, block.outer), asking.bound))
        if len(at):
            asking.meet(block, at)
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array([label] * len(at), pa.string()), pa.array(asking.pids[at], pa.string()),
                                                  pa.array(np.full(len(at), block.number))], names=["label", "pid", "block"])

    def begun(blocks: list[_Block]) -> _Asking:
        asking = _Asking(*(np.concatenate([getattr(b, c) for b in blocks]) for c in ("x", "pids", "bounds")), k)
        for block, end in zip(blocks, np.cumsum([len(b.x) for b in blocks])):
            block.x = asking.x[end - len(block.x) : end]
        return asking

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, blocks, asking = None, [], None

        def met() -> Iterator[pa.RecordBatch]:
            """The group's own blocks meet first."""
            nonlocal blocks, asking
            if blocks:
                own, blocks, asking = blocks, [], begun(blocks)
                for one in own:
                    yield from visit(group[0], asking, one)

        def ended() -> Iterator[pa.RecordBatch]:
            yield from met()
            if asking and not pairs:
                yield from told(group[0], asking)

        for batch in batches:
            for one in range(batch.num_rows):
                row = batch.slice(one, 1).to_pylist()[0]
                if (row["label"], row["part"]) != group:
                    yield from ended()
                    group, blocks, asking = (row["label"], row["part"]), [], None
                block = _Block(row)
                if block.bounds is not None:
                    blocks.append(block)
                else:
                    yield from met()
                    yield from visit(group[0], asking, block)
        yield from ended()

    return run


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for one in range(batch.num_rows):
            block = _Block(batch.slice(one, 1).to_pylist()[0])
            ends = np.arange(len(block.x) + 1, dtype=np.int32) * block.x.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(block.x), block.number)), pa.array(np.arange(len(block.x), dtype=np.int32)),
                                              pa.ListArray.from_arrays(pa.array(ends), pa.array(block.x.ravel()))], names=["block", "place", "vec"])


def nearest(points: DataFrame, k: int, pivots: int | None = None, block: int = BLOCK, met: list | None = None) -> DataFrame:
    """The ``k`` nearest other points of the same label, exactly.

    ``points`` has label, pid and vec, with distinct (label, pid) and distinct vectors
    per label. Returns label, pid, rank, other, distance, vec (of the other point).
    Points without a label or with a vector that is not finite have no neighbours and are none.
    ``pivots`` None takes about one for a block of each label.
    ``met``, if a list, gets the DataFrame of (asking row, block) pairs that were looked at.
    """
    spark = points.sparkSession
    points = points.select(F.col("label").cast("string").alias("label"), "pid", F.col("vec").cast("array<double>").alias("vec")).where(F.col("label").isNotNull() & _finite("vec"))
    sizes = lookup(points.groupBy("label").agg(F.count(F.lit(1)).alias("m")))
    total, largest, work = sizes.agg(F.sum("m"), F.max("m"), F.sum(F.col("m").cast("double") * F.col("m"))).first()
    if not total:
        return points.select("label", "pid", F.lit(0).alias("rank"), F.col("pid").alias("other"), F.lit(0.0).alias("distance"), "vec")
    most = min(MOST_PIVOTS, -(-largest // block)) if pivots is None else pivots
    centres = np.array([r["vec"] for r in points.orderBy(tie_key(F.col("pid")), "label").limit(most).collect()])  # MOST_PIVOTS at most
    # A small label uses the first few pivots only, so that it is not cut into crumbs.
    cells = F.least(F.lit(len(centres)), F.ceil(F.col("m") / block)) if pivots is None else F.lit(len(centres))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            d = _distances(np.stack(pdf["vec"].to_numpy()), centres)
            d[np.arange(len(centres)) >= pdf["cells"].to_numpy()[:, None]] = np.inf
            cell = d.argmin(axis=1)
            vec = [_compact(v).tobytes() for v in pdf["vec"]]
            yield pdf.drop(columns="cells").assign(vec=vec, dim=[len(v) for v in pdf["vec"]], cell=cell, dist=d[np.arange(len(cell)), cell])

    wide = points.join(sizes.select("label", cells.cast("int").alias("cells")), "label").select("label", "pid", "vec", "cells")
    placed = durable(wide.mapInPandas(assign, "label string, pid string, vec binary, dim int, cell int, dist double"))
    cores = spark.sparkContext.defaultParallelism
    order = ["label", "cell", "dist", "pid"]
    sorted_ = placed.repartitionByRange(max(-(-total // PACKED), min(cores, -(-total // (4 * block)))), *order).sortWithinPartitions(*order)
    path = scratch_path(spark, "blocks")
    sorted_.mapInArrow(_pack(block), BLOCKS).withColumn("number", F.monotonically_increasing_id()).write.parquet(path)
    blocks = spark.read.parquet(path)

    # Blocks that follow each other ask together: about two groups a core, by each label's share of the pairs.
    heads = lookup(blocks.select("label", "number", "n", "cell", "inner", "outer"))
    ahead = F.coalesce(F.sum("n").over(W.partitionBy("label").orderBy("number").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    share = F.least(F.lit(GROUPS), F.greatest(F.lit(1), F.round(2 * cores * F.col("m").cast("double") * F.col("m") / work)))
    asking = F.least(F.lit(MOST_ASKING), F.greatest(F.lit(FEWEST_ASKING), F.ceil(F.col("m") / share)))
    groups = lookup(heads.join(sizes, "label").select("label", "number", F.floor(ahead / asking).cast("int").alias("part")))
    count = groups.select("label", "part").distinct().count()
    every = lookup(heads.groupBy("label").agg(F.collect_list(F.struct("number", "cell", "inner", "outer")).alias("heads")))  # a few numbers a block
    reached = durable(blocks.join(every, "label").select(*blocks.columns, "heads").mapInArrow(_reach(k, centres), "number bigint, bounds binary, met array<struct<target:bigint,near:double>>"))
    home = groups.select(F.col("number").alias("target"), F.col("part").alias("home"))
    wanted = (reached.select("number", F.inline("met")).join(groups, "number").join(home, "target").where("part <> home")
              .groupBy("target", "part").agg(F.min("near").alias("near"))
              .groupBy(F.col("target").alias("number")).agg(F.collect_list(F.struct("part", "near")).alias("to")))  # an entry a group of the label at most
    shown = ["label", "part", "near", "number", "cell", "n", "dim", "inner", "outer", "pids", "vecs", "bounds"]
    own = blocks.join(lookup(reached.select("number", "bounds").join(groups.select("number", "part"), "number")), "number").withColumn("near", F.lit(-1.0)).select(*shown)
    sent = blocks.join(lookup(wanted), "number").select(*blocks.columns, F.inline("to"), F.lit(None).cast("binary").alias("bounds")).select(*shown)
    dealt = own.unionByName(sent).repartition(min(4 * count, 1 << 12), "label", "part").sortWithinPartitions("label", "part", "near", "number")
    if met is not None:
        met.append(dealt.mapInArrow(_searching(k, centres, True), MET))
    found = dealt.mapInArrow(_searching(k, centres), FOUND)
    first = W.partitionBy("label", "pid").orderBy("distance", "other")
    best = found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
    return best.join(blocks.mapInArrow(_unpack, "block bigint, place int, vec array<double>"), ["block", "place"]).select("label", "pid", "rank", "other", "distance", "vec")


def smote(df: DataFrame, vec: str, target: str, key: str, k: int | None = None, seed: int = 42) -> DataFrame:
    """Rows of ``df`` plus synthetic rows that bring every class up to the largest one.

    Returns target, vec, key (null on synthetic rows) and ``synthetic``. Each row of a
    smaller class is used equally often, but for rows whose vector is null or not finite, which
    are kept and give none; neighbours and positions follow the md5 of the key.
    """
    rows = df.where(ref(target).isNotNull()).select(ref(target).alias("label"), ref(key).alias("key"), ref(vec).cast("array<double>").alias("vec"))
    sizes = durable(rows.groupBy("label").agg(F.count(F.lit(1)).alias("m"), F.count_if(_finite("vec")).alias("able")))
    largest = sizes.agg(F.max("m").alias("m")).scalar()
    if k is None:
        first = sizes.orderBy("label").limit(1).first()
        k = min(NEIGHBOURS, max(1, (first["m"] if first else 2) - 1))
    need = lookup(sizes.withColumn("extra", largest - F.col("m")).where("extra > 0 and able > 0")
                  .select("label", "m", F.floor(F.col("extra") / F.col("able")).alias("each"), (F.col("extra") % F.col("able")).alias("left")))
    small = rows.where(_finite("vec")).join(need, "label")
    vectors = small.withColumn("pid", F.md5(F.to_json(F.struct("vec")).cast("binary")))
    distinct = vectors.groupBy("label", "pid").agg(F.first("vec").alias("vec"), F.count(F.lit(1)).alias("copies"))
    found = nearest(distinct.select("label", "pid", "vec"), k)
    copies = distinct.select(F.col("label").cast("string").alias("label"), F.col("pid").alias("other"), F.col("copies").alias("other_copies"))
    lists = (found.join(copies, ["label", "other"]).groupBy("label", "pid")
             .agg(F.array_sort(F.collect_list(F.struct("rank", "other_copies", F.col("vec").alias("v")))).alias("near")))
    mine = distinct.select(F.col("label").cast("string").alias("label"), "pid", "copies").join(lists, ["label", "pid"], "left")
    # Copies of a row are its nearest neighbours, at distance zero.
    near = F.slice(F.concat(
        F.array_repeat(F.col("vec"), F.least(F.col("copies") - 1, F.lit(k)).cast("int")),
        F.flatten(F.transform(F.coalesce("near", F.array().cast("array<struct<rank:int,other_copies:bigint,v:array<double>>>")),
                              lambda n: F.array_repeat(n["v"], F.least(n["other_copies"], F.lit(k)).cast("int"))))), 1, k)
    extra = _times(vectors, need)
    drawn = (extra.withColumn("text", F.col("label").cast("string")).alias("r")
             .join(mine.withColumnRenamed("label", "text").alias("m"), ["text", "pid"])
             .withColumn("near", near).where("size(near) > 0 and times > 0")
             .withColumn("j", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))))
    def draw(salt: int) -> Column:
        """A whole number below 2 ** 60 from the key, the turn and a salt; by md5, so that any engine gets the same."""
        text = F.concat_ws(":", F.col("key").cast("string"), F.col("j").cast("string"), F.lit(str(salt)))
        return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("bigint")
    pick = F.element_at("near", (draw(seed) % F.size("near") + 1).cast("int"))
    step = draw(seed + 1) % F.lit(1 << 31) / float(1 << 31)
    made = drawn.withColumns({"other": pick, "step": step}).select(
        "label", F.lit(None).cast(dict(rows.dtypes)["key"]).alias("key"),
        F.expr("zip_with(vec, other, (a, b) -> a + step * (b - a))").alias("vec"), F.lit(True).alias("synthetic"))
    every = rows.withColumn("synthetic", F.lit(False)).unionByName(made)
    return every.select(F.col("label").alias(target), F.col("vec").alias(vec), F.col("key").alias(key), "synthetic")


def _times(rows: DataFrame, need: DataFrame) -> DataFrame:
    """Add ``times``, the synthetic rows each row gives: ``each``, and one more for the
    first ``left`` rows of the class in md5 order of the key."""
    cut = md5_cutoffs(rows, "label", "key", F.array("left"), need.select("label", "left")).select("label", "cut")
    here = F.struct(tie_key(F.col("key")).alias("__t"), F.col("key").alias("__k"))
    return (rows.join(cut, "label", "left")
            .withColumn("times", F.col("each") + F.when(here <= F.col("cut"), 1).otherwise(0)).drop("cut"))


def is_severe(ratio: float | None) -> bool:
    return ratio is not None and ratio > SEVERE_RATIO
