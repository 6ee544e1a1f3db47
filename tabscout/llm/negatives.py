"""Hard negatives of anchors by an R-tree over integer vectors.

Vectors are dealt by label and first component, and each task packs its share by the
sort-tile-recursive rule: sorted into slabs by one component after the other until a tile
fits a leaf. Leaves hold one label. A tree has up to ``TREE`` vectors, and every node a
bounding box. A box bounds the inner product with an anchor component by component.

Two searches follow: for each anchor its nearest rows of the same label, then for each of
these the best rows of other labels within its window of scores. Blocks of anchors meet
every tree. Within a tree, a queue takes the node with the highest bound first; nodes whose
interval lies outside every window or strictly below the k-th score so far are dropped for
those queries. A task that sees several trees keeps k rows a query, so that what it returns
does not grow with the table.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tabscout.llm.common import partitions, stored
from tabscout.llm.vectors import scaled

#: Vectors of a leaf, children of an inner node, vectors of a tree.
LEAF, FAN, TREE = 128, 8, 4096
#: Anchors that meet a tree together.
ASKING = 4096
#: Vectors that a task packs.
PACKED = 1 << 18
#: Stands for a null id: it comes after all others.
LAST_ID = 2**63 - 1
LOWEST = -(2**62)
TREES = "tree bigint, dim int, ids binary, labels binary, asks binary, codes binary, leaves binary"


@dataclass(frozen=True)
class Params:
    """A negative's score is between ``low`` and ``high`` percent of its positive's."""

    positives: int = 5
    negatives: int = 10
    low: int = 30
    high: int = 90
    scale: int = 256


def tiles(codes: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
    """``rows`` of ``codes`` packed into leaves: slabs by the component of largest spread, then within each by the next."""
    spread = np.ptp(codes[rows], axis=0) if codes.shape[1] else np.zeros(0)
    axes = np.argsort(-spread, kind="stable")

    def cut(part: np.ndarray, depth: int) -> list[np.ndarray]:
        pages = -(-len(part) // LEAF)
        if pages <= 1 or depth >= len(axes):
            return [part[i : i + LEAF] for i in range(0, len(part), LEAF)]
        left = min(len(axes) - depth, max(1, math.ceil(math.log2(pages))))
        slabs = math.ceil(pages ** (1 / left) - 1e-9)
        size = -(-pages // slabs) * LEAF  # whole leaves, so that all but the last are full
        ordered = part[np.argsort(codes[part, axes[depth]], kind="stable")]
        return [t for i in range(0, len(part), size) for t in cut(ordered[i : i + size], depth + 1)]

    return cut(rows, 0)


def _pack(p: Params):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[list[np.ndarray]]] = {}  # by number of components: only vectors of one length meet
        count = 0

        def trees() -> Iterator[pa.RecordBatch]:
            for d, parts in sorted(held.items()):
                ids, labels, asks, codes = (np.concatenate(c) for c in zip(*parts))
                packed = [t for one in np.unique(labels) for t in tiles(codes, np.flatnonzero(labels == one))]
                for start in range(0, len(packed), TREE // LEAF):
                    some = packed[start : start + TREE // LEAF]
                    at = np.concatenate(some)
                    values = [ids[at], labels[at], asks[at].astype(np.int8), codes[at], np.cumsum([len(t) for t in some])]
                    yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([d], pa.int32()), *[pa.array([v.tobytes()], pa.binary()) for v in values]],
                                                     names=["tree", "dim", "ids", "labels", "asks", "codes", "leaves"])

        for batch in batches:
            for d, (kept, codes) in scaled(batch.column(3), p.scale).items():
                part = batch.take(pa.array(kept))
                held.setdefault(d, []).append([*(part.column(i).to_numpy(zero_copy_only=False) for i in range(3)), codes])
                count += len(kept)
            if count >= PACKED:
                yield from trees()
                held, count = {}, 0
        if count:
            yield from trees()

    return run


def pack(points: DataFrame, is_anchor: Column, p: Params, id_: str, vector: str, label: str) -> DataFrame:
    """The trees of all usable rows, stored; one row each, numbered by ``tree``."""
    rows = points.where(F.col(label).isNotNull() & F.col(vector).isNotNull()).select(
        F.coalesce(F.col(id_).cast("bigint"), F.lit(LAST_ID)).alias("id"), F.col(label).cast("bigint").alias("label"),
        F.coalesce(is_anchor, F.lit(False)).alias("asks"), F.col(vector).cast("array<double>").alias("v"))
    n = rows.count()
    parts = max(1, -(-n // PACKED), min(partitions(points), -(-n // TREE)))
    # Ids and row numbers split equal vectors.
    salted = rows.withColumn("salt", F.monotonically_increasing_id())
    dealt = salted.repartitionByRange(parts, "label", F.get("v", F.lit(0)), F.xxhash64("id"), "salt").drop("salt") if n else rows
    number = F.monotonically_increasing_id()
    packed = dealt.mapInArrow(_pack(p), TREES).withColumn("tree", F.shiftright(number, 33) * (1 << 20) + number.bitwiseAND((1 << 33) - 1))  # the partition, and the tree in it
    return stored(packed, "trees")


class Tree:
    """A stored tree with the boxes of its nodes, leaves first, the root last."""

    def __init__(self, row: dict):
        self.ids, self.labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
        self.asks = np.frombuffer(row["asks"], np.int8)
        self.codes = np.frombuffer(row["codes"], np.int64).reshape(len(self.ids), row["dim"])
        self.number = row["tree"]
        ends = np.frombuffer(row["leaves"], np.int64)
        self.starts, self.ends = np.concatenate([[0], ends[:-1]]), ends
        lo, hi = np.minimum.reduceat(self.codes, self.starts, axis=0), np.maximum.reduceat(self.codes, self.starts, axis=0)
        los, his, self.children = [lo], [hi], [None] * len(ends)
        first = 0
        while len(los[-1]) > 1:
            at = np.arange(0, len(los[-1]), FAN)
            self.children += [range(first + i, first + min(i + FAN, len(los[-1]))) for i in at.tolist()]
            first += len(los[-1])
            los.append(np.minimum.reduceat(los[-1], at, axis=0))
            his.append(np.maximum.reduceat(his[-1], at, axis=0))
        self.lo, self.hi = np.concatenate(los), np.concatenate(his)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact a @ b.T: in doubles where these hold it."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64) if most < 2.0**52 else a @ b.T


class Search:
    """The best rows so far of a block of anchors' queries."""

    def __init__(self, codes: np.ndarray, labels: np.ndarray, own: np.ndarray, of: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool):
        """``own``: each anchor's row, which does not meet itself; ``of``: each query's anchor, with its window."""
        self.codes, self.labels, self.own, self.of, self.low, self.high, self.k, self.same = codes, labels, own, of, low, high, k, same
        self.above, self.below = np.maximum(codes, 0), np.minimum(codes, 0)
        self.least = low.copy()  # the k-th score so far, or the window's end
        self.found = [np.zeros(0, np.int64)] * 3  # query, score, id
        self.waiting: list[tuple[np.ndarray, ...]] = []
        self.many = 0
        self.scored = 0  # inner products with rows, for tests

    def visit(self, tree: Tree) -> None:
        if tree.codes.shape[1] != self.codes.shape[1]:
            return
        top = product(self.above, tree.hi) + product(self.below, tree.lo)
        bottom = product(self.above, tree.lo) + product(self.below, tree.hi)

        def live(node: int) -> np.ndarray:
            if self.same is not None and tree.children[node] is None:
                fits = (self.labels == tree.labels[tree.starts[node]]) == self.same
                able = fits[self.of]
            else:
                able = True
            return np.flatnonzero(able & (top[self.of, node] >= self.least) & (bottom[self.of, node] <= self.high))

        queue: list[tuple[int, int]] = []

        def push(node: int) -> None:
            asking = live(node)
            if len(asking):
                heapq.heappush(queue, (-int(top[self.of[asking], node].max()), node))

        push(len(tree.children) - 1)
        while queue:
            _, node = heapq.heappop(queue)
            asking = live(node)
            if len(asking) and tree.children[node] is None:
                self._leaf(tree, node, asking)
            elif len(asking):
                for child in tree.children[node]:
                    push(child)

    def _leaf(self, tree: Tree, node: int, asking: np.ndarray) -> None:
        rows = slice(tree.starts[node], tree.ends[node])
        anchors, at = np.unique(self.of[asking], return_inverse=True)
        scores = product(self.codes[anchors], tree.codes[rows])
        self.scored += scores.size
        if self.same:
            own = np.searchsorted(anchors, np.flatnonzero(self.own // TREE == tree.number))
            for a in np.unique(own[own < len(anchors)]).tolist():
                place = self.own[anchors[a]] - tree.number * TREE - tree.starts[node]
                if 0 <= place < scores.shape[1]:
                    scores[a, place] = LOWEST - 1
        wide = scores[at]
        q, r = np.nonzero((wide >= self.least[asking, None]) & (wide <= self.high[asking, None]))
        if len(q):
            self.waiting.append((asking[q], wide[q, r], tree.ids[rows][r]))
            self.many += len(q)
            if self.many > max(4096, self.k * len(self.of) // 2):
                self.settle()

    def settle(self) -> None:
        """Keep the k best rows of each query."""
        if self.waiting:
            q, s, i = (np.concatenate([f, *w]) for f, w in zip(self.found, zip(*self.waiting)))
            order = np.lexsort((i, -s, q))
            q, s, i = q[order], s[order], i[order]
            first = np.searchsorted(q, q)
            place = np.arange(len(q)) - first
            last = place == self.k - 1
            self.least[q[last]] = np.maximum(self.least[q[last]], s[last])
            kept = place < self.k
            self.found, self.waiting, self.many = [q[kept], s[kept], i[kept]], [], 0


def _searching(p: Params, k: int, same: bool):
    """Anchors, then trees of each group in turn; the k best rows of every query of a group."""
    def block(rows: list[dict]) -> list[tuple[Search, list[dict], list[int]]]:
        out = []
        for d in sorted({r["dim"] for r in rows}):
            some = [r for r in rows if r["dim"] == d]
            codes = np.frombuffer(b"".join(r["codes"] for r in some), np.int64).reshape(len(some), d)
            if same:
                of, low, high = np.arange(len(some)), np.full(len(some), LOWEST), np.full(len(some), -LOWEST)
            else:
                scores = [s for r in some for s in r["scores"]]
                of = np.repeat(np.arange(len(some)), [len(r["scores"]) for r in some])
                low, high = (np.array(x, np.int64) for x in ([-(-p.low * s // 100) for s in scores], [p.high * s // 100 for s in scores]))
            labels, own = (np.array([r[c] for r in some], np.int64) for c in ("label", "row"))
            out.append((Search(codes, labels, own, of, low, high, k, same), some, [j for r in some for j in (range(1) if same else range(len(r["scores"])))]))
        return out

    def told(searches) -> Iterator[pa.RecordBatch]:
        for search, rows, place in searches:
            search.settle()
            q, s, i = search.found
            if len(q):
                of = search.of[q]
                yield pa.RecordBatch.from_arrays([pa.array(np.array([r["row"] for r in rows], np.int64)[of]), pa.array(np.array(place, np.int32)[q]), pa.array(s), pa.array(i)],
                                                 names=["row", "place", "score", "id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, asking, searches = None, [], None
        for batch in batches:
            for one in range(batch.num_rows):
                row = batch.slice(one, 1).to_pylist()[0]
                if row["g"] != group:
                    if searches:
                        yield from told(searches)
                    group, asking, searches = row["g"], [], None
                if row["asks"] is None:
                    asking.append(row)
                else:
                    searches = searches or block(asking)
                    tree = Tree(row)
                    for search, _, _ in searches:
                        search.visit(tree)
        if searches:
            yield from told(searches)

    return run


def best(anchors: DataFrame, trees: DataFrame, p: Params, k: int, same: bool) -> DataFrame:
    """(row, place, score, id): the k best rows of each query of ``anchors``, over all ``trees``."""
    rows = trees.agg(F.sum(F.octet_length("ids") / 8).alias("n")).first()["n"] or 0
    blocks = max(1, -(-anchors.count() // ASKING))
    wanted = partitions(trees)
    # A share has some full trees at least, however small the trees are: each returns k rows a query.
    shares = max(1, min(-(-int(rows) // (4 * TREE)), -(-wanted // blocks)))
    # Every block of anchors meets every share of the trees: the group is (block, share).
    every = lambda n, group: F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), group)).alias("g")
    block, share = F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"), F.pmod(F.xxhash64("tree"), F.lit(shares)).cast("int")
    none = lambda kind: F.lit(None).cast(kind)
    asking = anchors.select(every(shares, lambda i: block * shares + i), F.lit(0).alias("kind"), "row", "label", "dim", "scores",
                            none("bigint").alias("tree"), none("binary").alias("ids"), none("binary").alias("labels"), none("binary").alias("asks"), "codes", none("binary").alias("leaves"))
    met = trees.select(every(blocks, lambda i: i * shares + share), F.lit(1).alias("kind"), F.col("tree").alias("row"), none("bigint").alias("label"), "dim",
                       none("array<bigint>").alias("scores"), "tree", "ids", "labels", "asks", "codes", "leaves")
    dealt = asking.unionByName(met).repartition(min(blocks * shares, 4 * max(wanted, blocks)), "g").sortWithinPartitions("g", "kind", "row")
    found = dealt.mapInArrow(_searching(p, k, same), "row bigint, place int, score bigint, id bigint")
    first = W.partitionBy("row", "place").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)  # at most k rows a share


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for one in range(batch.num_rows):
            tree = Tree(batch.slice(one, 1).to_pylist()[0])
            at = np.flatnonzero(tree.asks)
            yield pa.RecordBatch.from_arrays([pa.array(tree.number * TREE + at), pa.array(tree.ids[at]), pa.array(tree.labels[at]), pa.array(np.full(len(at), tree.codes.shape[1], np.int32)),
                                              pa.array([tree.codes[i].tobytes() for i in at.tolist()], pa.binary())], names=["row", "id", "label", "dim", "codes"])


def hard_negatives(points: DataFrame, is_anchor: Column, p: Params = Params(), id_: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """For each anchor and each of its positives, the best rows of other labels whose score is in the window.

    Returns anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.
    A component x becomes floor(scale * x); a score is the integer inner product with the
    anchor; higher scores come first, then smaller ids. Positives are the first ``positives``
    other rows of the anchor's label (an integer), negatives the first ``negatives`` rows with
    ``low`` * positive_score <= 100 * score <= ``high`` * positive_score.

    Rows with a null label, a null vector or a null or non-finite component take no part,
    nor do those whose scaled components could take a score beyond 2 ** 55. Vectors of
    different lengths do not meet; empty ones score 0. A null id comes after all others and
    stays null. Repeated rows are so many rows: one may be the other's positive. Other columns
    are not looked at. An anchor alone with its label has no rows; an empty table gives none.
    """
    trees = pack(points, is_anchor, p, id_, vector, label)
    anchors = stored(trees.mapInArrow(_anchors, "row bigint, id bigint, label bigint, dim int, codes binary"), "anchors")
    plain = anchors.withColumn("scores", F.lit(None).cast("array<bigint>"))
    near = best(plain, trees, p, p.positives, True).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("rank", "score", "id"))).alias("near"))  # at most ``positives`` each
    asking = stored(anchors.join(near, "row").withColumn("scores", F.col("near.score")), "asking")
    found = best(asking, trees, p, p.negatives, False)
    known = lambda c: F.when(c != LAST_ID, c)
    positive = F.get("near", F.col("place"))
    return (found.withColumnRenamed("id", "negative").join(asking.select("row", "id", "near"), "row")
            .select(known(F.col("id")).alias("anchor_id"), known(positive["id"]).alias("positive_id"), "rank", known(F.col("negative")).alias("negative_id"),
                    positive["score"].alias("positive_score"), F.col("score").alias("negative_score")))
