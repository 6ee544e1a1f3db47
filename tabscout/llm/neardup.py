"""Near-duplicate classes by HyperMinHash registers, banding and exact verification.

Each text's set of word shingles gives one register a bucket: the leading zeros and the next
mantissa bits of its least hash. Bands of registers make candidates; the share of equal
registers, corrected for chance collisions, drops hopeless ones; what is left is confirmed
on the full sets. Texts with equal sets are one class throughout, so copies cost nothing.

Groups are linked without listing all their pairs. First every class of a bucket meets
only the bucket's most connected class. Then, in buckets that still hold several
components, the classes outside the largest meet those of other components, unless the
number of shingles that they share with any class at all rules a link out. Small buckets
list such pairs; the classes of large ones, where pairs would be many, are compared in
blocks of bounded size, which return links only. After that every pair of classes with a
common bucket is confirmed, ruled out, or already connected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tabscout.llm.arrays import U, Words, mixed
from tabscout.llm.common import back, id_of, stored, text_key, text_of, text_slices


@dataclass(frozen=True)
class Params:
    """``percent``: least similarity. With 50 bands of 5, a pair at 0.80 shares none with odds of 3e-9, at 0.85 of 3e-18."""

    words: int = 5
    percent: int = 80
    bands: int = 50
    rows: int = 5
    mantissa: int = 10
    slack: float = 0.16  # an estimate may be so much too low: six standard deviations of 250 registers
    listed: int = 32  # largest bucket whose pairs are listed
    block: int = 512  # classes that a task compares with as many others
    chunk: int = 1 << 20  # links that a task contracts at a time

    @property
    def registers(self) -> int:
        return self.bands * self.rows

    @property
    def collision(self) -> float:
        """The chance that two different least hashes give one register: equal zeros (1/3), equal mantissa."""
        return 2.0**-self.mantissa / 3


def shingles(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes and their texts, ordered by text and hash; A-Z lower-cased, a shorter text is one shingle."""
    w = Words.of(texts, lower=True)
    keys, at = w.grams(words)
    doc = w.doc[at]
    counts = np.diff(w.first)
    for short in range(1, words):
        whole = np.flatnonzero(counts == short)
        if len(whole):
            rolled = np.zeros(len(whole), U)
            for i in range(short):
                rolled = mixed(rolled + w.hashes[w.first[whole] + i])
            keys, doc = np.concatenate([keys, rolled + U(short)]), np.concatenate([doc, whole])
    order = np.lexsort((keys, doc))
    keys, doc = keys[order], doc[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])
    return keys[new], doc[new]


def registers(keys: np.ndarray, doc: np.ndarray, n: int, p: Params) -> np.ndarray:
    """HyperMinHash registers of each of ``n`` sets, one row each; empty buckets borrow from others by a fixed probing."""
    k = p.registers
    least = np.full(n * k, ~U(0), U)
    np.minimum.at(least, doc * k + ((keys >> U(20)) % U(k)).astype(np.int64), mixed(keys ^ U(0xA5A5A5A5DEADBEEF)) >> U(1))
    full = least != ~U(0)
    zeros = 64 - np.frexp((least >> U(11)).astype(np.float64))[1].astype(np.int64) - 11
    zeros = np.clip(zeros, 0, 52)
    fraction = (least << (zeros + 1).astype(U)) >> U(64 - p.mantissa)
    packed = (zeros.astype(U) << U(p.mantissa) | fraction).astype(np.uint16).reshape(n, k)
    full = full.reshape(n, k)
    row, column = np.nonzero(~full & full.any(1)[:, None])
    out, attempt = packed.copy(), 0
    while len(row):
        attempt += 1
        probe = (mixed(column.astype(U) * U(1 << 32) + U(attempt)) % U(k)).astype(np.int64)
        hit = full[row, probe]
        out[row[hit], column[hit]] = packed[row[hit], probe[hit]]
        row, column = row[~hit], column[~hit]
    return out


def band_keys(regs: np.ndarray, p: Params) -> np.ndarray:
    """One key a band of each row of registers."""
    rolled = np.tile(np.arange(p.bands, dtype=np.uint64) + U(1), (len(regs), 1))
    part = regs.reshape(len(regs), p.bands, p.rows).astype(U)
    for i in range(p.rows):
        rolled = mixed(rolled * U(0x9E3779B97F4A7C15) + part[:, :, i] + U(1))
    return rolled


def estimate(a: np.ndarray, b: np.ndarray, p: Params) -> np.ndarray:
    """Similarity from the share of equal registers, less what chance adds."""
    return ((a == b).mean(1) - p.collision) / (1 - p.collision)


def signatures(docs: DataFrame, p: Params, doc: str, text: str) -> DataFrame:
    """Per row: d, k, n (set size), c (hash of the whole set: its class; null for an empty set) and its registers."""
    body = text_of(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, "t"):
            keys, of = shingles(texts, p.words)
            n = np.bincount(of, minlength=len(texts))
            ends = np.concatenate([[0], np.cumsum(n)])
            total = np.concatenate([np.zeros(1, U), np.cumsum(mixed(keys + U(0x51ED270B)), dtype=U)])
            c = mixed((total[ends[1:]] - total[ends[:-1]]) ^ mixed(n.astype(U))).view(np.int64)
            regs = registers(keys, of, len(texts), p)
            yield pa.RecordBatch.from_arrays([
                part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(c, mask=n == 0),
                pa.array([r.tobytes() if m else None for r, m in zip(regs, n)], pa.binary())], names=["d", "k", "n", "c", "regs"])

    return docs.select(id_of(doc).alias("d"), text_key(body).alias("k"), body.alias("t")).mapInArrow(run, "d bigint, k bigint, n bigint, c bigint, regs binary")


def _bands(p: Params):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                regs = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint16).reshape(part.num_rows, p.registers)
                c = part.column(0).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(band_keys(regs, p).view(np.int64).ravel()), pa.array(np.repeat(c, p.bands))], names=["b", "c"])

    return run


def _likely(p: Params):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, p.registers) for i in (2, 3))
                part = batch.filter(pa.array(estimate(a, b, p) >= p.percent / 100 - p.slack))
                yield part.select(["a", "b", "u", "v"])

    return run


def _sets(p: Params):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, "t"):
            keys, of = shingles(texts, p.words)
            offsets = np.searchsorted(of, np.arange(len(texts) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.view(np.int64)))], names=["c", "s"])

    return run


def confirmed(pairs: DataFrame, classes: DataFrame, sets: DataFrame, p: Params) -> DataFrame:
    """The links (``u``, ``v``) as (a, b) of the pairs (a, b, u, v) that the estimate lets through and the full sets confirm."""
    regs = classes.select("c", "regs")
    near = (pairs.join(regs.select(F.col("c").alias("a"), F.col("regs").alias("ra")), "a").join(regs.select(F.col("c").alias("b"), F.col("regs").alias("rb")), "b")
            .select("a", "b", "ra", "rb", "u", "v").mapInArrow(_likely(p), "a bigint, b bigint, u bigint, v bigint"))
    both = (near.join(sets.select(F.col("c").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("c").alias("b"), F.col("s").alias("sb")), "b"))
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.where((100 + p.percent) * shared >= p.percent * (F.size("sa") + F.size("sb"))).select(F.col("u").alias("a"), F.col("v").alias("b"))


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of one part as (c, root): each end and the least end that the part's links reach from it."""
    ends = [np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)]) for batch in batches if batch.num_rows]
    if not ends:
        return
    nodes, at = np.unique(np.concatenate(ends, axis=1), return_inverse=True)
    x, y = at.reshape(2, -1)
    root = np.arange(len(nodes))
    while (apart := root[x] != root[y]).any():
        u, v = root[x[apart]], root[y[apart]]
        np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
        while (up := root[root]).tobytes() != root.tobytes():
            root = up
    moved = root != np.arange(len(nodes))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[root[moved]])], names=["a", "b"])


def components(links: DataFrame, chunk: int) -> DataFrame:
    """(c, root) of every linked c but the roots: the least c of its component.

    Parts of at most some ``chunk`` links are contracted to stars by a task each. If there
    are several, turns of large and small stars join them.
    """
    both = lambda e: e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def star(e: DataFrame, smaller: bool) -> DataFrame:
        around = e.where("b < a") if smaller else both(e)
        least = around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        met = around.join(least, "a")
        moved = met.where("b <> m" if smaller else "b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        if smaller:
            moved = moved.unionByName(least.select("a", F.col("m").alias("b")))
        return moved.distinct()

    def mark(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    kept = stored(links.select("a", "b"), "links")
    parts = -(-kept.count() // chunk)
    if not parts:
        return kept.select(F.col("a").alias("c"), F.col("b").alias("root"))
    edges = stored(kept.repartition(parts).mapInArrow(_forest, "a bigint, b bigint"), "stars")
    seen = mark(edges) if parts > 1 else None
    while seen:
        # A large star keeps each node's links to smaller ones, moved to the least; both stars keep the components.
        edges = stored(star(star(edges, False), True), "stars")
        now = mark(edges)
        seen = now if now != seen else None
    return edges.select(F.col("a").alias("c"), F.col("b").alias("root"))


def _compare(p: Params):
    """Links, as pairs of roots, between the classes outside a family's largest component and any others, one block of each."""
    def run(block: pd.DataFrame) -> pd.DataFrame:
        few, all_ = block[block["asks"]], block[~block["asks"]]
        out: list[tuple[int, int]] = []
        if len(few) and len(all_):
            regs = np.frombuffer(b"".join(all_["regs"]), np.uint16).reshape(len(all_), -1)
            root, n = all_["root"].to_numpy(), all_["n"].to_numpy()
            sets, ends = np.concatenate(all_["s"].to_list()), np.cumsum(n)
            for own_root, own_n, own_regs, own_set in zip(few["root"], few["n"], few["regs"], few["s"]):
                likely = (root != own_root) & (100 * np.minimum(n, own_n) >= p.percent * np.maximum(n, own_n))
                likely &= estimate(np.frombuffer(own_regs, np.uint16)[None], regs, p) >= p.percent / 100 - p.slack
                if likely.any():
                    mine = np.sort(own_set)
                    at = np.minimum(np.searchsorted(mine, sets), len(mine) - 1)
                    running = np.concatenate([[0], np.cumsum(mine[at] == sets)])
                    shared = running[ends] - running[ends - n]
                    hit = np.flatnonzero(likely & ((100 + p.percent) * shared >= p.percent * (n + own_n)))
                    out += [(own_root, other) for other in np.unique(root[hit])]  # one link to a component is enough
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def family_links(able: DataFrame, classes: DataFrame, sets: DataFrame, p: Params) -> DataFrame:
    """Links, as pairs of roots, within families: classes that large buckets join, directly or by others.

    ``able`` (b, c, root, ...) has the memberships of large buckets. Every class outside the
    family's largest component is compared with every class of the other components, in
    blocks of ``block`` classes by hash.
    """
    firsts = able.groupBy("b").agg(F.min("c").alias("first"))
    joined = able.join(firsts, "b").where("c <> first").select(F.col("c").alias("a"), F.col("first").alias("b")).distinct()
    family = components(joined, p.chunk).withColumnRenamed("root", "family")
    member = stored(able.select("c", "root").distinct().join(family, "c", "left").withColumn("family", F.coalesce("family", "c")), "family")
    main = member.groupBy("family", "root").count().groupBy("family").agg(F.max(F.struct("count", "root")).alias("m")).select("family", F.col("m.root").alias("main"))
    sizes = (member.join(main, "family").groupBy("family", "main")
             .agg(F.ceil(F.count("*") / p.block).cast("int").alias("parts"), F.ceil(F.count_if(F.col("root") != F.col("main")) / p.block).cast("int").alias("few_parts")))
    rows = member.join(sizes, "family").where("few_parts > 0").join(classes.select("c", "n", "regs"), "c").join(sets, "c")
    slot = lambda parts: F.pmod(F.xxhash64("c"), F.greatest(parts, F.lit(1))).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), parts - 1))
    fields = ["family", "i", "j", "c", "root", "n", "regs", "s"]
    few = rows.where("root <> main").withColumn("i", slot(F.col("few_parts"))).withColumn("j", every(F.col("parts"))).select(F.lit(True).alias("asks"), *fields)
    others = rows.withColumn("j", slot(F.col("parts"))).withColumn("i", every(F.col("few_parts"))).select(F.lit(False).alias("asks"), *fields)
    return few.unionByName(others).groupBy("family", "i", "j").applyInPandas(_compare(p), "a bigint, b bigint")


def link_classes(docs: DataFrame, p: Params = Params(), doc: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Signatures of every row of ``docs``, and (c, root) of the classes that link to others, but for the roots."""
    body = text_of(text)
    signed = stored(signatures(docs, p, doc, text), "signatures")
    classes = stored(signed.where("c IS NOT NULL").groupBy("c").agg(F.min(F.struct("d", "k")).alias("rep"), F.first("n").alias("n"), F.first("regs").alias("regs")), "classes")
    bands = classes.select("c", "regs").mapInArrow(_bands(p), "b bigint, c bigint")
    shared = bands.groupBy("b").agg(F.count("*").alias("m")).where("m > 1")
    members = stored(bands.join(shared, "b"), "members")
    known = members.groupBy("c").agg(F.sum("m").alias("fame"))
    reps = classes.join(known.select("c"), "c", "left_semi").select("c", "rep.d", "rep.k")
    texts = docs.select(id_of(doc).alias("d"), text_key(body).alias("k"), body.alias("t")).join(reps, ["d", "k"]).select("c", "t")
    sets = stored(texts.mapInArrow(_sets(p), "c bigint, s array<bigint>").dropDuplicates(["c"]), "sets")
    hubs = members.join(known, "c").groupBy("b").agg(F.max(F.struct("fame", "c")).alias("hub")).select("b", F.col("hub.c").alias("hub"))
    stars = members.join(hubs, "b").where("c <> hub").select(F.least("c", "hub").alias("a"), F.greatest("c", "hub").alias("b")).distinct()
    first = components(confirmed(stars.withColumns({"u": F.col("a"), "v": F.col("b")}), classes, sets, p), p.chunk)
    # Buckets with several components, and what links across them can still exist.
    placed = members.select("b", "c").join(first, "c", "left").select("b", "c", F.coalesce("root", "c").alias("root"))
    several = placed.groupBy("b").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("b")
    open_ = stored(placed.join(several, "b"), "open")
    if not open_.count():
        return signed, first
    own = sets.join(open_.select("c").distinct(), "c", "left_semi")
    alone = (own.select("c", F.explode("s").alias("h")).groupBy("h").agg(F.count("*").alias("m"), F.min("c").alias("c")).where("m = 1")
             .groupBy("c").agg(F.count("*").alias("alone")))
    sized = own.select("c", F.size("s").alias("n")).join(alone, "c", "left").select("c", "n", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("v"))
    able = stored(open_.join(sized.where(100 * F.col("v") >= p.percent * F.col("n")), "c"), "able")
    # Of each bucket: its largest component and its size.
    marks = able.groupBy("b", "root").count().groupBy("b").agg(F.max(F.struct("count", "root")).alias("main"), F.sum("count").alias("size"))
    marked = stored(able.join(marks.select("b", F.col("main.root").alias("main"), "size"), "b"), "marked")
    few, wide = marked.where(F.col("size") <= p.listed), marked.where(F.col("size") > p.listed)
    x = few.where("root <> main").select("b", *[F.col(c).alias(f"x_{c}") for c in ("c", "root", "n", "v")])
    y = few.select("b", *[F.col(c).alias(f"y_{c}") for c in ("c", "root", "n", "v", "main")])
    possible = (100 + p.percent) * F.least("x_v", "y_v") >= p.percent * (F.col("x_n") + F.col("y_n"))
    # Two classes outside the largest component meet once.
    rest = (x.join(y, "b").where((F.col("x_root") != F.col("y_root")) & ((F.col("y_root") == F.col("y_main")) | (F.col("x_c") < F.col("y_c"))) & possible)
            .select(F.least("x_c", "y_c").alias("a"), F.greatest("x_c", "y_c").alias("b"), F.least("x_root", "y_root").alias("u"), F.greatest("x_root", "y_root").alias("v")).distinct())
    new = confirmed(rest, classes, sets, p)
    if wide.count():
        new = new.unionByName(family_links(wide, classes, sets, p))
    # Later links join roots of the first components only.
    up = components(new, p.chunk)
    moved = first.join(up.select(F.col("c").alias("root"), F.col("root").alias("top")), "root", "left").select("c", F.coalesce("top", "root").alias("root"))
    return signed, moved.unionByName(up)


def near_duplicates(docs: DataFrame, p: Params = Params(), doc: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``d`` (its id), ``k`` (text key), ``n`` (set size), ``group`` and ``component``.

    Sets: distinct runs of ``words`` words `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased; a shorter text
    is one shingle. ``component`` is the least id that links of at least ``percent`` percent
    similarity reach. A text without words links with nothing: its component is its own id.
    Null ids take part but are no component while another id is there; a component of null
    ids only has none. Repeated rows are copies. An empty table gives no rows.
    """
    signed, linked = link_classes(docs, p, doc, text)
    grouped = signed.select("d", "k", "n", "c").join(linked, "c", "left").select(back("d").alias("d"), "k", "n", F.coalesce("root", "c").alias("group"))
    least = grouped.where("group IS NOT NULL").groupBy("group").agg(F.min("d").alias("least"))
    return grouped.join(least, "group", "left").select("d", "k", "n", "group", F.when(F.col("group").isNull(), F.col("d")).otherwise(F.col("least")).alias("component"))
