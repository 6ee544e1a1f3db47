"""Find benchmark passages in documents by the q-gram lemma and banded alignment.

A text region within k edits of an item of m characters shares at least m + 1 - q (k + 1) of
its q-grams, at positions whose difference (the diagonal) stays within k. So hits are
counted by distinct item position in overlapping bands of diagonals; bands that reach
the bound are aligned. Nothing within the budget is missed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tabscout.llm.arrays import BASE, U, mixed
from tabscout.llm.common import text_of, text_slices

BITS = 22


@dataclass(frozen=True)
class Rule:
    """``q``: q-gram length. ``rate``: edits allowed a character. ``least``: shorter items match exactly, at word borders.

    Items of more than ``window`` characters also match by windows of that length, one each ``step``.
    """

    q: int = 10
    rate: float = 0.08
    least: int = 40
    window: int = 400
    step: int = 200
    block_chars: int = 1 << 20  # of items that are compared in one pass over the documents


def normal(text: str) -> str:
    """Lower case, each run of white space one blank."""
    return " ".join(text.lower().split())


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def qgrams(c: np.ndarray, q: int) -> np.ndarray:
    """Hash of the q characters from each position, by doubling lengths."""
    if len(c) < q:
        return np.zeros(0, U)
    length, have = 1, c.astype(U) + U(1)
    base = c.astype(U) + U(1)
    for bit in bin(q)[3:]:
        n = len(have) - length
        have = have[:n] * U(pow(BASE, length, 1 << 64)) + have[length : length + n]
        length *= 2
        if bit == "1":
            n = min(len(have), len(base) - length)
            have = have[:n] * U(BASE) + base[length : length + n]
            length += 1
    return mixed(have[: len(c) - q + 1])


@dataclass
class Index:
    """Q-gram positions of some items."""

    ids: list
    texts: list[str]
    rule: Rule
    budget: np.ndarray = field(init=False)
    bound: np.ndarray = field(init=False)

    def __post_init__(self):
        self.size = np.array([len(t) for t in self.texts], np.int64)
        short = self.size < self.rule.least
        self.budget = np.where(short, 0, (self.size * self.rule.rate).astype(np.int64))
        # A smaller q where the bound would fall below a q-gram's worth of hits.
        self.q = np.where(short, self.size, np.minimum(self.rule.q, (self.size + 1) // (self.budget + 2)))
        self.bound = np.maximum(1, self.size + 1 - self.q * (self.budget + 1))
        self.tables = []
        for q in np.unique(self.q).tolist():
            own = np.flatnonzero(self.q == q)
            grams = [qgrams(codes(self.texts[i]), q) for i in own]
            keys = np.concatenate(grams)
            item = np.repeat(own, [len(g) for g in grams])
            at = np.concatenate([np.arange(len(g)) for g in grams]).astype(np.int64)
            order = np.argsort(keys, kind="stable")
            keys, first = np.unique(keys[order], return_index=True)
            bits = np.zeros(1 << BITS, bool)
            bits[(keys >> U(64 - BITS)).astype(np.int64)] = True
            self.tables.append((q, keys, first, np.diff(np.append(first, len(order))), item[order], at[order], bits))

    def _hits(self, c: np.ndarray, q: int, keys: np.ndarray, first: np.ndarray, counts: np.ndarray, items: np.ndarray, places: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, ...]:
        """(position, item, position in the item) of every q-gram that the characters share with items."""
        grams = qgrams(c, q)
        at = np.flatnonzero(bits[(grams >> U(64 - BITS)).astype(np.int64)])
        found = np.minimum(np.searchsorted(keys, grams[at]), len(keys) - 1)
        real = keys[found] == grams[at]
        at, found = at[real], found[real]
        count = counts[found]
        pick = np.repeat(first[found] - np.concatenate([[0], np.cumsum(count)[:-1]]).astype(np.int64), count) + np.arange(count.sum())
        return np.repeat(at, count), items[pick], places[pick]

    def regions(self, texts: list[str]) -> np.ndarray:
        """Rows (text, item, lowest diagonal of the band) of the bands that reach the bound."""
        c = codes("\n".join(texts))
        hits = [self._hits(c, *table) for table in self.tables]
        at, item, place = (np.concatenate([np.zeros(0, np.int64), *[h[i] for h in hits]]) for i in range(3))
        start = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        doc = np.searchsorted(start, at, "right") - 1
        diagonal = at - start[doc] - place + self.size[item]  # 0 or more
        width = 2 * self.budget[item] + 1
        band = diagonal // width
        # Band b has diagonals from b to b + 2 widths, so any width of diagonals lies in one band.
        rows = np.concatenate([np.stack([doc, item, band - lower, place], 1) for lower in (0, 1)])
        if not len(rows):
            return np.zeros((0, 3), np.int64)
        rows = rows[np.lexsort(rows.T[::-1])]
        new = np.any(rows[1:] != rows[:-1], 1)
        rows = rows[np.concatenate([[True], new])]
        head = np.concatenate([[True], np.any(rows[1:, :3] != rows[:-1, :3], 1)])
        begin = np.flatnonzero(head)
        hits = np.diff(np.append(begin, len(rows)))
        kept = rows[begin[hits >= self.bound[rows[begin, 1]]], :3]
        kept[:, 2] = kept[:, 2] * (2 * self.budget[kept[:, 1]] + 1) - self.size[kept[:, 1]]
        return kept

    def matches(self, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, edits, start, end) of the best region of each item that a text holds within budget."""
        regions = self.regions(texts)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for item in np.unique(regions[:, 1]):
            own = regions[regions[:, 1] == item]
            text, k, m = self.texts[item], int(self.budget[item]), int(self.size[item])
            windows = []
            for doc, _, low in own.tolist():
                if (doc, item) in best and best[doc, item][0] == 0:
                    continue
                if m < self.rule.least:
                    alone = re.search(rf"(?<!\w){re.escape(text)}(?!\w)", texts[doc])
                    if alone:
                        best[doc, item] = (0, *alone.span())
                    continue
                at = texts[doc].find(text)
                if at >= 0:
                    best[doc, item] = (0, at, at + m)
                else:
                    windows.append((doc, low))
            for doc, low, edits, end in align(text, [(d, low, texts[d]) for d, low in windows], 2 * (2 * k + 1), k):
                if edits <= k and ((doc, item) not in best or (edits, end) < (best[doc, item][0], best[doc, item][2])):
                    best[doc, item] = (edits, max(0, end - m), end)
        return [(d, i, *v) for (d, i), v in sorted(best.items())]


def align(pattern: str, windows: list[tuple[int, int, str]], width: int, margin: int, at_once: int = 4096) -> Iterator[tuple[int, int, int, int]]:
    """(text number, lowest diagonal, fewest edits, end) of ``pattern`` in a band of each text, all bands in step."""
    p = codes(pattern)
    wide = width + 2 * margin + 1
    for first in range(0, len(windows), at_once):
        part = windows[first : first + at_once]
        # Column e of row i is text position i + e + low - margin; outside a text no character matches.
        area = np.full((len(part), len(p) + wide), 0xFFFFFFFF, np.uint32)
        for row, (_, low, text) in enumerate(part):
            begin = low - margin
            a, b = max(0, begin), min(len(text), begin + area.shape[1])
            if b > a:
                area[row, a - begin : b - begin] = codes(text[a:b])
        cost = np.zeros((len(part), wide), np.int32)
        step = np.arange(wide, dtype=np.int32)
        far = np.full((len(part), 1), 1 << 20, np.int32)
        for i in range(len(p)):
            here = cost + (area[:, i : i + wide] != p[i])
            here = np.minimum(here, np.concatenate([cost[:, 1:] + 1, far], 1))
            cost = np.minimum.accumulate(here - step, 1) + step
        e = cost.argmin(1)
        for (doc, low, text), column, edits in zip(part, e.tolist(), cost.min(1).tolist()):
            yield doc, low, edits, min(len(text), low - margin + column + len(p))


FOUND = "array<struct<item_id: bigint, edits: int, start: int, end: int>>"


def _blocks(items: DataFrame, rule: Rule, item: str, text: str) -> Iterator[Index]:
    """Indexes of the items, a bounded number of characters each, read one by one; an id is (item, number of its whole text)."""
    ids, texts, held = [], [], 0
    rows = items.select(F.col(item).cast("bigint").alias("i"), text_of(text).alias("t")).distinct().orderBy("i", "t")
    for row in rows.toLocalIterator():
        body = normal(row["t"])
        if not body:
            continue
        if held + len(body) > rule.block_chars and ids:
            yield Index(ids, texts, rule)
            ids, texts, held = [], [], 0
        whole = len(texts)
        last = len(body) - rule.window
        parts = [body, *[body[a : a + rule.window] for a in (*range(0, last, rule.step), last)]] if last > 0 else [body]
        ids.extend([(row["i"], whole)] * len(parts))
        texts.extend(parts)
        held += sum(map(len, parts))
    if ids:
        yield Index(ids, texts, rule)


def find_items(docs: DataFrame, items: DataFrame, rule: Rule = Rule(), text: str = "text", item: str = "item_id", item_text: str = "text", into: str = "found") -> DataFrame:
    """``docs`` with ``into``: each item that the whole text holds within its edit budget, with edits and place in the normal form.

    Items go to the tasks in blocks of bounded size, one pass over ``docs`` each; ``docs`` is
    neither shuffled nor joined. Null and empty texts hold nothing, null and empty items are
    not looked for, of long items a window is enough, equal items are found each. Repeated rows agree. A column called ``into``
    is replaced. Empty tables give no rows, or rows with nothing found.
    """
    out = docs.drop(into).select(F.struct("*").alias("row"), text_of(text).alias("body"), F.array().cast(FOUND).alias("found"))
    spark = docs.sparkSession
    names = ["item_id", "edits", "start", "end"]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int32()]
    for index in _blocks(items, rule, item, item_text):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for part, texts in text_slices(batches, "body"):
                found = part.column(2).to_pylist()
                best: dict[tuple[int, int], tuple] = {}
                for doc, i, *place in index.matches([normal(t.decode()) for t in texts]):
                    item, whole = index.ids[i]
                    # The whole item, or else its window with fewest edits.
                    best[doc, whole] = min(best.get((doc, whole), (2,)), (int(i != whole), *place, item))
                for (doc, _), (_, *place, item) in sorted(best.items()):
                    found[doc].append(dict(zip(names, (item, *place))))
                kind = pa.list_(pa.struct(list(zip(names, types))))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, kind)], names=["row", "body", "found"])

        out = out.mapInArrow(run, out.schema)
    return out.select("row.*", F.col("found").alias(into))
