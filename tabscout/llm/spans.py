"""Substring deduplication by sliding spans of sentences.

A sentence ends at a punctuation mark or line break, and, so that long sentences align
between documents, after words whose hash falls in a fixed class. From every sentence a
run of three or more sentences with enough words is hashed. Runs are shuffled once, in order of
hash and place; sentences in a run that isn't the first are repeats. A run that goes on in
other parts is settled by the edges of the parts.

With ``close`` ends, a word without a mark near it ends a sentence if its hash is the least of
some GAP words, so no sentence is longer than that, and equal passages have equal ends
but for their outer GAP words. The shortest run that stops at each end is hashed as well,
so the runs of a repeated passage cover all of its sentences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tabscout.llm.arrays import BASE, INVERSE, U, Words, mixed, powers
from tabscout.llm.common import back, id_of, partitions, stored, text_key, text_of, text_slices

# Bytes that end a sentence when they end a word.
ENDS = b".!?,;:"
#: Sentences of a run, and words, at least.
SENTENCES, WORDS = 3, 16
#: One word of so many ends a sentence by its hash.
EVERY = 16
OTHER = 0xC2B2AE3D27D4EB4F
#: Of so many words in a row, one ends a close sentence.
GAP = 6
#: Marks beyond ASCII that end a close sentence, and what may follow a mark within its word.
WIDE_ENDS = tuple("。！？；：，、．｡､…‥‽،؛؟۔।॥։።፧၊။។")
CLOSERS = b"\"')]}"
#: Characters that count as much as one word, where they are words of their own.
CHARACTERS = 3


def _marked(w: Words) -> np.ndarray:
    """Which words end in a mark, or in one and a closing quote or bracket."""
    marks, closers = np.zeros(256, bool), np.zeros(256, bool)
    marks[list(ENDS)] = True
    closers[list(CLOSERS)] = True
    stop = w.ends.copy()
    for _ in range(2):
        stop -= closers[w.bytes[stop - 1]] & (stop - w.starts > 1)
    out = marks[w.bytes[stop - 1]]
    for size in (2, 3):
        code = np.zeros(len(stop), np.int64)
        for i in range(size):
            code = code << 8 | w.bytes[np.maximum(stop - size + i, 0)]
        out |= np.isin(code, [int.from_bytes(m.encode(), "big") for m in WIDE_ENDS if len(m.encode()) == size]) & (stop - w.starts >= size)
    return out


def _close_ends(w: Words) -> np.ndarray:
    """Marked words, and of each GAP words in a row of one text without a marked one the last with the least hash."""
    out = _marked(w)
    n = len(w.hashes) - GAP + 1
    if n > 0:
        marked = np.concatenate([[0], np.cumsum(out)])
        open_ = np.flatnonzero((marked[GAP:] == marked[:-GAP]) & (w.doc[:n] == w.doc[GAP - 1 :]))
        spread = mixed(w.hashes ^ U(OTHER))
        best, least = np.full(len(open_), GAP - 1), spread[open_ + GAP - 1]
        for i in range(GAP - 2, -1, -1):
            lower = spread[open_ + i] < least
            best[lower], least = i, np.where(lower, spread[open_ + i], least)
        out[open_ + best] = True
    return out


def runs(texts: list[bytes], sentences: int = SENTENCES, words: int = WORDS, close: bool = False) -> tuple[np.ndarray, ...]:
    """Of every run: its text, first and second hash, first byte in the text, bytes; and of every sentence its text."""
    w = Words.of(texts, lower=True, apart=close)
    n = len(w.hashes)
    if not n:
        empty = np.zeros(0, np.int64)
        return empty, empty.astype(U), empty.astype(U), empty, empty, empty
    breaks = np.concatenate([[0], np.cumsum(w.bytes == 10)])
    next_start = np.append(w.starts[1:], len(w.bytes))
    if close:
        ends = _close_ends(w)
    else:
        marks = np.zeros(256, bool)
        marks[list(ENDS)] = True
        ends = marks[w.bytes[w.ends - 1]] | (w.hashes % U(EVERY) == 0)
    ends |= breaks[next_start] > breaks[w.ends]
    ends[w.first[1:][np.diff(w.first) > 0] - 1] = True
    stop = np.flatnonzero(ends) + 1  # the word after each sentence
    begin = np.concatenate([[0], stop[:-1]])
    doc = w.doc[begin]
    last = np.searchsorted(doc, doc, "right") - 1  # the last sentence of the same text
    s = np.arange(len(begin))
    if close:  # words as thirds, so that a character may count as one
        blank = np.concatenate([w.starts[1:] > w.ends[:-1], [True]])
        alone = ~blank | np.concatenate([[False], ~blank[:-1]])
        weight = np.concatenate([[0], np.cumsum(np.where(alone, 1, CHARACTERS))])
        words *= CHARACTERS
    else:
        weight = np.arange(n + 1)
    until = np.maximum(s + sentences - 1, np.searchsorted(weight[stop], weight[begin] + words))
    whole = until <= last
    s, until = s[whole], until[whole]
    if close:
        # The shortest run that stops at each end, where no start has it.
        e = np.setdiff1d(np.arange(len(begin)), until)
        since = np.minimum(e - sentences + 1, np.searchsorted(weight[begin], weight[stop[e]] - words, "right") - 1)
        inside = (since >= 0) & (doc[since] == doc[e])
        s, until = np.concatenate([s, since[inside]]), np.concatenate([until, e[inside]])
    a, b = begin[s], stop[until]
    hashes = []
    for base, back_base in ((BASE, INVERSE), (OTHER, pow(OTHER, -1, 1 << 64))):
        running = np.concatenate([np.zeros(1, U), np.cumsum(w.hashes * powers(base, n), dtype=U)])
        hashes.append(mixed((running[b] - running[a]) * powers(back_base, n + 1)[a] + (b - a).astype(U)))
    first = w.starts[a] - w.text_start[doc[s]]
    return doc[s], hashes[0], hashes[1], first, w.ends[b - 1] - w.starts[a], doc


def repeated_spans(docs: DataFrame, sentences: int = SENTENCES, words: int = WORDS, doc: str = "doc_id", text: str = "text", close: bool = False) -> DataFrame:
    """One row per text with repeats: ``d``, ``k`` (upper half of the text key) and ``spans`` (first byte, bytes), the merged runs that occurred before.

    The first place of a run is the smallest id (null first), then text key, then position;
    a later run in the same text is a repeat as well. Null and empty texts have no runs, and
    repeated rows of one id and text are one document. An empty table gives no rows.
    With ``close``, every repeated passage of some 30 words is found whatever its marks.
    """
    body = text_of(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, "t"):
            doc, h1, h2, first, size, _ = runs(texts, sentences, words, close)
            d, k = (part.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (
                h1.view(np.int64), ((h2 >> U(32)).astype(np.uint32).view(np.int32)), d[doc], (k[doc] >> 32).astype(np.int32),
                first.astype(np.int32), size.astype(np.int32))], names=["h1", "h2", "d", "k", "first", "size"])

    found = docs.select(id_of(doc).alias("d"), text_key(body).alias("k"), body.alias("t")).mapInArrow(run, "h1 bigint, h2 int, d bigint, k int, first int, size int")
    order = ("h1", "h2", "d", "k", "first")
    dealt = found.repartitionByRange(partitions(docs), *order).sortWithinPartitions(*order)
    told = stored(dealt.mapInArrow(_repeats, "h1 bigint, h2 int, d bigint, k int, first int, size int, kind int"), "repeats")
    # At most two rows a part, whatever the data.
    edges = told.where(F.col("kind") > REPEAT).collect()
    place = lambda r: (r["d"], r["k"], r["first"])
    known: dict[tuple[int, int], tuple[int, int, int]] = {}
    for r in edges:
        if r["kind"] == LAST:
            known[r["h1"], r["h2"]] = min(known.get((r["h1"], r["h2"]), place(r)), place(r))
    more = [(*place(r), r["size"]) for r in edges if r["kind"] == FIRST and known.get((r["h1"], r["h2"]), place(r)) < place(r)]
    again = told.where(F.col("kind") == REPEAT).select("d", "k", "first", "size")
    if more:
        again = again.unionByName(docs.sparkSession.createDataFrame(more, again.schema))
    return again.groupBy("d", "k").agg(F.collect_set(F.struct("first", "size")).alias("runs")).mapInArrow(_merged, "d bigint, k int, spans array<struct<first: int, size: int>>")


#: Kinds of rows that a part tells: a repeat, the part's first row, and the first row of its last run.
REPEAT, FIRST, LAST = 0, 1, 2


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in order: those of a run (h1, h2) that are not at its first place in this part, and the part's edges."""
    names = ["h1", "h2", "d", "k", "first", "size", "kind"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]

    def out(cols: list, kind: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*[pa.array(c, t) for c, t in zip(cols, types)], pa.array([kind] * len(cols[0]), pa.int32())], names=names)

    held: list[np.ndarray] | None = None  # the first row of the current run
    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not len(cols[0]):
            continue
        if held is None:
            yield out([c[:1] for c in cols], FIRST)
            held = [c[:1] for c in cols]
        cols = [np.concatenate(pair) for pair in zip(held, cols)]
        new = np.concatenate([[True], (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])])
        begin = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        again = np.logical_or.reduce([c != c[begin] for c in cols[2:5]])
        yield out([c[again] for c in cols], REPEAT)
        held = [c[begin[-1] : begin[-1] + 1] for c in cols]
    if held is not None:
        yield out(held, LAST)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("first", pa.int32()), ("size", pa.int32())]))
    for batch in batches:
        out = []
        for own in batch.column(2).to_pylist():
            spans: list[dict] = []
            for r in sorted(own, key=lambda r: (r["first"], -r["size"])):
                end = r["first"] + r["size"]
                # Runs with only a blank between them are one span.
                if spans and r["first"] <= spans[-1]["first"] + spans[-1]["size"] + 1:
                    spans[-1]["size"] = max(spans[-1]["size"], end - spans[-1]["first"])
                else:
                    spans.append(dict(r))
            out.append(spans)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, kind)], names=["d", "k", "spans"])


def without_spans(docs: DataFrame, spans: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``d`` and ``text`` of every row of ``docs`` without its repeats."""
    body = text_of(text)
    rows = docs.select(id_of(doc).alias("d"), F.shiftright(text_key(body), 32).cast("int").alias("k"), body.alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, "t"):
            out = []
            for t, own in zip(texts, part.column(2).to_pylist()):
                kept, at = [], 0
                for s in own or []:
                    kept.append(t[at : s["first"]])
                    at = s["first"] + s["size"]
                out.append(b"".join([*kept, t[at:]]))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.binary()).cast(pa.string())], names=["d", "text"])

    return rows.join(spans, ["d", "k"], "left").select("d", "t", "spans").mapInArrow(run, "d bigint, text string").withColumn("d", back("d"))
