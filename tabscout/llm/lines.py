"""Corpus-wide line deduplication that returns keep bitmaps.

Hashes of the lines' keys are range-partitioned by (hash, document), so a line that a third
of all documents hold spreads over many tasks, and sorted by hash, then document downwards,
then position. Each task streams through its part. A key can go on in other parts only if it
is the first or last of a part; these keys, two a part at most, are summed up beforehand.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tabscout.llm.common import back, cut, id_of, partitions, text_key, text_of, text_slices

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = " \t\n\x0b\x0c\r"


def line_key(line):
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def _columns(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [c.to_numpy(zero_copy_only=False) for c in batch.columns]


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h1, h2, documents, largest document) of a part's first and last key; a document lies in one part."""
    runs: list[list] = []  # first and current key: h1, h2, documents, largest, last seen
    for batch in batches:
        h1, h2, d = _columns(batch)[:3]
        if not len(d):
            continue
        new_key = np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
        new_doc = np.concatenate([[True], new_key[1:] | (d[1:] != d[:-1])])
        at = np.flatnonzero(new_key)
        docs = np.add.reduceat(new_doc.astype(np.int64), at)
        for i in {0, len(at) - 1}:
            p, end = at[i], (at[i + 1] if i + 1 < len(at) else len(d)) - 1
            if runs and (runs[-1][0], runs[-1][1]) == (h1[p], h2[p]):
                runs[-1][2] += int(docs[i]) - int(runs[-1][4] == d[p])
                runs[-1][4] = d[end]
            else:
                run = [h1[p], h2[p], int(docs[i]), d[p], d[end]]
                runs = [*runs[:1], run]
    rows = [r[:4] for r in runs]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], names=["h1", "h2", "n", "top"])


def _stream(edges: dict[tuple[int, int], tuple[int, int]], least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None  # rows of the last key, while its verdict may still change

        def out(cols, mask):
            return pa.RecordBatch.from_arrays([pa.array(c[mask]) for c in cols[2:]], names=["d", "k", "pos"])

        def decide(cols: list[np.ndarray]) -> np.ndarray:
            """Which rows of whole keys are dropped: all below the largest document, if enough documents hold the key."""
            h1, h2, d = cols[:3]
            new_key = np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
            new_doc = np.concatenate([[True], new_key[1:] | (d[1:] != d[:-1])])
            at = np.flatnonzero(new_key)
            docs, top = np.add.reduceat(new_doc.astype(np.int64), at), d[at].copy()
            for i in {0, len(at) - 1}:
                if (known := edges.get((int(h1[at[i]]), int(h2[at[i]])))) is not None:
                    docs[i], top[i] = known
            run_of = np.cumsum(new_key) - 1
            return (docs[run_of] >= least) & (d != top[run_of])

        for batch in batches:
            cols = _columns(batch)
            if not len(cols[0]):
                continue
            if held is not None:
                cols = [np.concatenate([a, b]) for a, b in zip(held, cols)]
            h1, h2 = cols[0], cols[1]
            key = (int(h1[-1]), int(h2[-1]))
            cut_at = len(h1) - int(np.argmin(np.append(((h1 == h1[-1]) & (h2 == h2[-1]))[::-1], False)))
            if key in edges:  # its total is known, so its rows need not wait
                held, cut_at = None, len(h1)
            else:
                held = [c[cut_at:] for c in cols]
            if cut_at:
                done = [c[:cut_at] for c in cols]
                yield out(done, decide(done))
        if held is not None and len(held[0]):
            yield out(held, decide(held))

    return run


def line_keep(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per distinct (id, text): ``d``, ``k``, ``n_lines``, ``n_dropped`` and ``keep``, the deflated bits of its kept lines.

    A line's key is the line without blanks at its ends, A-Z lower-cased. Keys of
    ``min_chars`` code points or more in ``min_docs`` documents or more lose their lines
    except in the largest id that holds them, where all stay. Null or empty texts are one
    empty line. Rows with one id are one document; null ids are one document below all
    others. Repeated rows share their bitmap. An empty table gives no rows.
    """
    body = text_of(text)
    base = docs.select(id_of(doc).alias("d"), body.alias("t")).withColumn("k", text_key(F.col("t")))
    split = base.select("d", "k", F.posexplode(F.split("t", "\n", -1)).alias("pos", "line"))
    keyed = split.select("d", "k", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    found = keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2"), "d", "k", "pos")
    dealt = found.repartitionByRange(partitions(docs), "h1", "h2", "d")
    ordered = cut(dealt.sortWithinPartitions("h1", "h2", F.desc("d"), "k", "pos"))
    summed = ordered.mapInArrow(_edges, "h1 bigint, h2 bigint, n bigint, top bigint").groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("top").alias("top"))
    # At most two rows a part, whatever the data.
    edges = {(r["h1"], r["h2"]): (r["n"], r["top"]) for r in summed.collect()}
    dropped = ordered.mapInArrow(_stream(edges, min_docs), "d bigint, k bigint, pos int")
    gone = dropped.groupBy("d", "k").agg(F.collect_set("pos").alias("gone"))
    lines = base.select("d", "k", (F.length("t") - F.length(F.replace("t", F.lit("\n"))) + 1).cast("bigint").alias("n_lines")).distinct()

    def bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for n, gone in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                bits = np.ones(n, bool)
                bits[gone or []] = False
                keep.append((n, int(n - bits.sum()), zlib.compress(np.packbits(bits).tobytes())))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array([x[i] for x in keep], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary()))]],
                                             names=["d", "k", "n_lines", "n_dropped", "keep"])

    joined = lines.join(gone, ["d", "k"], "left").select("d", "k", "n_lines", "gone")
    return joined.mapInArrow(bitmaps, "d bigint, k bigint, n_lines bigint, n_dropped bigint, keep binary")


def apply_keep(docs: DataFrame, kept: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(d, n_lines, n_dropped, text) of every row of ``docs``, its kept lines joined again."""
    body = text_of(text)
    rows = docs.select(id_of(doc).alias("d"), text_key(body).alias("k"), body.alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, "t"):
            out = []
            for t, dropped, keep in zip(texts, part.column(2).to_pylist(), part.column(4).to_pylist()):
                if dropped:
                    lines = t.split(b"\n")
                    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines))
                    t = b"\n".join([x for x, b in zip(lines, bits.tolist()) if b])
                out.append(t)
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(out, pa.binary()).cast(pa.string())], names=["d", "n_lines", "n_dropped", "text"])

    joined = rows.join(kept, ["d", "k"]).select("d", "n_lines", "n_dropped", "t", "keep")
    return joined.mapInArrow(run, "d bigint, n_lines bigint, n_dropped bigint, text string").withColumn("d", back("d"))
