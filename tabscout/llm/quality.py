"""Quality rules by repetition coverage: how much of a text lies in its own repeated n-grams and lines."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tabscout.llm.arrays import U, Words, later, mixed, repeated
from tabscout.llm.common import text_of, text_slices

# The characters that count as symbols.
SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Rules:
    """Thresholds. ``grams`` maps an n-gram length to the largest share of characters in later copies of repeated ones.

    Two copies that the base rule just passes hold half of the words, one of them later: all limits
    but that of two words, which the base rule does not see, lie below a quarter, and fall with the length.
    """

    least_words: int = 50
    most_repeat_words: int = 50  # percent of words in repeated windows of three
    grams: tuple[tuple[int, float], ...] = ((2, 0.30), (3, 0.20), (5, 0.15), (8, 0.12))
    most_line_chars: float = 0.20  # in later copies
    most_symbols: float = 0.25  # symbols a word


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def covered(first: np.ndarray, length: int, words: int) -> np.ndarray:
    """Which of so many words lie in a run of ``length`` words from one of ``first``."""
    cover = np.zeros(words + 1, np.int32)
    np.add.at(cover, first, 1)
    np.add.at(cover, first + length, -1)
    return np.cumsum(cover)[:-1] > 0


def measure(texts: list[bytes | None], lengths: tuple[int, ...]) -> dict[str, np.ndarray]:
    """Counts of each text, and the share of its word characters in repeated n-grams (``gram_n``), in their later copies (``later_n``) and in later copies of lines (``lines``)."""
    w = Words.of(texts)
    n = len(texts)
    chars = w.chars()
    size = chars[w.ends] - chars[w.starts]
    per_doc = lambda weights, doc: np.bincount(doc, weights, n)
    word_chars = per_doc(size, w.doc)
    out = {"n_words": np.diff(w.first), "word_chars": word_chars.astype(np.int64)}
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    counted = np.concatenate([[0], np.cumsum(symbol[w.bytes])])
    out["n_symbols"] = counted[w.text_start[1:]] - counted[w.text_start[:-1]]
    safe = np.maximum(word_chars, 1)
    for length in sorted({3, *lengths}):
        keys, at = w.grams(length)
        own = mixed(keys + w.doc[at].astype(U) * U(0xD6E8FEB86659FD93))
        inside = covered(at[repeated(own)], length, len(w.hashes))
        out[f"gram_{length}"] = per_doc(size * inside, w.doc) / safe
        out[f"later_{length}"] = per_doc(size * covered(at[later(own)], length, len(w.hashes)), w.doc) / safe
        if length == 3:
            out["n_repeat_words"] = per_doc(inside, w.doc).astype(np.int64)
    # A line runs from one break to the next; only those with a word count.
    breaks = np.flatnonzero(w.bytes == 10)
    line_start = np.union1d(w.text_start[:-1], breaks + 1)
    line_start = line_start[line_start < w.text_start[-1]]
    doc = np.searchsorted(w.text_start, line_start, "right") - 1
    begin, end = np.searchsorted(w.starts, line_start), np.searchsorted(w.starts, np.append(line_start[1:], w.text_start[-1]))
    has = end > begin
    seen: dict[tuple[int, bytes], int] = {}
    raw = w.bytes.tobytes()
    stop = np.append(line_start[1:], w.text_start[-1]) - 1  # without the break, or the space after the text
    names = [seen.setdefault((d, raw[a:b]), len(seen)) for d, a, b, h in zip(doc.tolist(), line_start.tolist(), stop.tolist(), has.tolist()) if h]
    dup = later(np.array(names, np.int64))
    held = np.concatenate([[0], np.cumsum(size)])
    line_chars = (held[end] - held[begin])[has]
    out["n_dup_lines"] = np.bincount(doc[has], dup, n).astype(np.int64)
    out["lines"] = np.bincount(doc[has], line_chars * dup, n) / safe
    return out


def judge(found: dict[str, np.ndarray], rules: Rules) -> tuple[np.ndarray, np.ndarray]:
    """Which texts fail the base rules, and which are kept."""
    words = found["n_words"]
    failed = (words < rules.least_words) | (100 * found["n_repeat_words"] > rules.most_repeat_words * words)
    bad = failed | (found["lines"] > rules.most_line_chars) | (found["n_symbols"] > rules.most_symbols * words)
    for length, most in rules.grams:
        bad |= found[f"later_{length}"] > most
    return failed, ~bad


def quality(docs: DataFrame, rules: Rules = Rules(), text: str = "text", into: str = "quality") -> DataFrame:
    """``docs`` with a struct ``into``: counts, coverage by n-gram length, of later copies alone and of repeated lines, ``base_failed`` and ``kept``.

    Null and empty texts have no words and fail. Every row is judged by its own whole text, so
    repeated rows agree. An input column called ``into`` is replaced. An empty table gives no rows.
    """
    lengths = tuple(n for n, _ in rules.grams)
    shares = [f"{kind}_{n}" for kind in ("gram", "later") for n in sorted({3, *lengths})] + ["lines"]
    fields = [*[pa.field(c, pa.int64()) for c in COUNTS], *[pa.field(c, pa.float64()) for c in shares], pa.field("base_failed", pa.bool_()), pa.field("kept", pa.bool_())]
    ddl = ", ".join([*[f"{c}: bigint" for c in COUNTS], *[f"{c}: double" for c in shares], "base_failed: boolean", "kept: boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, "body"):
            found = measure(texts, lengths)
            failed, kept = judge(found, rules)
            values = [pa.array(found[f.name], f.type) for f in fields[:-2]] + [pa.array(failed), pa.array(kept)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.StructArray.from_arrays(values, fields=fields)], names=["row", "quality"])

    rows = docs.drop(into)
    packed = rows.select(F.struct("*").alias("row"), text_of(text).alias("body"))
    row_type = packed.schema["row"].dataType.simpleString()
    return packed.mapInArrow(run, f"row {row_type}, quality struct<{ddl}>").select("row.*", F.col("quality").alias(into))
