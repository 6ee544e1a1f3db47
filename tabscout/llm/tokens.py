"""Token counts by a deterministic finite-state transducer compiled from a tokenizer's pieces.

For byte-pair merges, each prefix of a text has one last token, and a piece can follow it
only if the two stay apart when they are tokenized together. So a left-to-right machine
suffices: its state is the longest suffix that can still grow into a piece, with the last
token and relative token count at each position in it. A transition carries the change of
the token count. States are built when first needed. At a word's leading space mark nothing
before it matters, so such places cut a text into chunks whose state maps are constant:
their counts compose by a prefix sum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tabscout.llm.common import text_of, text_slices

SPACE = "▁"
#: States a worker keeps; beyond them it starts again with none, which changes no count.
STATES = 400_000
#: Characters of a chunk, at least; a chunk ends where a word starts.
CHUNK = 4096


class State(dict):
    """Transitions: character to (next state, change of the count); missing ones are built."""

    __slots__ = ("machine", "tail", "places", "last")

    def __init__(self, machine: Transducer, tail: str, places: tuple, last: str | None):
        super().__init__()
        self.machine, self.tail, self.places, self.last = machine, tail, places, last

    def __missing__(self, char: str):
        arc = self[char] = self.machine.arc(self, char)
        return arc


class Transducer:
    """Counts tokens of normalised text. ``pieces``: each mergeable piece with its score; higher scores merge first.

    A state holds ``tail``, the longest suffix that a longer piece may start with; ``places``,
    for each position in it from which a piece may still come: (position, tokens that
    may not come from there or the token before it, count there less the count now); and ``last``,
    the last token. Tokens that rule out the same pieces lead to the same state.
    """

    def __init__(self, pieces: dict[str, float], byte_fallback: bool):
        self.rank = {p: -score for p, score in pieces.items()}
        self.byte_fallback = byte_fallback
        if any(c not in pieces for p in pieces for c in p):
            raise ValueError("a piece has a character that is no piece itself")
        if any(a != SPACE and b == SPACE for p in pieces for a, b in zip(p, p[1:])):
            raise ValueError("a piece goes on over the start of a word")
        self.history = {p: h for p in pieces if (h := self._merges(p)) is not None}
        self.longer: dict[str, list[str]] = {}  # prefix of two or more characters: the tokens beyond it
        self.open = set()
        for p in self.history:
            for i in range(1, len(p)):
                self.open.add(p[:i])
                if i > 1:
                    self.longer.setdefault(p[:i], []).append(p)
        self.apart: dict[tuple[str, str], bool] = {}
        self.barred: dict[tuple, frozenset] = {}
        self.sets: dict[frozenset, frozenset] = {}
        self.reset()

    @classmethod
    def of_sentencepiece(cls, processor) -> Transducer:
        ids = range(processor.vocab_size())
        own = [i for i in ids if not (processor.is_control(i) or processor.is_unknown(i) or processor.is_byte(i) or processor.is_unused(i))]
        return cls({processor.id_to_piece(i): processor.get_score(i) for i in own}, any(processor.is_byte(i) for i in ids))

    def reset(self) -> None:
        self.states: dict[tuple, State] = {}
        self.start = State(self, "", (), None)

    def _merges(self, piece: str) -> list[tuple[float, str, str]] | None:
        """The merges that make a piece from its characters: (rank, first part, last part) after each; None if it isn't made."""
        parts, out = list(piece), [(0.0, piece[0], piece[-1])]
        while len(parts) > 1:
            found = [(self.rank[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.rank]
            if not found:
                return None
            rank, i = min(found)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            out.append((rank, parts[0], parts[-1]))
        return out

    def _follows(self, before: str | None, piece: str) -> bool:
        """Whether two tokens stay apart: no merge over their border is ever the best one."""
        if before is None:
            return True
        key = (before, piece)
        known = self.apart.get(key)
        if known is not None:
            return known
        left, right, i, j, never = self.history[before], self.history[piece], 0, 0, float("inf")
        answer = True
        while True:
            next_left = left[i + 1][0] if i + 1 < len(left) else never
            next_right = right[j + 1][0] if j + 1 < len(right) else never
            over = self.rank.get(left[i][2] + right[j][1], never)
            if over < next_left and over <= next_right and over < never:
                answer = False
                break
            if next_left == next_right == never:
                break
            if next_left <= next_right:
                i += 1
            else:
                j += 1
        if len(self.apart) > STATES:
            self.apart.clear()
        self.apart[key] = answer
        return answer

    def _bars(self, held, prefix: str) -> frozenset | None:
        """Tokens beyond ``prefix`` that may not come after a token, or are already ruled out; None if all are."""
        key = (held, prefix)
        if key not in self.barred:
            if isinstance(held, frozenset):
                found = frozenset(t for t in held if len(t) > len(prefix) and t.startswith(prefix))
            else:
                found = frozenset(t for t in self.longer[prefix] if not self._follows(held, t))
            if len(self.barred) > STATES:
                self.barred.clear()
            self.barred[key] = None if len(found) == len(self.longer[prefix]) else self.sets.setdefault(found, found)
        return self.barred[key]

    def arc(self, state: State, char: str) -> tuple[State, int]:
        if char not in self.rank:  # an unknown character stands alone
            return self.start, len(char.encode("utf-8", "surrogatepass")) if self.byte_fallback else 1
        if char == SPACE and not state.tail.endswith(SPACE):
            state = self.start
        text = state.tail + char
        piece, change = None, 0
        places = (*state.places, (len(state.tail), state.last, 0))
        for at, held, count in reversed(places):
            token = text[at:]
            if token in self.history and (token not in held if isinstance(held, frozenset) else self._follows(held, token)):
                piece, change = token, count + 1
                break
        if piece is None:
            raise ValueError(f"no last token for {text!r}")
        still = []
        for at, held, count in places:
            prefix = text[at:]
            if prefix in self.open:
                bars = held if len(prefix) == 1 else self._bars(held, prefix)
                if bars is not None or len(prefix) == 1:
                    still.append((at, bars, count - change))
        keep = still[0][0] if still else len(text)
        key = (text[keep:], tuple((at - keep, held, count) for at, held, count in still), piece)
        found = self.states.get(key)
        if found is None:
            if len(self.states) >= STATES:
                self.reset()
            found = self.states[key] = State(self, *key)
        return found, change

    def count(self, chunk: str) -> int:
        """Tokens of a chunk that starts where the machine starts."""
        state, total = self.start, 0
        for char in chunk:
            state, change = state[char]
            total += change
        return total


def chunks(text: str) -> list[str]:
    """``text`` cut before space marks that follow another character, each part about CHUNK long or as long as its word."""
    out, start = [], 0
    while start < len(text):
        at = start + CHUNK
        while True:
            at = text.find(SPACE, at)
            if at < 0 or text[at - 1] != SPACE:
                break
            at += 1
        stop = len(text) if at < 0 else at
        out.append(text[start:stop])
        start = stop
    return out


def counts(texts: list[str], machine: Transducer) -> np.ndarray:
    """Tokens of each normalised text: chunk counts, scanned, read at the texts' ends."""
    parts = [chunks(t) for t in texts]
    scan = np.concatenate([[0], np.cumsum([machine.count(c) for p in parts for c in p], dtype=np.int64)])
    ends = np.cumsum([len(p) for p in parts], dtype=np.int64)
    return np.diff(scan[np.concatenate([[0], ends])])


_machines: dict[str, tuple] = {}


def _loaded(path: str) -> tuple:
    """The model's normaliser and transducer, once a worker."""
    if path not in _machines:
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_file=path)
        _machines[path] = (processor, Transducer.of_sentencepiece(processor))
    return _machines[path]


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, text: str = "text", into: str = "tokens") -> DataFrame:
    """``docs`` with a struct ``into``: ``n_bytes``, ``n_tokens``, ``over_limit`` (more than ``limit`` tokens).

    ``model_path`` names a SentencePiece BPE model on every machine; its normaliser is used,
    special strings inside texts are ordinary text, nothing is added or cut off. Null and
    empty texts have 0. A column called ``into`` is replaced. An empty table gives no rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        processor, machine = _loaded(model_path)
        for part, texts in text_slices(batches, "body"):
            normal = processor.normalize([t.decode() for t in texts])
            found = counts(normal, machine)
            values = [pa.array([len(t) for t in texts], pa.int64()), pa.array(found, pa.int64()), pa.array(found > limit)]
            fields = [pa.field("n_bytes", pa.int64()), pa.field("n_tokens", pa.int64()), pa.field("over_limit", pa.bool_())]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.StructArray.from_arrays(values, fields=fields)], names=["row", "tokens"])

    packed = docs.drop(into).select(F.struct("*").alias("row"), text_of(text).alias("body"))
    schema = f"row {packed.schema['row'].dataType.simpleString()}, tokens struct<n_bytes: bigint, n_tokens: bigint, over_limit: boolean>"
    return packed.mapInArrow(run, schema).select("row.*", F.col("tokens").alias(into))
