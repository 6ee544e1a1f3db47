"""Words and their hashes as numpy arrays over many texts at a time."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
_tables: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. n - 1 modulo 2 ** 64, kept between calls up to 4 million."""
    have = _tables.get(base)
    if have is None or len(have) < n:
        have = np.ones(max(n, 1 << 16), U)
        np.multiply.accumulate(np.concatenate([have[:1], np.full(len(have) - 1, base, U)]), out=have)
        if len(have) <= 4 << 20:
            _tables[base] = have
    return have[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x.astype(U)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


#: Bytes of a word that is still taken whole where characters are taken apart.
LONG = 64


def _unspaced(a: np.ndarray) -> np.ndarray:
    """Which bytes belong to characters of Thai, Lao, Myanmar, Khmer, Chinese or Japanese script or full-width marks."""
    one, two = a[:-1], a[1:]
    three = ((one == 0xE0) & (two >= 0xB8) & (two <= 0xBB) | (one == 0xE1) & ((two >= 0x80) & (two <= 0x82) | (two == 0x9E) | (two == 0x9F))
             | (one == 0xE2) & (two >= 0xBA) | (one >= 0xE3) & (one <= 0xE9) | (one == 0xEF) & ((two >= 0xA4) & (two <= 0xAB) | (two >= 0xBC)))
    out = np.zeros(len(a) + 3, bool)
    first = np.flatnonzero(three)
    astral = np.flatnonzero((one == 0xF0) & (two >= 0xA0))
    for i in range(4):
        out[astral + i] = True
        if i < 3:
            out[first + i] = True
    return out[: len(a)]


@dataclass
class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of several texts, in order."""

    bytes: np.ndarray  # all texts, a space after each
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    doc: np.ndarray  # the text of each word
    first: np.ndarray  # of each text, and the end: the number of its first word
    text_start: np.ndarray  # of each text, and the end: its first byte

    @classmethod
    def of(cls, texts: list[bytes | None], lower: bool = False, apart: bool = False) -> Words:
        """``apart``: characters of scripts without blanks, and those of words of over LONG bytes, are words of their own."""
        joined = b" ".join([*(t or b"" for t in texts), b""])
        a = np.frombuffer(joined, np.uint8)
        if lower:
            a = a + (((a >= 65) & (a <= 90)) * np.uint8(32))
        sizes = np.array([len(t or b"") + 1 for t in texts], np.int64)
        text_start = np.concatenate([[0], np.cumsum(sizes)])
        word = ~((a == 32) | ((a >= 9) & (a <= 13)))
        edge = np.diff(np.concatenate([[False], word, [False]]).astype(np.int8))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if apart:
            single = _unspaced(a)
            for b, e in zip(starts[ends - starts > LONG].tolist(), ends[ends - starts > LONG].tolist()):
                single[b:e] = True
            lead = (a & 0xC0) != 0x80
            cuts = np.flatnonzero(word[1:] & word[:-1] & lead[1:] & (single[1:] | single[:-1])) + 1
            starts, ends = np.union1d(starts, cuts), np.union1d(ends, cuts)
        running = np.concatenate([np.zeros(1, U), np.cumsum((a.astype(U) + U(1)) * powers(BASE, len(a)), dtype=U)])
        hashes = mixed((running[ends] - running[starts]) * powers(INVERSE, len(a) + 1)[starts] + (ends - starts).astype(U))
        first = np.searchsorted(starts, text_start)
        doc = np.repeat(np.arange(len(texts)), np.diff(first))
        return cls(a, starts, ends, hashes, doc, first, text_start)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Rolling hashes of every run of n words within a text, and the number of each run's first word."""
        count = len(self.hashes)
        if count < n:
            return np.zeros(0, U), np.zeros(0, np.int64)
        rolled = self.hashes[: count - n + 1].copy()
        for i in range(1, n):
            rolled = rolled * U(BASE) + self.hashes[i : count - n + 1 + i]
        at = np.flatnonzero(self.doc[: count - n + 1] == self.doc[n - 1 :])
        return mixed(rolled[at]), at

    def chars(self) -> np.ndarray:
        """Running number of code points before each byte, and at the end."""
        return np.concatenate([[0], np.cumsum((self.bytes & 0xC0) != 0x80)])


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur more than once."""
    if len(keys) == 0:
        return np.zeros(0, bool)
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    same = ordered[1:] == ordered[:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:]] = same
    out[order[:-1]] |= same
    return out


def later(keys: np.ndarray) -> np.ndarray:
    """Which keys occurred before."""
    out = np.zeros(len(keys), bool)
    if len(keys):
        order = np.argsort(keys, kind="stable")
        out[order[1:]] = keys[order][1:] == keys[order][:-1]
    return out
