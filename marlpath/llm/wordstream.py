"""Words and word shingles of many texts at once, as numpy arrays of 64-bit hashes.

A word is a maximal run of ASCII letters, ASCII digits and non-ASCII characters in the lower-cased text; everything
else separates. Hashes depend on the word alone, so they can be compared across tasks and runs.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1
STEP = 0xD1342543DE82EF95
MASK = (1 << 64) - 1
BLOCK = 1 << 19

_word_byte = np.zeros(256, bool)
_word_byte[48:58] = _word_byte[97:123] = _word_byte[128:] = True
_word_byte[65:91] = True

_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse, modulo 2**64."""
    if not _powers or len(_powers["up"]) < n:
        n = max(n, BLOCK + 4096)
        inverse = pow(BASE, -1, 1 << 64)
        for name, base in (("up", BASE), ("down", inverse)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            with np.errstate(over="ignore"):
                _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers: neighbouring inputs give unrelated outputs."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Words(NamedTuple):
    """doc: index of each word's text; start, end: byte places in ``data``; hash: of each word; first: index of each text's first word, and the total."""

    data: bytes
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    def text(self, i: int, j: int) -> str:
        """Words i to j-1, parted by single spaces."""
        return " ".join(self.data[s:e].decode() for s, e in zip(self.start[i:j].tolist(), self.end[i:j].tolist()))


def words(texts: Sequence[str | None], lower: bool = True) -> Words:
    """All words of ``texts``, in order; null texts have none."""
    raw = [(t.lower() if lower else t).encode() if t else b"" for t in texts]
    data = b"\n".join(raw)
    size = np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw))
    doc_end = np.cumsum(size)
    b = np.frombuffer(data, np.uint8)
    inside = _word_byte[b]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(b) and inside[0]:
        edge = np.concatenate(([0], edge))
    if len(edge) % 2:
        edge = np.concatenate((edge, [len(b)]))
    start, end = edge[0::2].astype(np.int64), edge[1::2].astype(np.int64)
    hashes = np.empty(len(start), np.uint64)
    lo = 0
    while lo < len(start):  # block by block, so that the powers stay in the cache
        origin = start[lo]
        hi = max(lo + 1, int(np.searchsorted(end, origin + BLOCK, "right")))
        span = int(end[hi - 1] - origin)
        up, down = _power(span + 1)
        sums = np.zeros(span + 1, np.uint64)
        part = b[origin : origin + span].astype(np.uint64)
        part += np.uint64(1)
        part *= up[:span]
        np.cumsum(part, out=sums[1:])
        s = start[lo:hi] - origin
        hashes[lo:hi] = (sums[end[lo:hi] - origin] - sums[s]) * down[s]
        lo = hi
    first = np.searchsorted(start, np.concatenate(([0], doc_end)), "left").astype(np.int64)
    first[-1] = len(start)
    doc = np.repeat(np.arange(len(raw), dtype=np.int64), np.diff(first))
    return Words(data, doc, start, end, mix(hashes), first)


def shingles(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of its first word) of each run of n words within one text, in order."""
    m = len(w.hash) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h = w.hash[:m].copy()
    for j in range(1, n):
        h *= np.uint64(STEP)
        h += w.hash[j : j + m]
    at = np.flatnonzero(w.doc[:m] == w.doc[n - 1 :])
    return mix(h[at]), at


def runs(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``shingles``, for long runs: hashes of twice the length are made of two neighbours, so the steps are log2 of n."""
    if len(w.hash) < n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    whole, size, block, step = None, 0, w.hash, 1
    left = n
    while left:
        if left & 1:
            if whole is None:
                whole = block
            else:
                m = len(block) - size
                whole = whole[:m] * np.uint64(pow(STEP, step, 1 << 64)) + block[size : size + m]
            size += step
        left >>= 1
        if left:
            m = len(block) - step
            block = block[:m] * np.uint64(pow(STEP, step, 1 << 64)) + block[step:]
            step *= 2
    at = np.flatnonzero(w.doc[: len(whole)] == w.doc[n - 1 :])
    return mix(whole[at] ^ np.uint64(n)), at


def chunks(texts: Sequence[str | None], most_chars: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """(lo, hi) ranges over ``texts`` of about ``most_chars`` each; a longer text stands alone and whole."""
    lo = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > lo and size + n > most_chars:
            yield lo, i
            lo, size = i, 0
        size += n
    if lo < len(texts):
        yield lo, len(texts)
