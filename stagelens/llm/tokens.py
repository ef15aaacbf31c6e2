"""Word tokens of many texts at once: lower case, runs of ASCII letters and digits and of any other letter-like UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import utf8

U = np.uint64
ASCII_WORD = np.array([chr(i).isalnum() if i < 128 else True for i in range(256)])
BYTE = np.random.default_rng(20_011).integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
STEP = U(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on all input bits (as in SplitMix64)."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


class Powers:
    """STEP to the powers 0, 1, 2, ... and their inverses modulo 2^64, as far as a worker has needed them."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            self.up, self.down = (np.multiply.accumulate(np.concatenate([np.ones(1, U), np.full(size - 1, base, U)])) for base in (STEP, U(pow(int(STEP), -1, 1 << 64))))
        return self.up[:n], self.down[:n]


POWERS = Powers()


def spread(cuts: np.ndarray, n: int) -> np.ndarray:
    """For each of n places, how many of the ascending cuts are at or before it."""
    return np.repeat(np.arange(len(cuts) + 1), np.diff(np.concatenate([[0], cuts, [n]])))


def word_mask(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to words. Spaces and marks of Latin-1 (U+0080 to U+00BF), General Punctuation and CJK punctuation do not."""
    ok = ASCII_WORD[data]
    if len(data) > 2:
        a, b = data[:-1], data[1:]
        two = np.flatnonzero(a == 0xC2)
        three = np.flatnonzero(((a == 0xE2) & ((b == 0x80) | (b == 0x81))) | ((a == 0xE3) & (b == 0x80)))
        for i in (two, two + 1, three, three + 1, np.minimum(three + 2, len(data) - 1)):
            ok[i] = False
    return ok


def runs(ok: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of marked bytes within texts: start, end, text's index."""
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(ok))]
    before = np.concatenate([[False], ok[:-1]]) if len(ok) else ok.copy()
    before[inner] = False
    start = np.flatnonzero(ok & ~before)
    after = np.concatenate([ok[1:], [False]]) if len(ok) else ok.copy()
    after[inner - 1] = False
    end = np.flatnonzero(ok & ~after) + 1
    return start, end, spread(np.searchsorted(start, offsets[1:-1]), len(start))


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, table: np.ndarray = BYTE) -> np.ndarray:
    """A word's hash is a difference of running sums of its bytes' values, each times a power of its place."""
    up, down = POWERS(len(data))
    sums = table[data]
    sums *= up
    np.cumsum(sums, out=sums)
    h = sums[end - 1]
    later = start > 0
    h[later] -= sums[start[later] - 1]
    h *= down[start]
    return mix(h + (end - start).astype(U))


def tokenize(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes in lower case and where each text starts -> tokens' (hash, text's index, start, end)."""
    start, end, doc = runs(word_mask(data), offsets)
    return word_hashes(data, start, end) if len(start) else np.zeros(0, U), doc, start, end


def grams(h: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k tokens within a text, and where they start."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    g = np.zeros(n, U)
    for j in range(k):
        g = mix(g * STEP + h[j : n + j])
    at = np.flatnonzero(doc[:n] == doc[k - 1 :])
    return g[at], at


def lowered(column: pa.Array, at_once: int = 1 << 21) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """A string column in slices of about at_once bytes (a longer text is whole): (first row, bytes in lower case, offsets)."""
    low = pc.utf8_lower(column.cast(pa.large_string()).fill_null(""))
    _, offsets = utf8(low)
    row = 0
    while row < len(low):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + at_once, side="right")) - 1)
        yield row, *utf8(low.slice(row, stop - row))
        row = stop
    del low
    pa.default_memory_pool().release_unused()
