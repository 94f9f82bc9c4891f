"""Words, word hashes and shingle hashes of whole Arrow columns with numpy."""

from __future__ import annotations

import numpy as np

# ASCII white space of the contracts: \x20 and \x09-\x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_PLACE = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POW = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    global _POW
    if len(_POW) < n:
        m = max(n, 2 * len(_POW))
        _POW = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(m - 1, _BASE, np.uint64))])
    return _POW


class Words:
    """Words of a block of texts: byte ranges, row of each word, and running
    sums from which the hash of any byte range inside a word follows."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = True, space: np.ndarray = SPACE):
        n = len(data)
        self.data = LOWER[data] if lower else data
        ink = ~space[data]
        first = np.zeros(n + 1, bool)  # where a row begins
        first[offsets[offsets <= n]] = True
        before = np.empty(n, bool)
        if n:
            before[0] = False
            before[1:] = ink[:-1]
        self.start = np.flatnonzero(ink & (~before | first[:n]))
        after = np.empty(n, bool)
        if n:
            after[-1] = False
            after[:-1] = ink[1:]
        self.end = np.flatnonzero(ink & (~after | first[1:])) + 1
        self.row = np.searchsorted(offsets, self.start, "right") - 1
        self.rows = len(offsets) - 1
        # Words of each row: self.at[row] .. self.at[row + 1].
        self.at = np.searchsorted(self.row, np.arange(self.rows + 1))
        self.ink = ink
        self._sums = None

    @property
    def sums(self) -> np.ndarray:
        if self._sums is None:
            length = self.end - self.start
            place = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
            values = np.zeros(len(self.data) + 1, np.uint64)
            values[1:][self.ink] = _BYTE[self.data[self.ink]] * powers(int(length.max(initial=0)) + 1)[place]
            self._sums = np.cumsum(values)
        return self._sums

    def hash_range(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of bytes from the first byte of a word to ``end``."""
        return mix(self.sums[end] - self.sums[start] + (end - start).astype(np.uint64) * _BASE)

    def hashes(self) -> np.ndarray:
        return self.hash_range(self.start, self.end)


def shingles(words: Words, k: int, whole_if_short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each window of ``k`` words, with repeats. A row with
    fewer words has its whole sequence as one shingle, or none."""
    h = words.hashes()
    n = np.diff(words.at)
    windows = np.maximum(n - k + 1, 0)
    total = int(windows.sum())
    row = np.repeat(np.arange(words.rows), windows)
    i = np.arange(total) - np.repeat(np.cumsum(windows) - windows, windows) + words.at[:-1][row] if total else np.zeros(0, np.int64)
    out = np.full(total, np.uint64(k), np.uint64)
    for j in range(k):
        out = out + h[i + j] * _PLACE[j]
    out = mix(out)
    if whole_if_short:
        short = np.flatnonzero((n > 0) & (n < k))
        if len(short):
            value = n[short].astype(np.uint64)
            for j in range(k - 1):
                has = n[short] > j
                value[has] += h[words.at[:-1][short][has] + j] * _PLACE[j]
            row, out = np.concatenate([row, short]), np.concatenate([out, mix(value)])
    return row, out


def distinct(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, value), sorted by row, then value."""
    if not len(row):
        return row, value
    by = np.lexsort((value, row))
    row, value = row[by], value[by]
    keep = np.ones(len(row), bool)
    keep[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[keep], value[keep]
