"""Word boundaries, word hashes and rolling (Rabin-Karp) window hashes of whole Arrow batches, vectorised over bytes.

All hashes are polynomials over 64-bit words, modulo 2**64, with an odd base: the base has an inverse, so a prefix
sum of symbol * base**-i gives the hash of any range as a difference times a power.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 2**64)
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _lut(ranges: list[tuple[int, int]], keep: bool) -> np.ndarray:
    table = np.full(256, not keep)
    for a, b in ranges:
        table[a : b + 1] = keep
    return table


#: Bytes of words of `[^\x20\x09-\x0D]+`.
SPACED = _lut([(0x20, 0x20), (0x09, 0x0D)], False)
#: Bytes of words of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`.
ALNUM = _lut([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)], False)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for later calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        m = 1 << max(16, (n - 1).bit_length())
        have = np.ones(m, np.uint64)
        done, step = 1, base
        while done < m:  # doubling
            have[done : 2 * done] = have[:done] * np.uint64(step)
            done, step = 2 * done, step * step % 2**64
        _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * MIX1
    h = (h ^ (h >> np.uint64(27))) * MIX2
    return h ^ (h >> np.uint64(31))


def ranges(symbols: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed polynomial hash of symbols[start:end] for each pair."""
    n = len(symbols)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(symbols * powers(INVERSE, n), out=total[1:])
    return mix((total[end] - total[start]) * powers(BASE, n + 1)[end])


class Words:
    """The words of some documents in a row: data (bytes), start, end (of each word), doc (of each word), first (word
    number at which each document starts, and the total), hash (of each word)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray, lower: bool):
        self.data = LOWER[data] if lower else data
        self.offsets = offsets
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = table[self.data]
        begins = np.zeros(len(data) + 1, bool)
        begins[offsets] = True
        at, before = inside[1:], inside[:-1]
        self.start = np.flatnonzero(at & (~before | begins))
        self.end = np.flatnonzero(before & (~at | begins))
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        self._hash: np.ndarray | None = None

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            self._hash = ranges(self.data.astype(np.uint64) + np.uint64(1), self.start, self.end)
        return self._hash

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of each window of k words that lies in one document."""
        n = len(self.start)
        if n < k:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.doc[: n - k + 1] == self.doc[k - 1 :])
        return at, ranges(self.hash, at, at + k)


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def groups(column: pa.Array, size: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from row, to row, bytes, offsets) of consecutive rows with about size bytes together; one row may be longer."""
    data, offsets = texts(column)
    a, n = 0, len(column)
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, side="right")) - 1)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def words(column: pa.Array, table: np.ndarray = SPACED, lower: bool = False) -> Iterator[tuple[int, int, Words]]:
    """(from row, to row, Words) over a string column."""
    for a, b, data, offsets in groups(column):
        yield a, b, Words(data, offsets, table, lower)
