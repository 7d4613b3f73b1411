"""Whole-buffer word splitting and hashing with numpy.

A column of texts is one byte buffer with offsets.  Words are runs of bytes that a
256-entry table calls word bytes, so a million words are found and hashed by a few
array operations instead of a Python loop.  Buffers are handled in bounded slices;
a text longer than a slice is cut between words, so memory doesn't follow its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_SEED = 0x5EED
#: Bytes handled at once; the work arrays take about 40 times as much.
SLICE = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


mix = _mix


class Words:
    """Splits byte buffers into words and hashes them.

    ``separators`` are the byte values below 0x80 that no word contains; ``lower``
    treats A-Z as a-z.
    """

    def __init__(self, separators: set[int], lower: bool = True):
        self.is_word = np.ones(256, dtype=bool)
        self.is_word[sorted(separators)] = False
        self.value = np.random.default_rng(_SEED).integers(1, 1 << 63, 256, dtype=np.uint64)
        if lower:
            self.value[65:91] = self.value[97:123]
        self._powers = self._inverse = np.ones(1, dtype=np.uint64)

    def _grow(self, n: int) -> None:
        if len(self._powers) < n:
            inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
            with np.errstate(over="ignore"):
                full = np.full(n, _BASE, dtype=np.uint64)
                full[0] = 1
                self._powers = np.multiply.accumulate(full)
                full[1:] = inverse
                self._inverse = np.multiply.accumulate(full)

    def split(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the words of one buffer."""
        inside = np.empty(len(data) + 2, dtype=np.int8)
        inside[0] = inside[-1] = 0
        inside[1:-1] = self.is_word[data]
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        return edge[::2], edge[1::2]

    def hashes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if not len(starts):
            return np.empty(0, dtype=np.uint64)
        self._grow(len(data))
        with np.errstate(over="ignore"):
            run = np.empty(len(data) + 1, dtype=np.uint64)
            run[0] = 0
            np.cumsum(self.value[data] * self._powers[: len(data)], out=run[1:])
            return _mix((run[ends] - run[starts]) * self._inverse[starts])

    def of(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and hashes of the words of a buffer of any length."""
        parts, at = [], 0
        while at < len(data):
            to = min(at + SLICE, len(data))
            if to < len(data):
                gap = np.flatnonzero(~self.is_word[data[at:to]])
                if len(gap):
                    to = at + int(gap[-1]) + 1
                else:  # one word longer than a slice
                    gap = np.flatnonzero(~self.is_word[data[to:]])
                    to = to + int(gap[0]) if len(gap) else len(data)
            piece = data[at:to]
            s, e = self.split(piece)
            parts.append((s + at, e + at, self.hashes(piece, s, e)))
            at = to
        if not parts:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw, off


def slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of about SLICE bytes: first row, end row, bytes, and each text's
    offsets from the first of them.  A longer text comes alone."""
    raw, off = buffers(column)
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + SLICE, side="right")) - 1)
        j = min(j, n)
        yield i, j, raw[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


class Shingler:
    """Distinct hashed word n-grams of each text of a column.

    A text of 1 to ``size - 1`` words has its whole word sequence as its one shingle;
    a text without words has none.
    """

    def __init__(self, size: int, words: Words):
        self.size, self.words = size, words

    def _gap(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The slice's bytes with a separator between texts, so no word spans two."""
        n = len(offsets) - 1
        if n == 1:
            return data, offsets
        sep = np.flatnonzero(~self.words.is_word)[0]
        return np.insert(data, offsets[1:-1], np.uint8(sep)), offsets + np.concatenate(([0], np.arange(n), ))[: n + 1]

    def sets(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, int]]:
        """Row, sorted distinct shingles and number of words of each text."""
        k = self.size
        for i, j, data, offsets in slices(column):
            data, bounds = self._gap(data, offsets)
            starts, _, h = self.words.of(data)
            first = np.searchsorted(starts, bounds)
            with np.errstate(over="ignore"):
                if len(h) >= k:
                    rolled = np.zeros(len(h) - k + 1, dtype=np.uint64)
                    for t in range(k):
                        rolled = rolled * _STEP + h[t : t + len(rolled)]
                    rolled = _mix(rolled + np.uint64(k))
                for row in range(i, j):
                    a, b = int(first[row - i]), int(first[row - i + 1])
                    if b - a >= k:
                        out = np.unique(rolled[a : b - k + 1])
                    elif b > a:
                        x = np.uint64(0)
                        for v in h[a:b]:
                            x = x * _STEP + v
                        out = _mix(np.array([x + np.uint64(b - a)], dtype=np.uint64))
                    else:
                        out = np.empty(0, dtype=np.uint64)
                    yield row, out, b - a
