"""Rabin-Karp hashes of word windows, for whole Arrow columns at a time.

Words are the runs of bytes other than 0x20 and 0x09-0x0D, which is ``[^\\x20\\x09-\\x0D]+`` of the text, since
UTF-8 uses no such byte inside a character. A word's hash is the polynomial of its bytes, a window's the polynomial of its
words' hashes, both modulo 2^64 and then mixed; polynomials of all windows come from doubling: that of
a + b words is that of the first a, shifted, plus that of the next b. Two families with bytes' values and factors of
their own give 128 bits together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
#: The factor of words in a window, by family.
_B = (0xC2B2AE3D27D4EB4F | 1, 0xD6E8FEB86659FD93 | 1)
_MASK = (1 << 64) - 1
_BYTES: dict[int, np.ndarray] = {}
_POWERS = (np.zeros(0, U), np.zeros(0, U))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: Bytes of text hashed at once; a longer text is hashed alone.
CHUNK_BYTES = 1 << 19


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64: every bit of the input moves every bit of the output."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def _byte_table(family: int) -> np.ndarray:
    if family not in _BYTES:
        _BYTES[family] = mix(np.arange(1 + 256 * family, 257 + 256 * family, dtype=U) * U(_P)) | U(1)
    return _BYTES[family]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_P^i and _P^-i modulo 2^64 for i < n."""
    global _POWERS
    if len(_POWERS[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        inverse = pow(_P, -1, 1 << 64)
        out = []
        for base in (_P, inverse):
            p = np.full(size, base & _MASK, U)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        if size <= 8 * CHUNK_BYTES:
            _POWERS = (out[0], out[1])
        return out[0], out[1]
    return _POWERS


class Words:
    """The words of consecutive texts: byte ranges in ``data``, hashes, and each text's first word."""

    __slots__ = ("data", "start", "end", "hash", "first", "factor")

    def __init__(self, data: np.ndarray, bounds: np.ndarray, lower: bool, family: int = 0):
        """``bounds``: where each text begins in ``data``, and the end."""
        self.factor = _B[family]
        space = _SPACE[data]
        edge = np.zeros(len(data) + 1, bool)  # a word may begin at, and none goes on across, a text's first byte
        edge[bounds] = True
        word = ~space
        before = np.concatenate([[False], word])
        after = np.concatenate([word, [False]])
        self.start = np.flatnonzero(after & (~before | edge))
        self.end = np.flatnonzero(before & (~after | edge))
        if lower:
            upper = (data >= 65) & (data <= 90)
            data = data + upper.astype(np.uint8) * np.uint8(32)
        self.data = data
        power, inverse = _powers(len(data) + 1)
        sums = np.zeros(len(data) + 1, U)
        np.cumsum(_byte_table(family)[data] * power[: len(data)], out=sums[1:])
        h = (sums[self.end] - sums[self.start]) * inverse[self.start]
        self.hash = mix(h + (self.end - self.start).astype(U) * U(self.factor))
        self.first = np.searchsorted(self.start, bounds)

    def windows(self, size: int) -> np.ndarray:
        """The hash of the window of ``size`` words at each word; those that run past their text or the end mean nothing."""
        n = len(self.hash)
        if n < size:
            return np.zeros(0, U)
        level, width, out, done = self.hash, 1, None, 0
        rest = size
        while rest:
            if rest & 1:
                # what is done covers the last words of the window, this level the words before them
                if out is None:
                    out, done = level.copy(), width
                else:
                    out = level[: n - width - done + 1] * U(pow(self.factor, done, 1 << 64)) + out[width:][: n - width - done + 1]
                    done += width
            rest >>= 1
            if rest:
                level = level[: n - 2 * width + 1] * U(pow(self.factor, width, 1 << 64)) + level[width:][: n - 2 * width + 1]
                width *= 2
        return mix(out)


def column_words(column: pa.Array, lower: bool = False, family: int = 0) -> Iterator[tuple[int, int, Words]]:
    """(first row, end row, words) of runs of rows of a string column; a null text has no words."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK_BYTES, "right")) - 1)
        end = min(end, n)
        yield row, end, Words(data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row], lower, family)
        row = end
