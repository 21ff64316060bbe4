"""Vectorised word splitting and hashing over the UTF-8 bytes of many texts at once.

A word of the contracts is a run of bytes other than 0x20 and 0x09-0x0D; continuation bytes of UTF-8 are all above
0x7F, so byte classes and character classes agree. Hashes are 64-bit and depend on nothing but the bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
_M1, _M2, _M3 = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0xFF51AFD7ED558CCD)
_BASE = U(0xD6E8FEB86659FD93)
_INVERSE = U(pow(0xD6E8FEB86659FD93, -1, 1 << 64))

BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
#: Separators of the decontamination words: every ASCII character but letters and digits, once lower-cased.
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[:128] = True
NOT_ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], U)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    h = h ^ (h >> U(33))
    h *= _M3
    h ^= h >> U(29)
    h *= _M1
    h ^= h >> U(32)
    return h


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (null: empty), and the offsets of its rows, from 0; 8 zero bytes stand behind the bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return np.zeros(8, np.uint8), np.zeros(1, np.int64)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.zeros(int(offsets[-1] - offsets[0]) + 8, np.uint8)
    if len(data) > 8:
        data[:-8] = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


class Words:
    """The words of many texts: starts and ends in the bytes, words before each text, the text of each word, hashes."""

    def __init__(self, column, lower: bool = False, blank: np.ndarray = BLANK):
        data, offsets = text_bytes(column)
        self.data = data = LOWER[data] if lower else data
        self.offsets, total = offsets, len(data) - 8
        solid = ~blank[data[:total]]
        first = np.zeros(total + 1, bool)
        first[offsets] = True  # a text starts here: no word reaches over this border
        begins = solid.copy()
        begins[1:] &= ~solid[:-1] | first[1:total]
        stops = solid.copy()
        stops[:-1] &= ~solid[1:] | first[1:total]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        self.before = np.searchsorted(self.start, offsets)  # words before each text, and in all
        self.count = np.diff(self.before)

    @staticmethod
    def lowered(data: np.ndarray) -> bytes:
        return data.tobytes().lower()

    @property
    def text(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        size = self.end - self.start
        eight = np.ndarray((len(self.data) - 7,), np.dtype("<u8"), self.data, strides=(1,))
        h = mix(eight[self.start] & _MASK[np.minimum(size, 8)]) + U(1) * size.astype(U)
        at, todo = 8, np.flatnonzero(size > 8)
        while len(todo):
            left = np.minimum(size[todo] - at, 8)
            h[todo] = mix((h[todo] * _M2) ^ (eight[self.start[todo] + at] & _MASK[left]))
            at += 8
            todo = todo[size[todo] > at]
        return mix(h)


_powers = np.ones(1, U)
_inverses = np.ones(1, U)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, 2 * len(_powers))
        _powers = np.full(size, _BASE)
        _inverses = np.full(size, _INVERSE)
        _powers[0] = _inverses[0] = 1
        _powers, _inverses = np.multiply.accumulate(_powers), np.multiply.accumulate(_inverses)
    return _powers[:n], _inverses[:n]


def rolling(codes: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hashes of every run of `width` codes, mod 2**64: a difference of prefix sums, shifted back by the base's inverse."""
    n = len(codes) - width + 1
    if n <= 0:
        return np.zeros(0, U)
    powers, inverses = _tables(len(codes))
    sums = np.zeros(len(codes) + 1, U)
    np.cumsum(codes * powers, out=sums[1:])
    return mix((sums[width:] - sums[:n]) * inverses[:n])


def windows(words: Words, codes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of every run of `width` words that lies in one text."""
    h = rolling(codes, width)
    left = np.repeat(words.before[1:], words.count)[: len(h)] - np.arange(len(h))  # words from here to its text's end
    at = np.flatnonzero(left >= width)
    return at, h[at]


def runs(ordered: np.ndarray) -> np.ndarray:
    """Where each run of equal values of a sorted array starts."""
    if not len(ordered):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
