"""Vectorised text kernels over Arrow batches: word bounds, word hashes, n-gram hashes.

A word is a maximal run of bytes other than space and 0x09-0x0D. Hashes are 64-bit
multilinear sums (random multiplier for each position, random value for each byte) with a
final mix, so that two given sequences collide with a chance near 2**-57.
"""

from __future__ import annotations

import ctypes
import functools
import gc
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at once: temporaries are some 60 times as large.
SLICE_BYTES = 1 << 19

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_U = np.uint64


_HELD: dict[str, Callable[[], None]] = {}
#: Of the C library, where it has it.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None) if os.name == "posix" else None


def turn_to(owner: str, forget: Callable[[], None] | None = None) -> None:
    """Called where a worker begins a task: what it remembers for other operators is dropped.
    ``forget`` drops what it will remember for this one."""
    for name in [x for x in _HELD if x != owner]:
        _HELD.pop(name)()
        gc.collect()
    if forget:
        _HELD[owner] = forget


def release() -> None:
    """Give memory that is free in this process back to the machine."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def tidy(over_batches: Callable) -> Callable:
    """For functions over batches: memory that a task has freed goes back to the machine when it
    ends, so that workers that wait for another task are small."""

    @functools.wraps(over_batches)
    def run(*args):
        yield from over_batches(*args)
        release()

    return run


def splitmix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser over uint64 values."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64, copy=True)
        x += _U(0x9E3779B97F4A7C15)
        x ^= x >> _U(30)
        x *= _U(0xBF58476D1CE4E5B9)
        x ^= x >> _U(27)
        x *= _U(0x94D049BB133111EB)
        x ^= x >> _U(31)
    return x


def mix(x: np.ndarray) -> np.ndarray:
    """A cheaper in-place finaliser."""
    with np.errstate(over="ignore"):
        x ^= x >> _U(32)
        x *= _U(0xD6E8FEB86659FD93)
        x ^= x >> _U(29)
        x *= _U(0x9FB21C651E98DF25)
        x ^= x >> _U(32)
    return x


def _byte_values(lower: bool) -> np.ndarray:
    v = splitmix(np.arange(256, dtype=np.uint64) + _U(7_000_003)) | _U(1)
    if lower:
        v[65:91] = v[97:123]
    v[SPACE] = 0
    return v


_VALUES = {False: _byte_values(False), True: _byte_values(True)}
_POSITIONS = splitmix(np.arange(256, dtype=np.uint64) + _U(11_000_027)) | _U(1)
_GRAM = splitmix(np.arange(64, dtype=np.uint64) + _U(13_000_133)) | _U(1)


def _positions(n: int) -> np.ndarray:
    global _POSITIONS
    if n > len(_POSITIONS):
        _POSITIONS = splitmix(np.arange(1 << (n - 1).bit_length(), dtype=np.uint64) + _U(11_000_027)) | _U(1)
    return _POSITIONS


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = pc.cast(column, pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    buffers = column.buffers()
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data, offsets


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes; a longer text makes a range of its own."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


class Words:
    """Words of some rows: byte bounds in ``data``, and ``first``, the index of each row's first word."""

    __slots__ = ("data", "offsets", "starts", "ends", "first", "counts")

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        base = int(offsets[0]) if len(offsets) else 0
        data = data[base : int(offsets[-1])]
        offsets = offsets - base
        self.data, self.offsets = data, offsets
        n = len(data)
        space = SPACE[data]
        word = ~space
        edge = offsets[(offsets > 0) & (offsets < n)]
        before = np.empty(n, bool)
        after = np.empty(n, bool)
        if n:
            before[0] = after[-1] = True
            before[1:] = space[:-1]
            after[:-1] = space[1:]
            before[edge] = True
            after[edge - 1] = True
        before &= word
        after &= word
        self.starts = np.flatnonzero(before)
        self.ends = np.flatnonzero(after) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each word; ``lower`` lower-cases A-Z first."""
        starts = self.starts
        if not len(starts):
            return np.zeros(0, np.uint64)
        a = int(starts[0])
        data = self.data[a:]
        gaps = np.diff(np.append(starts, len(self.data)))
        at = np.arange(len(data)) - np.repeat(starts - a, gaps)
        longest = int((self.ends - starts).max())
        np.minimum(at, longest, out=at)
        with np.errstate(over="ignore"):
            v = _VALUES[lower][data]
            v *= _positions(longest + 1)[at]
            return mix(np.add.reduceat(v, starts - a))

    def grams(self, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash of the k words from each word on, whether they are all in its row)."""
        n = len(hashes)
        if n < k:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        with np.errstate(over="ignore"):
            g = hashes[: n - k + 1] * _GRAM[0]
            for j in range(1, k):
                g += hashes[j : n - k + 1 + j] * _GRAM[j]
        left = np.repeat(self.first[1:], self.counts)[: n - k + 1]
        return mix(g), np.arange(n - k + 1) + k <= left


def cover(flags: np.ndarray, k: int, n: int) -> np.ndarray:
    """Of n items, those within a window of k that starts where ``flags`` is set."""
    at = np.flatnonzero(flags)
    step = np.bincount(at, minlength=n + 1) - np.bincount(np.minimum(at + k, n), minlength=n + 1)
    return np.cumsum(step[:n]) > 0
