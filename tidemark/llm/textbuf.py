"""Vectorised byte-level work on Arrow string columns.

A column of texts is one contiguous byte buffer plus offsets.  Everything here
runs on slices of whole texts of a few MB, so the numpy temporaries of a Python
worker stay small whatever the size of the Arrow batch.  Spark keeps a worker for
other tasks, so what a task has freed goes back to the system at its end (lean()).
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once.  One longer text is handled alone, in pieces where the operator can.
SLICE_BYTES = 1 << 19
#: Words beyond so many bytes are hashed one by one.
LONG_WORD = 256

_RNG = np.random.Generator(np.random.PCG64(20240229))
BYTE_KEYS = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it

Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def give_back() -> None:
    """Returns to the system what allocators keep of freed memory; an executor's limit counts it, also while a worker is idle."""
    _powers.clear()
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def lean(run: Run) -> Run:
    """A function for mapInArrow that gives memory back at the end of its task."""

    def to_the_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return to_the_end


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, int64 offsets) of a string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64 if large else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``limit`` bytes, or of one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 1024)
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=np.uint64)
        if size <= 64 << 20:
            _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def word_prints(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of words: eight bytes at a time through a chain that is not linear in them, long ones by BLAKE2.

    Not for equality by itself: what acts on equal words compares the words.
    """
    size = end - start
    out = mix(size.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
    if len(size) == 0:
        return out
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.as_strided(padded.view(np.uint8), (len(data) + 1, 8), (1, 1))
    long_ = np.flatnonzero(size > LONG_WORD)
    for k in long_.tolist():
        out[k] = np.frombuffer(hashlib.blake2b(data[start[k] : end[k]].tobytes(), digest_size=8).digest(), np.uint64)[0]
    todo = np.flatnonzero(size <= LONG_WORD) if len(long_) else np.arange(len(size))
    at, left = start[todo], size[todo]
    while len(todo):
        value = np.ascontiguousarray(eight[at]).view("<u8")[:, 0]
        short = left < 8
        value[short] &= (np.uint64(1) << (left[short] * 8).astype(np.uint64)) - np.uint64(1)
        out[todo] = mix((out[todo] ^ value) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1))
        more = left > 8
        todo, at, left = todo[more], at[more] + 8, left[more] - 8
    return out


class RollingHash:
    """64-bit fingerprints of any substring of a buffer in constant time.

    A polynomial modulo 2^64: long texts of a regular build can share one, so it
    only finds places to look at and never decides that two texts are equal.
    """

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE_KEYS[data] * _power(BASE, n), out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        inverse = _power(BASE_INV, len(self.sums))
        return mix((self.sums[end] - self.sums[start]) * inverse[start])

    def grams(self, k: int) -> np.ndarray:
        """Fingerprints of every k-byte substring, in order."""
        n = len(self.sums) - k
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((self.sums[k:] - self.sums[:-k]) * _power(BASE_INV, len(self.sums))[:n])


def space_pieces(data: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Stretches of one text that end where a run of white space does, of about ``limit`` bytes; a longer word is not cut."""
    lo, n = 0, len(data)
    while lo < n:
        hi = min(n, lo + limit)
        if hi < n:
            gap = SPACE[data[lo:hi]]
            ends = np.flatnonzero(gap[:-1] & ~gap[1:])
            if len(ends):
                hi = lo + int(ends[-1]) + 1
            else:
                while hi < n and not (SPACE[data[hi - 1]] and not SPACE[data[hi]]):
                    step = data[hi - 1 : hi + limit]
                    gap = SPACE[step]
                    ends = np.flatnonzero(gap[:-1] & ~gap[1:])
                    hi = hi + int(ends[0]) if len(ends) else min(n, hi + limit)
                    if len(ends):
                        break
        yield lo, hi
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the words between ASCII white space; none crosses rows."""
    n = len(data)
    if n == 0:
        return (np.zeros(0, np.int64),) * 3
    space = SPACE[data]
    first = ~space
    first[1:] &= space[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[heads] = ~space[heads]
    last = ~space
    last[:-1] &= space[1:]
    last[heads[1:] - 1] = ~space[heads[1:] - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of arange(s, s + n) for each s, n."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    out = np.arange(total, dtype=np.int64)
    out += np.repeat(starts - (ends - lengths), lengths)
    return out
