"""Texts of an Arrow batch as one byte array with offsets, and hashes over it; all of it numpy, a bounded slice at a time.

A slice holds about ``SLICE`` bytes of whole texts (one text, if that is longer), so memory follows the slice and the longest text, never a partition.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
#: Odd 64-bit multipliers of the two polynomials and of the final mixing.
BASE, SECOND_BASE, MIX = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD
MASK = (1 << 64) - 1

_rng = np.random.default_rng(20240229)
#: A random 64-bit value for each byte, so that short strings of equal letters don't line up.
BYTE_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SECOND_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: Powers that are made at once at least; more come by doubling, as far as a caller's slices need them.
LEAST_POWERS = 1 << 16
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to n at least; odd bases have inverses."""
    got = _powers.get(base)
    if got is None or len(got[0]) <= n:
        size = max(LEAST_POWERS, 1 << (n + 1).bit_length())
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            out = np.ones(size, np.uint64)
            k, step = 1, b
            while k < size:  # doubling: the next k powers are the first k times base**k
                m = min(k, size - k)
                out[k:k + m] = out[:m] * np.uint64(step)
                step, k = step * step & MASK, k * 2
            both.append(out)
        got = (both[0], both[1])
        if size <= SLICE * 8:
            _powers[base] = got
    return got


class Prefix:
    """Prefix polynomial hashes of a byte array: the hash of any substring in one subtraction and one product."""

    def __init__(self, data: np.ndarray, base: int = BASE, value: np.ndarray = BYTE_VALUE):
        up, self.down = powers(base, len(data))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(value[data] * up[:len(data)], out=self.sums[1:])

    def hash(self, start, end) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(MIX)
    return h ^ (h >> np.uint64(29))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows of a string column and n + 1 offsets; null is empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), off


def slices(off: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes each."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        j = min(j, n)
        yield i, j
        i = j


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes other than blanks, cut at text ends, and the number of the first word of each text."""
    gap = np.ones(len(data) + 1, bool)
    gap[:-1] = SPACE[data]
    solid = ~gap[:-1]
    first = solid.copy()
    first[1:] &= gap[:-2]
    edges = off[:-1][off[:-1] < off[1:]]  # starts of texts that aren't empty
    first[edges] = solid[edges]
    last = solid.copy()
    last &= gap[1:]
    ends = off[1:][off[:-1] < off[1:]] - 1
    last[ends] = solid[ends]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, off)


def give_back() -> None:
    """Return memory that is free to the system: workers outlive their tasks, and several stages share the memory of a machine."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass
