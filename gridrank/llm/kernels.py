"""Vectorised work on the bytes of Arrow text columns: words, their hashes, word shingles."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, 256, dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256)
_LOWER[65:91] += 32
#: The random number of each byte, with A-Z read as a-z.
_FOLDED = _BYTES[_LOWER]
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, n - 1).bit_length() if n > 1 << 16 else 1 << 16
        with np.errstate(over="ignore"):
            have = np.full(size, base, _U)
            have[0] = 1
            np.multiply.accumulate(have, out=have)
        _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: equal inputs stay equal, others look random."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def tidy(run: Callable) -> Callable:
    """run, a function of Arrow batches, that hands freed memory back to the machine when it ends: workers live on and share an executor's."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return whole


def release() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def text_chunks(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, byte offsets) of runs of about `most` bytes; a null is an empty text, a longer text is a run by itself."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    n = len(column)
    if not n:
        return
    _, where, body = column.buffers()
    at = np.frombuffer(where, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(at, at[a] + most, "right")) - 1)
        yield a, min(b, n), data[at[a] : at[min(b, n)]], at[a : min(b, n) + 1] - at[a]
        a = b


def words(data: np.ndarray, at: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of the runs of bytes other than x20 and x09-x0D, and the texts' offsets among them."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, _U), np.zeros(len(at), np.int64)
    space = _SPACE[data]
    before, after = np.empty(len(data), bool), np.empty(len(data), bool)
    before[0] = after[-1] = True
    before[1:], after[:-1] = space[:-1], space[1:]
    inner = at[(at > 0) & (at < len(data))]
    before[inner], after[inner - 1] = True, True
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, _U)
        np.cumsum((_FOLDED if fold else _BYTES)[data] * _power(_BASE, len(data)), out=total[1:])
        hashes = mix((total[ends] - total[starts]) * _power(_INVERSE, len(data))[starts] + (ends - starts).astype(_U))
    return starts, ends, hashes, np.searchsorted(starts, at)


_FACTORS = [_U(x | 1) for x in (0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def shingles(hashes: np.ndarray, at: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles, with repeats, and the texts' offsets among them. Fewer words: one shingle of all; none: none."""
    n = np.diff(at)
    many = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    out = np.concatenate([[0], np.cumsum(many)])
    found = np.zeros(out[-1], _U)
    with np.errstate(over="ignore"):
        if len(hashes) >= k:
            sums = hashes[: len(hashes) - k + 1] * _FACTORS[0]
            for j in range(1, k):
                sums = sums + hashes[j : len(hashes) - k + 1 + j] * _FACTORS[j % 5] * _U(2 * (j // 5) + 1)
            sums = mix(sums)
            long = n >= k
            first = np.repeat(at[:-1][long] - out[:-1][long], many[long])
            slots = np.flatnonzero(np.repeat(long, many))
            found[slots] = sums[slots + first]
        for d in np.flatnonzero((n > 0) & (n < k)):
            h = _U(n[d])
            for x in hashes[at[d] : at[d + 1]]:
                h = mix(np.array([h * _FACTORS[0] + x], _U))[0]
            found[out[d]] = h
    return found, out
