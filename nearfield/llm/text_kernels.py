"""Numpy kernels over Arrow string columns, shared by the text operators.

Everything here works on one Arrow batch inside a task: it neither knows Spark's plan nor
keeps state between batches.  Nulls count as empty texts throughout.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that the kernels take at a time: their working arrays are a few times this size.
SLICE_BYTES = 4 << 20

RELEASE_BYTES = 4 << 20
#: glibc's own way of doing so, where the C library has it.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)

#: The bytes that separate words: 0x20 and 0x09 to 0x0D.  They never occur inside a UTF-8 character.
SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


_done, _settled = 0, False
#: glibc's number for the size from which an allocation is a mapping of its own, and that size: such memory goes back when it is freed.
_MMAP_THRESHOLD, MAPPED_BYTES = -3, 1 << 20


def settle() -> None:
    """Makes this worker give back large arrays as soon as they are freed: it stays for the tasks of later stages, beside others."""
    global _settled
    if not _settled:
        _settled = True
        adjust = getattr(ctypes.CDLL(None), "mallopt", None)
        if adjust is not None:
            adjust(_MMAP_THRESHOLD, MAPPED_BYTES)
        pa.set_memory_pool(pa.system_memory_pool())


def release(size: int, settled: bool = True) -> None:
    """Gives freed memory back to the machine, each time that size bytes of input add up to RELEASE_BYTES: a worker that waits for its
    next task should hold little."""
    global _done
    if settled:
        settle()
    _done += size
    if _done >= RELEASE_BYTES:
        _done = 0
        pa.default_memory_pool().release_unused()
        if _TRIM is not None:
            _TRIM(0)


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = SLICE_BYTES, settled: bool = True) -> Iterator[pa.RecordBatch]:
    """Consecutive runs of whole rows with about max_bytes of text each; a longer row comes alone.  The worker is settled, unless its many
    short-lived arrays would make that dear."""
    if settled:
        settle()
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + max_bytes, side="right")))
        yield batch.slice(start, stop - start)
        start = stop
    release(batch.nbytes, settled)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's UTF-8 bytes in one array, and the len + 1 offsets of its rows."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8) if buffer is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SEPARATOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row (len + 1) the index of its first word."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~separator[data]
    first = np.empty(len(data), dtype=bool)
    first[0], first[1:] = True, ~inside[:-1]
    first[offsets[:-1][offsets[:-1] < len(data)]] = True
    last = np.empty(len(data), dtype=bool)
    last[-1], last[:-1] = True, first[1:] | ~inside[1:]
    starts = np.flatnonzero(first & inside)
    return starts, np.flatnonzero(last & inside) + 1, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes of each word."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    left = ends - starts
    hashes = mix(left.astype(np.uint64) + np.uint64(seed) * _M3 + _M3)
    at, todo = starts, None
    while len(left):
        part = eights[at]
        short = np.minimum(left, 8).astype(np.uint64) * np.uint64(8)
        part = np.where(short < 64, part & ((np.uint64(1) << (short & np.uint64(63))) - np.uint64(1)), part)
        if todo is None:
            hashes = mix(hashes ^ part * _M3)
            todo = np.flatnonzero(left > 8)
        else:
            hashes[todo] = mix(hashes[todo] ^ part * _M3)
            todo = todo[left > 8]
        at, left = starts[todo] + (ends[todo] - starts[todo] - left[left > 8]) + 8, left[left > 8] - 8
    return hashes


def window_hashes(hashes: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """The hash of hashes[i : i + width] for each i at which so many are left."""

    def pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return mix(left * _M3 + (right ^ (right >> np.uint64(32))) * _M1 + np.uint64(2 * seed + 1))

    if len(hashes) < width:
        return np.zeros(0, np.uint64)
    done, power, level = None, hashes, 1
    covered = 0
    while level <= width:
        if width & level:
            done = power if done is None else pair(done[: len(power) - covered], power[covered:]) if covered else power
            covered += level
        if level * 2 <= width:
            power = pair(power[:-level], power[level:])
        level *= 2
    return done[: len(hashes) - width + 1]


def pack_sorted(cells: np.ndarray) -> bytes:
    """Ascending non-negative integers as single-byte steps; 255 means that the step goes on."""
    steps = np.diff(cells.astype(np.int64), prepend=0)
    more, rest = np.divmod(steps, 255)
    out = np.full(len(cells) + int(more.sum()), 255, dtype=np.uint8)
    out[np.cumsum(more + 1) - 1] = rest
    return out.tobytes()


def unpack_sorted(packed: bytes) -> np.ndarray:
    """The integers that pack_sorted was given."""
    steps = np.frombuffer(packed, dtype=np.uint8)
    return np.cumsum(steps, dtype=np.int64)[steps != 255]


def ragged_positions(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices of all elements of the runs [start, start + length), one run after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)
