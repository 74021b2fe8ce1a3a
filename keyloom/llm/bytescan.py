"""Vectorised scans over the UTF-8 bytes of a batch of texts.

A batch is one Arrow string column. The kernels work on slices of about
``SLICE_BYTES`` bytes, cut at document boundaries, so that temporaries stay
small whatever the batch holds; a longer document is a slice of its own.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
#: Odd multiplier of the rolling hash and its inverse modulo 2**64.
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

#: byte -> byte with A-Z lowered.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: byte -> is it one of the separators 0x20, 0x09-0x0D?
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: byte -> is it a digit, a letter a-z, A-Z or part of a character beyond ASCII?
IS_ALNUM = np.zeros(256, dtype=bool)
IS_ALNUM[0x30:0x3A] = IS_ALNUM[0x41:0x5B] = IS_ALNUM[0x61:0x7B] = IS_ALNUM[0x80:] = True

_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers (at least) of the multiplier and of its inverse."""
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 2)
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that all bits of the result are usable."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if pa.types.is_string(column.type):
        kind = np.int32
    elif pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.large_string()), np.int64
    _, where, what = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(where, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(what, dtype=np.uint8) if what is not None else np.zeros(0, np.uint8)
    return data, offsets


def slices(data: np.ndarray, offsets: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first document, document after the last, bytes, offsets from 0) of each slice."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1
        last = min(n, max(last, first + 1))
        at, to = offsets[first], offsets[last]
        yield first, last, data[at:to], offsets[first : last + 1] - at
        first = last


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, runs of each document): maximal runs of True inside documents."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    before = np.empty(len(inside), dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    cuts = offsets[:-1]
    before[cuts[cuts < len(inside)]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(len(inside), dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    cuts = offsets[1:]
    after[cuts[cuts > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    per_doc = np.diff(np.searchsorted(starts, offsets))
    return starts, ends, per_doc


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points, byte where each starts, and the end) of valid UTF-8."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    points = data[at].astype(np.int32)
    many = np.flatnonzero(points >= 0xC0)
    first, start = points[many], at[many]
    size = 2 + (first >= 0xE0) + (first >= 0xF0)
    value = first & (0x7F >> size)
    for k in range(1, 4):
        more = size > k
        value[more] = value[more] << 6 | data[start[more] + k] & 0x3F
    points[many] = value
    return points, np.append(at, len(data))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes, equal for equal spans; the spans ascend."""
    out = np.empty(len(starts), dtype=np.uint64)
    first = 0
    # a stretch of about SLICE_BYTES at a time: the temporaries take 8 bytes for each of its bytes
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + SLICE_BYTES, side="right")))
        base, part = starts[first], data[starts[first] : ends[last - 1]]
        up, down = powers(len(part) + 1)
        sums = np.empty(len(part) + 1, dtype=np.uint64)
        sums[0] = 0
        terms = part.astype(np.uint64)
        terms += np.uint64(1)
        terms *= up[: len(part)]
        np.cumsum(terms, out=sums[1:])
        s, e = starts[first:last] - base, ends[first:last] - base
        raw = (sums[e] - sums[s]) * down[s]
        out[first:last] = mix(raw ^ ((e - s).astype(np.uint64) << np.uint64(48)))
        first = last
    return out


def per_document(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of the values of each document, whose values stand one after another."""
    out = np.zeros(len(counts), dtype=np.float64 if values.dtype.kind == "f" else np.int64)
    filled = np.flatnonzero(counts)
    if len(filled):
        # each document is summed by itself, so its sum doesn't depend on its neighbours
        out[filled] = np.add.reduceat(values.astype(out.dtype, copy=False), (np.cumsum(counts) - counts)[filled])
    return out


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, whose worker gives the memory of its batches back to the system when a partition ends.

    Workers live on between tasks, and an executor's memory holds them all.
    """

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return tidy
