"""Numpy views of Arrow text columns: bytes, words, lines and rolling hashes.

All functions work on one slice of an Arrow batch (a few MB), so memory in a task
is bounded by the slice, or by a single document where one is longer.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 3 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_WORD_BASE = 0xD1342543DE82EF95  # odd, so it has an inverse mod 2**64
#: [\x20\x09-\x0D], the white space that separates words everywhere here.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(4)
def byte_codes(fold: bool) -> np.ndarray:
    """A random 64-bit value for each byte; ``fold`` gives A-Z those of a-z."""
    codes = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
    if fold:
        codes[65:91] = codes[97:123]
    return codes


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and ``base**-i`` mod 2**64 for i < n; kept for the next slice."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        steps = np.full((2, size), 1, np.uint64)
        steps[0, 1:], steps[1, 1:] = base, pow(base, -1, 2**64)
        have = tuple(np.multiply.accumulate(steps, axis=1))
        if size <= 2 * SLICE_BYTES:
            _powers[base] = have
    return have


def slices(batches: Iterator[pa.RecordBatch], most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each has about ``most`` bytes of text (column ``text``)."""
    try:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            first = 0
            while first < n:
                before = ends[first - 1] if first else 0
                last = max(first + 1, int(np.searchsorted(ends, before + most, side="right")))
                yield batch.slice(first, last - first)
                first = last
    finally:
        release()


def release() -> None:
    """Give back what a task leaves: workers are used again, by other operators too."""
    _powers.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts one after another, and the n + 1 offsets; null: empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def runs(inside: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values, none across a document's border."""
    edge = np.zeros(len(inside) + 1, bool)
    edge[at] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:-1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words, and n + 1 offsets of the documents' words."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    start, end = runs(~SPACE[data], at)
    return start, end, np.searchsorted(start, at)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, fold: bool = False) -> np.ndarray:
    """A 64-bit hash of each byte span, by prefix sums of a polynomial."""
    power, inverse = powers(_WORD_BASE, len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(byte_codes(fold)[data] * power[: len(data)], out=total[1:])
    return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64) * _ODD)


def window_hashes(values: np.ndarray, size: int, base: int = 0xA24BAED4963EE407) -> np.ndarray:
    """Hash of each ``size`` consecutive values; also of windows across borders."""
    n = len(values)
    if n < size:
        return np.zeros(0, np.uint64)
    power, inverse = powers(base, n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values * power[:n], out=total[1:])
    return mix((total[size:] - total[:-size]) * inverse[: n - size + 1])


def windows_inside(at: np.ndarray, size: int, n: int) -> np.ndarray:
    """For n - size + 1 windows: whether they lie within one document."""
    count = max(0, n - size + 1)
    mark = np.zeros(count + 1, np.int32)
    has = np.diff(at) >= size
    np.add.at(mark, at[:-1][has], 1)
    np.add.at(mark, at[1:][has] - size + 1, -1)
    return np.cumsum(mark[:count]) > 0


def sliding(values: np.ndarray, size: int, pick=np.minimum) -> np.ndarray:
    """``pick`` over each ``size`` neighbours, by doubling."""
    width, out = 1, values
    while 2 * width <= size:
        out = pick(out[:-width], out[width:])
        width *= 2
    return out if width == size else pick(out[: len(out) - size + width], out[size - width :])


def strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[bytes]:
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]


def doc_of(at: np.ndarray) -> np.ndarray:
    """The document's number for each element, from n + 1 offsets."""
    return np.repeat(np.arange(len(at) - 1), np.diff(at))


def ranges(lengths: np.ndarray) -> np.ndarray:
    """0..l-1 for each length l, one after another."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.arange(total) - np.repeat(ends - lengths, lengths)


def gather(flat: np.ndarray, offsets: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows ``index`` of a ragged array, flat, and their lengths."""
    lengths = offsets[index + 1] - offsets[index]
    return flat[np.repeat(offsets[index], lengths) + ranges(lengths)], lengths
