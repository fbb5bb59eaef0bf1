"""Interpolated modified Kneser-Ney over symbols: n-gram codes, and one shard of a count table.

A symbol has ten bits and stands for a code point below 512; others are two or three
symbols (digits of base 512, marked but for the last), so nothing is merged.  An n-gram is
the number of its ORDER symbols, the last one lowest; zeros stand before a document.

A shard holds whole families: all n-grams with the same two symbols before the last one.
Orders 3 to ORDER of a family need nothing else; orders 1 and 2 (2**20 n-grams at most)
come as a base table that every shard gets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .text_arrays import mix

ORDER, BITS = 6, 10
SYMBOLS = 1 << BITS
#: Orders up to this one are in the base table.
BASE = 2
#: Discounts are made from the n-grams that occur 1, 2, 3 and 4 times.
KINDS = 4

#: Ascending n-grams and their counts.
Table = tuple[np.ndarray, np.ndarray]


def symbols(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all texts one after another, and the n + 1 offsets; null: empty."""
    column = pc.fill_null(column, "")
    points = np.frombuffer("".join(column.to_pylist()).encode("utf-32-le"), np.uint32)
    lengths = pc.utf8_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.concatenate([[0], np.cumsum(lengths)])
    half = SYMBOLS // 2
    if not len(points) or points.max() < half:
        return points.astype(np.uint16), at
    digits = 1 + (points >= half).astype(np.int64) + (points >= half * half)
    end = np.concatenate([[0], np.cumsum(digits)])
    out = np.zeros(end[-1], np.uint16)
    out[end[1:] - 1] = points % half
    for back in (1, 2):
        long = digits > back
        out[end[1:][long] - 1 - back] = half + (points[long] // half**back) % half
    return out, end[at]


def grams(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The n-gram of order ORDER that ends at each symbol."""
    out = data.astype(np.uint64)
    place = np.arange(len(data)) - np.repeat(at[:-1], np.diff(at))
    for back in range(1, ORDER):
        out[back:] |= np.where(place[back:] >= back, data[:-back], 0).astype(np.uint64) << np.uint64(BITS * back)
    return out


def suffix(codes: np.ndarray, n: int) -> np.ndarray:
    return codes & np.uint64((1 << BITS * n) - 1)


def shard_of(codes: np.ndarray, shards: int) -> np.ndarray:
    """By the two symbols before the last one."""
    return (mix(suffix(codes >> np.uint64(BITS), 2) + np.uint64(1)) % np.uint64(shards)).astype(np.int64)


def summed(codes: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct codes, ascending, and the sum of each column for each."""
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
    return codes[first], *[np.add.reduceat(c[order], first) if len(first) else c for c in columns]


def tables(codes: np.ndarray, counts: np.ndarray, top: int = ORDER, least: int = BASE + 1) -> dict[int, Table]:
    """The orders ``top`` down to ``least``: below ``top``, an n-gram counts the distinct symbols seen before it."""
    out = {top: (codes, counts)}
    for n in range(top - 1, least - 1, -1):
        out[n] = np.unique(suffix(out[n + 1][0], n), return_counts=True)
    return out


def kinds(counts: np.ndarray) -> np.ndarray:
    """How many n-grams occur once, twice, ... KINDS times."""
    return np.array([(counts == k).sum() for k in range(1, KINDS + 1)], np.int64)


def discounts(seen: np.ndarray) -> np.ndarray:
    """D1, D2, D3+ of an order from its ``kinds``, kept within (0, count)."""
    y = seen[0] / max(seen[0] + 2 * seen[1], 1)
    return np.array([min(k - 0.1, max(0.1, k - (k + 1) * y * seen[k] / max(seen[k - 1], 1))) for k in (1, 2, 3)])


def find(values: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ascending ``values`` and whether each asked value is there."""
    if not len(values):
        return np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
    place = np.minimum(np.searchsorted(values, asked), len(values) - 1)
    return place, values[place] == asked


class Model:
    """Probabilities from the tables of some orders and a discount for each (``discounts``)."""

    def __init__(self, held: dict[int, Table], taken: dict[int, np.ndarray]):
        self.levels = []
        for n in sorted(held):
            codes, counts = held[n]
            if len(codes):
                d = taken[n][np.minimum(counts, 3) - 1]
                context = codes >> np.uint64(BITS)
                first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
                total = np.add.reduceat(counts.astype(float), first)
                self.levels.append((n, codes, counts - d, context[first], total, np.add.reduceat(d, first) / total))

    def probabilities(self, asked: np.ndarray, below: np.ndarray) -> np.ndarray:
        """Of the last symbol of each asked n-gram; ``below`` has those of the next lower order."""
        p = below
        for n, codes, left, contexts, total, weight in self.levels:
            own = suffix(asked, n)
            context, known = find(contexts, own >> np.uint64(BITS))
            place, seen = find(codes, own)
            p = np.where(seen, left[place] / total[context], 0.0) + np.where(known, weight[context], 1.0) * p
        return p
