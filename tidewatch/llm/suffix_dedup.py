"""Operator 7 - removal of repeated byte strings with suffix arrays.

Shards of bounded size (see ``anchors``) bring together the text that can repeat.  The
suffix array of a shard is made by induced sorting: suffixes are classified, the
leftmost-smaller (LMS) substrings are sorted and named, the string of names is sorted in
the same way by recursion, and the order of all suffixes is induced from it.  Permuted
common prefixes then tell which strings occur elsewhere.  Bytes have few symbols: their
order is induced by whole buckets as numpy arrays, runs of one letter in one step.  Names
have as many symbols as places: their order is induced place by place, in linear time.
"""

from __future__ import annotations

from array import array

import numpy as np
from pyspark.sql import DataFrame

from .anchors import Windows, remove_spans, repeated_spans
from .spark_util import keyed

BYTE_WINDOWS = Windows("bytes", size=200, gram=64, shard_bytes=2_000_000)
#: Between regions; no byte of UTF-8.
SEPARATOR = b"\xff"
#: So few pairs of suffixes are compared one by one, in growing steps.
FEW = 16


def smaller_types(s: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one (s ends with a unique least symbol)."""
    step = np.sign(np.diff(s.astype(np.int32)))
    decided = np.flatnonzero(step)
    following = decided[np.searchsorted(decided, np.arange(len(step)))]
    return np.append(step[following] > 0, True)


def _deal(buckets: list[list[np.ndarray]], symbols: np.ndarray, positions: np.ndarray) -> None:
    """Append positions to their symbols' buckets, in order."""
    order = np.argsort(symbols, kind="stable")
    symbols, positions = symbols[order], positions[order]
    edges = np.concatenate([[0], np.flatnonzero(np.diff(symbols)) + 1, [len(symbols)]]).tolist()
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        buckets[symbols[a]].append(positions[a:b])


def induce(s: np.ndarray, smaller: np.ndarray, seeds: np.ndarray, n_symbols: int) -> np.ndarray:
    """Suffix order induced from LMS positions ``seeds`` that are in order within buckets."""
    larger: list[list[np.ndarray]] = [[] for _ in range(n_symbols)]
    not_smaller = ~smaller
    seeded: list[list[np.ndarray]] = [[] for _ in range(n_symbols)]
    _deal(seeded, s[seeds], seeds)
    place = np.arange(len(s), dtype=np.int32)
    run = place - np.maximum.accumulate(np.where(np.append(True, s[1:] != s[:-1]), place, 0))  # equal symbols before
    for c in range(n_symbols):
        _sweep(larger, c, s, not_smaller, run)
        if seeded[c]:
            _induce_from(np.concatenate(seeded[c]), s, not_smaller, larger)
    lesser: list[list[np.ndarray]] = [[] for _ in range(n_symbols)]  # each from its end
    lesser[0].append(np.array([len(s) - 1], seeds.dtype))
    for c in range(n_symbols - 1, -1, -1):
        _sweep(lesser, c, s, smaller, run)
        if larger[c]:
            _induce_from(np.concatenate(larger[c])[::-1], s, smaller, lesser)
    parts = [x for c in range(n_symbols) for x in [*larger[c], *[y[::-1] for y in reversed(lesser[c])]]]
    return np.concatenate(parts)


def _sweep(buckets: list[list[np.ndarray]], c: int, s: np.ndarray, wanted: np.ndarray, run: np.ndarray) -> None:
    """Fill up bucket c and induce from it.

    What came from other buckets are ends of runs of c.  Each adds the places before it in
    its run, all of its own type: first those one place before, then two before, and so on.
    """
    if not buckets[c]:
        return
    ends = np.concatenate(buckets[c])
    runs = run[ends]
    back = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs) + 1
    inner = (np.repeat(ends, runs) - back)[np.argsort(back, kind="stable")].astype(ends.dtype)
    buckets[c] = [np.concatenate([ends, inner])]
    first = buckets[c][0][run[buckets[c][0]] == 0]  # all others have c before them
    _induce_from(first, s, wanted, buckets)


def _induce_from(chunk: np.ndarray, s: np.ndarray, wanted: np.ndarray, buckets: list[list[np.ndarray]]) -> None:
    before = chunk[chunk > 0] - 1
    before = before[wanted[before]]
    if len(before):
        _deal(buckets, s[before], before)


def eight_bytes(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as one number, zeros after the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(data), np.uint64)
    for k in range(8):
        out |= padded[k : k + len(data)] << np.uint64(8 * (7 - k))
    return out


def common_prefixes(data: np.ndarray, eight: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray | None = None) -> np.ndarray:
    """Length of the common prefix of the suffixes at a and b (a != b), up to ``most``."""
    n = len(data)
    length = np.zeros(len(a), np.int64)
    limit = n - np.maximum(a, b) if most is None else np.minimum(n - np.maximum(a, b), most)
    left = np.flatnonzero(limit > 0)
    while len(left) > FEW:
        at, to = a[left] + length[left], b[left] + length[left]
        differ = eight[at] ^ eight[to]
        room = limit[left] - length[left]
        same = np.full(len(left), 8)
        uneven = differ != 0
        # Leading equal bytes of the difference: compare against falling powers of 256.
        same[uneven] = (differ[uneven, None] < (np.uint64(1) << (np.arange(7, 0, -1, dtype=np.uint64) * np.uint64(8)))).sum(axis=1)
        length[left] += np.minimum(same, room)
        left = left[(same == 8) & (room > 8)]
    for k in left.tolist():
        at, to, most_of, step = int(a[k]), int(b[k]), int(limit[k]), 64
        done = int(length[k])
        while done < most_of:
            upto = min(done + step, most_of)
            differ = data[at + done : at + upto] != data[to + done : to + upto]
            if differ.any():
                done += int(differ.argmax())
                break
            done, step = upto, 2 * step
        length[k] = done
    return length


def induce_names(s: np.ndarray, smaller: np.ndarray, seeds: np.ndarray, count: np.ndarray) -> np.ndarray:
    """As ``induce`` for any number of symbols, ``count`` of each: place by place."""
    m, ends = len(s), np.cumsum(count)
    seeds = seeds[np.argsort(s[seeds], kind="stable")]
    held = np.bincount(s[seeds], minlength=len(count))
    symbols = s[seeds]
    order = np.full(m, m)  # m: still free
    order[ends[symbols] - held[symbols] + np.arange(len(seeds)) - (np.cumsum(held) - held)[symbols]] = seeds
    packed = lambda x: array("i", x.astype(np.int32).tobytes())
    # For each place the symbol before it, where that place is of the type that is induced.
    induced = lambda of_type: packed(np.concatenate([[-1], np.where(of_type[:-1], s[:-1], -1), [-1]]))
    order, before, head = packed(order), induced(~smaller), packed(ends - count)
    for p in order:  # sees what it adds further on
        c = before[p]
        if c >= 0:
            k = head[c]
            order[k] = p - 1
            head[c] = k + 1
    before, tail = induced(smaller), packed(ends)
    for p in reversed(order):
        c = before[p]
        if c >= 0:
            k = tail[c] = tail[c] - 1
            order[k] = p - 1
    return np.array(order)


def name_substrings(lms: np.ndarray, ordered: np.ndarray, last: int, same) -> np.ndarray:
    """Names of the LMS substrings in the order of their places, equal ones alike.

    ``ordered`` holds ``lms`` in the order of their substrings; same(a, b, length) tells
    which of two have equal symbols over length + 1 places.  The last one is unique.
    """
    number = np.empty(last + 1, np.int64)
    number[lms] = np.arange(len(lms))
    length = np.append(lms[1:], last) - lms  # an LMS substring reaches to the next LMS place
    a, b = ordered[:-1].astype(np.int64), ordered[1:].astype(np.int64)
    la, lb = length[number[a]], length[number[b]]
    equal = la == lb
    check = np.flatnonzero(equal & (np.maximum(a, b) + la < last))
    equal[:] = False
    if len(check):
        equal[check] = same(a[check], b[check], la[check].astype(np.int64))
    names = np.empty(len(lms), np.int64)
    names[number[ordered]] = np.concatenate([[0], np.cumsum(~equal)])
    return names


def order_of_names(names: np.ndarray) -> np.ndarray:
    """Suffix array of a string of names 0.. (all of them occur, 0 only as the last)."""
    m, count = len(names), np.bincount(names)
    if len(count) == m:
        return np.argsort(names)
    smaller = smaller_types(names)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    ordered = induce_names(names, smaller, lms, count)
    is_lms = np.zeros(m, bool)
    is_lms[lms] = True

    def same(a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        size = length + 1
        first = np.cumsum(size) - size
        offset = np.arange(size.sum()) - np.repeat(first, size)
        return ~np.logical_or.reduceat(names[np.repeat(a, size) + offset] != names[np.repeat(b, size) + offset], first)

    inner = name_substrings(lms, ordered[is_lms[ordered]], m - 1, same)
    return induce_names(names, smaller, lms[order_of_names(inner)], count)


def suffix_array(data: np.ndarray, eight: np.ndarray | None = None) -> np.ndarray:
    """Suffix array of a byte string (uint8; ``eight`` of ``eight_bytes``), by induced sorting."""
    n = len(data)
    eight = eight_bytes(data) if eight is None else eight
    if n < 2:
        return np.arange(n)
    s = np.append(data.astype(np.int16) + 1, np.int16(0))
    smaller = smaller_types(s)
    lms = (np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1).astype(np.int32)
    symbols = 257
    ordered = induce(s, smaller, lms, symbols)
    is_lms = np.zeros(n + 1, bool)
    is_lms[lms] = True
    names = name_substrings(lms, ordered[is_lms[ordered]], n, lambda a, b, length: common_prefixes(data, eight, a, b, length + 1) > length)
    return induce(s, smaller, lms[order_of_names(names)], symbols)[1:]


def permuted_common_prefixes(data: np.ndarray, eight: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place: its longest common prefix with the suffix before it in order, and
    that suffix (-1: none).

    Where the two are preceded by equal bytes, the value is that of the place before less
    one; only the other places are compared.
    """
    n = len(order)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    place = np.arange(n)
    compare = (place == 0) | (before <= 0) | (data[place - 1] != data[np.maximum(before, 1) - 1])
    value = np.zeros(n, np.int64)
    own = np.flatnonzero(compare & (before >= 0))
    value[own] = common_prefixes(data, eight, own, before[own])
    source = np.maximum.accumulate(np.where(compare, place, 0))
    return np.maximum(value[source] - (place - source), 0), before


def repeats_anywhere(blobs: list[bytes], size: int = BYTE_WINDOWS.size, keep_first: bool = False) -> list[list[tuple[int, int]]]:
    """For each region the maximal spans covered by ``size``-byte strings found elsewhere
    too; with ``keep_first`` by those found earlier."""
    data = np.frombuffer(SEPARATOR.join(blobs), np.uint8)
    eight = eight_bytes(data)
    order = suffix_array(data, eight)
    value, before = permuted_common_prefixes(data, eight, order)
    found = np.flatnonzero(value >= size)
    start = np.zeros(len(data) + 1, np.int64)
    start[found] = 1
    start[before[found]] = 1
    if keep_first:  # strings with a common prefix of that size are neighbours in the order
        groups = np.flatnonzero(value[order] < size)
        start[np.minimum.reduceat(order, groups)] = 0
    lengths = np.array([len(b) for b in blobs])
    first = np.cumsum(lengths + 1) - lengths - 1
    out = []
    for a, n in zip(first.tolist(), lengths.tolist(), strict=True):
        at = np.flatnonzero(start[a : a + max(0, n - size + 1)])
        if not len(at):
            out.append([])
            continue
        gap = np.flatnonzero(np.diff(at) > size) + 1
        out.append(list(zip(at[np.concatenate([[0], gap])].tolist(), (at[np.append(gap, len(at)) - 1] + size).tolist(), strict=True)))
    return out


def _solver(size: int, keep_first: bool):
    return lambda blobs: repeats_anywhere(blobs, size, keep_first)


def suffix_dedup(docs: DataFrame, windows: Windows = BYTE_WINDOWS, keep_first: bool = False, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Every row's UTF-8 bytes without those in strings that also start anywhere else.

    A string has ``windows.size`` bytes and lies in one document; overlapping
    occurrences count.  With ``keep_first`` only strings that also start earlier (smaller
    id, null first, or same document and earlier start) are removed.  Shorter documents, empty and null texts stay as they are.  Rows
    that repeat id and text are one document.

    Returns id, kept (binary: a cut may split a character), n_elements (bytes),
    n_removed, n_spans (maximal removed runs), and the columns ``carry``.
    """
    read = keyed(docs, *carry, id_col=id_col, text_col=text_col)
    spans = repeated_spans(read.select("id", "k", "text"), windows, _solver(windows.size, keep_first), all_copies=not keep_first)
    return remove_spans(read, spans, windows, *carry)
