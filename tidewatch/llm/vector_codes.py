"""Operator 13 - product codes of vectors by slicing sorted coordinates with entry masks.

Each part position has a codebook of at most 64 entries.  For every dimension its
entries are sorted by coordinate, and a mask is kept of the entries before each place
of that order.  A radius selects a range per dimension; the masks at the range's ends
give its entries, and the AND over the dimensions gives the entries in the cube.  A
nearest entry of the cube that lies within the radius is the nearest of all; else the
cube is taken again with that entry's distance, or twice the radius where it was empty.

The vectors are written once as integers; every round reads them, sums each task's parts
by entry and adds these few sums up.  Only codebooks reach the driver: parts x entries x
length of a part numbers, whatever the table's size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut
from .text_arrays import ranges

SCALE = 4096
#: Integers are held to this range, so that squared distances of parts of 512 components fit in 64 bits.
MOST = 2**26
ENTRIES = 64


class Codebook:
    """Entries of one part position, (entries, length) integers, ready for slicing."""

    def __init__(self, entries: np.ndarray):
        n = len(entries)
        if not 0 < n <= ENTRIES:
            raise ValueError(f"a codebook has 1 to {ENTRIES} entries")
        self.entries = entries
        order = np.argsort(entries, axis=0, kind="stable").T
        self.sorted = np.take_along_axis(entries.T, order, axis=1)
        bits = np.uint64(1) << order.astype(np.uint64)
        self.masks = np.concatenate([np.zeros((len(order), 1), np.uint64), np.bitwise_or.accumulate(bits, axis=1)], axis=1)
        between = ((entries[:, None, :] - entries[None, :, :]) ** 2).sum(2)
        apart = np.sort(between, axis=1)[:, min(1, n - 1)]
        self.radius = 1 + int(np.sqrt(float(np.median(apart))))

    def candidates(self, x: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Mask of the entries within ``radius`` in every dimension, for each row."""
        found = np.full(len(x), ~np.uint64(0))
        for column, order, mask in zip(x.T, self.sorted, self.masks, strict=True):
            found &= mask[np.searchsorted(order, column + radius, "right")] ^ mask[np.searchsorted(order, column - radius, "left")]
        return found

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of each row's nearest entry (of equals the lowest) and its squared distance."""
        index, distance = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        left, radius = np.arange(len(x)), np.full(len(x), self.radius, np.int64)
        while len(left):
            mask = self.candidates(x[left], radius)
            row, entry = np.nonzero(mask[:, None] >> np.arange(len(self.entries), dtype=np.uint64) & np.uint64(1))
            apart = ((x[left[row]] - self.entries[entry]) ** 2).sum(1)
            order = np.lexsort((entry, apart, row))
            first = order[np.flatnonzero(np.diff(row[order], prepend=-1))]
            some, best = row[first], apart[first]
            index[left[some]], distance[left[some]] = entry[first], best
            near = np.ceil(np.sqrt(best.astype(np.float64))).astype(np.int64) + 1
            done = np.zeros(len(left), bool)
            done[some] = best <= radius[some] ** 2
            radius *= 2
            radius[some] = near
            left, radius = left[~done], radius[~done]
        return index, distance


def assign(x: np.ndarray, books: list[Codebook]) -> tuple[np.ndarray, np.ndarray]:
    """Codes and squared distances, (rows, parts), of (rows, parts, length) integers."""
    found = [book.nearest(x[:, p]) for p, book in enumerate(books)]
    return np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def integers(vectors: DataFrame, parts: int, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """id, label, body (32-bit integers) and size of the well-formed rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("vector")
            column = column.filter(there := pc.is_valid(column))
            lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = pc.fill_null(column.flatten().cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False)
            at = np.concatenate([[0], np.cumsum(lengths)])
            odd = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
            good = (odd[at[1:]] == odd[at[:-1]]) & (lengths > 0) & (lengths % parts == 0)
            with np.errstate(invalid="ignore"):
                whole = np.where(np.isfinite(flat), np.clip(np.floor(flat * SCALE), -MOST, MOST), 0).astype("<i4")
            lengths, at = lengths[good], at[:-1][good]
            own = whole[np.repeat(at, lengths) + ranges(lengths)]
            body = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(np.concatenate([[0], 4 * np.cumsum(lengths)]).astype(np.int64)), pa.py_buffer(own.tobytes())])
            rows = batch.filter(there).filter(pa.array(good))
            yield pa.RecordBatch.from_arrays([rows.column("id"), rows.column("label"), body.cast(pa.binary()), pa.array(lengths, pa.int32())], names=["id", "label", "body", "size"])

    read = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    return read.mapInArrow(run, f"id long, label {read.schema['label'].dataType.simpleString()}, body binary, size int")


def parts_of(column: pa.Array, parts: int) -> np.ndarray:
    """(rows, parts, length) 64-bit integers of a column of equally long bodies."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, "<i4")[at[0] // 4 : at[-1] // 4].reshape(len(column), parts, -1).astype(np.int64)


def sums_by_entry(rows: DataFrame, books: list[np.ndarray]) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """(part, entry) -> number and component sums of the parts that it is nearest to."""
    parts, length = len(books), books[0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, k = [Codebook(b) for b in books], len(books[0])
        count, total = np.zeros((parts, k), np.int64), np.zeros((parts, k, length), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = parts_of(batch.column("body"), parts)
            codes, _ = assign(x, own)
            for p in range(parts):
                count[p] += np.bincount(codes[:, p], minlength=k)
                order = np.argsort(codes[:, p], kind="stable")
                seen, first = np.unique(codes[order, p], return_index=True)
                total[p, seen] += np.add.reduceat(x[order, p], first, axis=0)
        part, entry = np.nonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(count[part, entry]), *[pa.array(total[part, entry, j]) for j in range(length)]],
            names=["part", "entry", "n", *[f"s{j}" for j in range(length)]],
        )

    columns = ["n", *[f"s{j}" for j in range(length)]]
    found = rows.select("body").mapInArrow(run, "part int, entry int, " + ", ".join(f"{c} long" for c in columns))
    found = found.groupBy("part", "entry").agg(*[F.sum(c).alias(c) for c in columns])
    return {(r["part"], r["entry"]): (r["n"], list(r[3:])) for r in found.collect()}


def renewed(books: list[np.ndarray], sums: dict[tuple[int, int], tuple[int, list[int]]]) -> list[np.ndarray]:
    """Each entry replaced by the floored mean of its parts; unused entries stay."""
    out = [b.copy() for b in books]
    for (part, entry), (n, total) in sums.items():
        out[part][entry] = [s // n for s in total]
    return out


def product_codes(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """id, code, error, label_error and codebooks_sha256 of every well-formed row.

    Dropped are rows whose vector is null, empty, not to be cut into ``parts`` equal parts,
    or holds null or non-finite components, and rows of another length than the vector of
    the smallest id.  A component x counts as floor(4096 * x), held within 2**26 either way.
    Codebooks start as the parts of the rows with the ``entries`` smallest ids (all, if
    fewer), null ids last, rows of one id by their vectors; repeated rows each count.
    ``code`` has two hex digits a part, ``label_error`` sums ``error`` over rows of an equal
    label, null labels together.  An empty table gives an empty result.
    """
    if not 0 < entries <= ENTRIES:
        raise ValueError(f"entries must be 1 to {ENTRIES}")
    rows = cut(integers(vectors, parts, id_col, vector_col, label_col))
    order = [F.col("id").asc_nulls_last(), "body"]
    first = rows.orderBy(*order).first()
    size = first["size"] if first else parts
    rows = rows.filter(F.col("size") == size)
    start = [np.frombuffer(r["body"], "<i4").astype(np.int64).reshape(parts, -1) for r in rows.orderBy(*order).limit(entries).collect()]
    books = [np.array([s[p] for s in start]) for p in range(parts)] if start else []
    for _ in range(rounds if books else 0):
        books = renewed(books, sums_by_entry(rows, books))
    digest = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [Codebook(b) for b in books]
        for batch in batches:
            if not batch.num_rows:
                continue
            codes, distance = assign(parts_of(batch.column("body"), parts), own)
            digits = codes.astype(np.uint8).tobytes().hex()
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label"), pa.array([digits[i : i + 2 * parts] for i in range(0, len(digits), 2 * parts)], pa.string()), pa.array(distance.sum(1))],
                names=["id", "label", "code", "error"],
            )

    coded = cut(rows.select("id", "label", "body").mapInArrow(run, f"id long, label {rows.schema['label'].dataType.simpleString()}, code string, error long"))
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of"))).select("id", "label", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
