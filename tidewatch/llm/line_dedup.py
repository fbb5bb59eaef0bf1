"""Operator 8 - removal of repeated multi-line chunks.

Lines with a word are hashed; a rolling hash runs over neighbouring line hashes, and a
chunk ends where it is least among its neighbours, so a border depends only on the lines
around it and inserted lines shift nothing else.  Every chunk has two such lines or more.
Chunk hashes that occur once are dropped early.  For the others the chunks' bytes are
fetched and grouped by these bytes; all but the first occurrence are removed, and with
them the lines before and after, as far as they equal, byte by byte, those of the first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spark_util import NULL_ID, cut, keyed, let_go
from .text_arrays import SPACE, mix, powers, slices, span_hashes, text_bytes, window_hashes

#: Lines whose hashes are rolled into one.
ROLL = 2
#: Lines with a word that a chunk has at least.
LEAST_LINES = 2
#: Chunks on each side that may hold the rest of a repeated passage: the lines outside move one border at most.
NEIGHBOURS = 2
_MOST = np.uint64(2**64 - 1)


def lines(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the lines (split at \\n), and n + 1 offsets of the documents' lines."""
    breaks = np.flatnonzero(data == 10)
    owner = np.concatenate([np.arange(len(at) - 1), np.searchsorted(at, breaks, side="right") - 1])
    order = np.argsort(owner, kind="stable")
    start = np.concatenate([at[:-1], breaks + 1])[order]
    line_at = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(at) - 1))])
    end = np.append(start[1:] - 1, 0)
    end[line_at[1:] - 1] = at[1:]
    return start, end, line_at


def borders(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether a chunk ends with each line; ``at`` are n + 1 offsets of the documents' lines.

    A border stands at strict minima of the rolling hash, and at every second place of a
    plateau (one line many times), never less than LEAST_LINES before the document's end.
    """
    n = len(hashes)
    place = np.arange(n) - np.repeat(at[:-1], np.diff(at))
    left = np.repeat(at[1:], np.diff(at)) - 1 - np.arange(n)
    rolled = np.full(n + 2, _MOST)  # with a wall on both sides
    rolled[ROLL : n + 1] = window_hashes(hashes, ROLL) if n >= ROLL else _MOST
    rolled[1:-1][place < ROLL - 1] = _MOST
    now = rolled[1:-1]
    border = (now < rolled[:-2]) & (now < rolled[2:])
    level = np.concatenate([[False], now[1:] == now[:-1]]) & (now != _MOST) if n else np.zeros(0, bool)
    first = np.maximum.accumulate(np.where(level, 0, np.arange(n))) if n else np.zeros(0, np.int64)
    into = np.arange(n) - first
    more = np.append(level[1:], False) if n else level
    border |= (into % 2 == 1) & more
    border &= (place >= LEAST_LINES - 1) & (left >= LEAST_LINES)
    return border


def chunks(data: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """Chunks of all documents: doc, idx (in the document), from and to (lines of the
    document), byte start and end, hash1, hash2, and multi: whether LEAST_LINES lines have
    a word; also line_at.  Lines without a word belong to the chunk that follows them."""
    start, end, line_at = lines(data, at)
    words = np.concatenate([[0], np.cumsum(~SPACE[data])])
    full = np.flatnonzero(words[end] > words[start])
    full_at = np.searchsorted(full, line_at)
    ends = np.zeros(len(start), bool)
    ends[full[borders(span_hashes(data, start[full], end[full]), full_at)]] = True
    ends[line_at[1:] - 1] = True
    to = np.flatnonzero(ends) + 1
    first = np.concatenate([[0], to[:-1]])
    doc = np.repeat(np.arange(len(at) - 1), np.diff(line_at))[first] if len(start) else np.zeros(0, np.int64)
    chunk_at = np.searchsorted(doc, np.arange(len(at) - 1))
    worded = np.searchsorted(full, to) - np.searchsorted(full, first)
    return {
        "doc": doc, "idx": np.arange(len(doc)) - chunk_at[doc], "from": first - line_at[doc], "to": to - line_at[doc], "start": start[first], "end": end[to - 1],
        "hash1": span_hashes(data, start[first], end[to - 1]), "hash2": span_hashes_of(span_hashes(data, start, end), first, to),
        "multi": worded >= LEAST_LINES, "line_at": line_at, "line_start": start, "line_end": end,
    }


def span_hashes_of(values: np.ndarray, first: np.ndarray, to: np.ndarray) -> np.ndarray:
    """A second hash of each run of line hashes, independent of the byte hash."""
    power, inverse = powers(0xA24BAED4963EE407, len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * power[: len(values)], out=total[1:])
    return mix((total[to] - total[first]) * inverse[first])


def chunk_hashes(docs: DataFrame) -> DataFrame:
    """hash1, hash2, id, k, idx of every chunk with two lines or more that have a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            c = chunks(*text_bytes(batch.column("text")))
            pick = np.flatnonzero(c["multi"])
            yield pa.RecordBatch.from_arrays([
                pa.array(c["hash1"][pick].view(np.int64)), pa.array(c["hash2"][pick].view(np.int64)),
                *[batch.column(x).take(pa.array(c["doc"][pick])) for x in ("id", "k")], pa.array(c["idx"][pick].astype(np.int32)),
            ], names=["hash1", "hash2", "id", "k", "idx"])

    return docs.select("id", "k", "text").mapInArrow(run, "hash1 long, hash2 long, id long, k long, idx int")


def _flat(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, pa.Array]:
    lists = batch.column(column)
    return np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy())), lists.flatten()


def chunk_bytes(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """id, k, idx, from, to (lines), chunk (bytes), before and after (the bytes of NEIGHBOURS
    chunks) of the chunks named in ``wanted`` (k, chunks: idx and lead).

    Neighbours come with a chunk that leads its hash; with another one only where the next
    chunk on that side is not wanted itself.  They are null at the document's ends.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, at = text_bytes(batch.column("text"))
            c = chunks(data, at)
            doc, named = _flat(batch, "chunks")
            idx, lead = named.field("idx").to_numpy(), named.field("lead").to_numpy(zero_copy_only=False)
            pick = np.searchsorted(c["doc"], doc) + idx
            raw, first, last = data.tobytes(), pick - idx, np.searchsorted(c["doc"], doc, side="right") - 1
            start, end = c["start"].tolist(), c["end"].tolist()
            of = lambda a, b: pa.array([raw[start[x] : end[y]] if x <= y else None for x, y in zip(a.tolist(), b.tolist(), strict=True)], pa.binary())  # noqa: B023, E731
            row, alone = pa.array(doc), np.ones(len(c["doc"]) + 2, bool)
            alone[pick + 1] = False
            told = lambda side: lead | alone[pick + 1 + side]  # noqa: B023, E731
            none = len(c["doc"])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").take(row), batch.column("k").take(row), pa.array(idx, pa.int32()), pa.array(c["from"][pick], pa.int32()), pa.array(c["to"][pick], pa.int32()), of(pick, pick),
                    of(np.where(told(-1), np.maximum(pick - NEIGHBOURS, first), none), pick - 1), of(np.where(told(1), pick + 1, none), np.minimum(pick + NEIGHBOURS, last)),
                ],
                names=["id", "k", "idx", "from", "to", "chunk", "before", "after"],
            )

    return docs.select("id", "k", "text").join(wanted, "k").mapInArrow(run, "id long, k long, idx int, from int, to int, chunk binary, before binary, after binary")


def extended(later: DataFrame) -> DataFrame:
    """k, from, to: each later chunk with the lines around it that equal those of the first one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = lambda b: [] if b is None else b.split(b"\n")
        for batch in batches:
            first, to = batch.column("from").to_numpy().copy(), batch.column("to").to_numpy().copy()
            columns = [batch.column(c).to_pylist() for c in ("before", "first_before", "after", "first_after")]
            for i, (before, first_before, after, first_after) in enumerate(zip(*columns, strict=True)):
                first[i] -= common(split(before)[::-1], split(first_before)[::-1])
                to[i] += common(split(after), split(first_after))
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(first, pa.int32()), pa.array(to, pa.int32())], names=["k", "from", "to"])

    return later.select("k", "from", "to", "before", "first_before", "after", "first_after").mapInArrow(run, "k long, from int, to int")


def common(a: list[bytes], b: list[bytes]) -> int:
    """Equal lines from the start on."""
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def remove_lines(docs: DataFrame, gone: DataFrame, *carry: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, at = text_bytes(batch.column("text"))
            start, end, line_at = lines(data, at)
            doc, spans = _flat(batch, "spans")
            edge = np.zeros(len(start) + 1, np.int64)
            np.add.at(edge, line_at[doc] + spans.field("from").to_numpy(), 1)
            np.add.at(edge, line_at[doc] + spans.field("to").to_numpy(), -1)
            out = np.cumsum(edge[:-1]) > 0
            raw, held = data.tobytes(), np.flatnonzero(~out)
            at_line = np.searchsorted(held, line_at).tolist()
            parts = [raw[a:b] for a, b in zip(start[held].tolist(), end[held].tolist(), strict=True)]
            texts = [b"\n".join(parts[a:b]) for a, b in zip(at_line[:-1], at_line[1:], strict=True)]
            removed = np.diff(np.concatenate([[0], np.cumsum(out)])[line_at])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *[batch.column(x) for x in carry], pa.array(texts, pa.binary()).cast(pa.string()), pa.array(np.diff(line_at), pa.int64()), pa.array(removed, pa.int64())],
                names=["id", *carry, "kept_text", "n_lines", "n_removed"],
            )

    joined = docs.join(gone, "k", "left").withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<from:int,to:int>>")))
    kinds = "".join(f"{c} {docs.schema[c].dataType.simpleString()}, " for c in carry)
    return joined.select("id", "text", "spans", *carry).mapInArrow(run, f"id long, {kinds}kept_text string, n_lines long, n_removed long")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Every row's text without chunks whose bytes occur earlier, by (id, place), and without
    the lines next to them that equal those next to the first occurrence.

    A chunk has two or more lines with a word; single lines alone stay.  Null ids come first.
    An empty or null text is one empty line and stays empty.  Rows that repeat id and
    text are one document.  Hot chunks combine in map tasks, first by hash, then by
    bytes; the joins back are equi-joins that adaptive execution splits.

    Returns id, kept_text, n_lines, n_removed (lines) and ``carry``.
    """
    read = keyed(docs, *carry, id_col=id_col, text_col=text_col)
    placed = read.withColumn("id", F.coalesce("id", F.lit(NULL_ID)))
    found, place = chunk_hashes(placed), F.struct("id", "k", "idx")
    repeated = cut(found.groupBy("hash1", "hash2").agg(F.count("*").alias("c"), F.min(place).alias("lead")).filter("c > 1").drop("c"))
    wanted = found.join(repeated, ["hash1", "hash2"]).groupBy("k").agg(F.collect_set(F.struct("idx", (place == F.col("lead")).alias("lead"))).alias("chunks"))
    held = cut(chunk_bytes(placed, cut(wanted)))
    least = cut(held.groupBy("chunk").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first < last").select("first.*", "first"))
    around = held.join(least, ["id", "k", "idx"]).select("chunk", "first", F.col("before").alias("first_before"), F.col("after").alias("first_after")).dropDuplicates(["chunk"])
    gone = cut(extended(held.join(cut(around), "chunk").filter(place > F.col("first"))).distinct().groupBy("k").agg(F.collect_list(F.struct("from", "to")).alias("spans")))
    del found, repeated, wanted, held, least, around  # the last join is the caller's; its files go before
    let_go(docs.sparkSession)
    return remove_lines(read, gone, *carry)
