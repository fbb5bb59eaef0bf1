"""Bring together all text that can repeat, without comparing documents in pairs.

Operators 4 and 7 ask which windows of ``size`` elements (words or bytes) occur more
than once.  A window always contains the smallest hash of its grams (a gram has ``gram``
elements), and equal windows contain the same one at the same place.  So:

1. anchors: in each document the grams that are smallest in some window;
2. an anchor that occurs once in the corpus lies in no repeated window; for the others
   the smallest (32-bit) document number that has it is its leader and gives its shard;
3. regions: the text around the anchors of one shard, overlapping ones merged.

Equal windows meet in the shard of their common anchor.  Shards hold about
``shard_bytes``; equal regions travel as one; a shard that is still larger is cut into
chunks of which every two meet in a task, so no task holds more than two chunks.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spark_util import NULL_ID, cut, keyed, width
from .text_arrays import byte_codes, doc_of, slices, sliding, span_hashes, text_bytes, window_hashes, windows_inside, words


@dataclass(frozen=True)
class Windows:
    """What repeats: ``size`` consecutive elements, found by grams of ``gram`` elements."""

    unit: str  # "words" or "bytes"
    size: int
    gram: int
    shard_bytes: int

    @property
    def span(self) -> int:
        """Neighbouring grams in a window."""
        return self.size - self.gram + 1

    def elements(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Codes of the elements, their byte starts and ends, offsets of the documents."""
        if self.unit == "bytes":
            place = np.arange(len(data))
            return byte_codes(False)[data], place, place + 1, at
        start, end, element_at = words(data, at)
        return span_hashes(data, start, end), start, end, element_at

    def bytes_per_element(self) -> int:
        return 1 if self.unit == "bytes" else 7


def anchor_places(codes: np.ndarray, at: np.ndarray, w: Windows) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the grams that are smallest in some window of their document."""
    n = len(codes)
    if n < w.size:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = window_hashes(codes, w.gram)
    least = np.where(windows_inside(at, w.size, n), sliding(grams, w.span), np.uint64(0))
    pad = np.zeros(w.span - 1, np.uint64)
    place = np.flatnonzero(sliding(np.concatenate([pad, least, pad]), w.span, np.maximum) == grams)
    return place, grams[place]


def anchors(docs: DataFrame, w: Windows) -> DataFrame:
    """h (gram hash), k (document), pos (element in the document)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            codes, _, _, at = w.elements(*text_bytes(batch.column("text")))
            place, hashes = anchor_places(codes, at, w)
            doc = np.searchsorted(at, place, side="right") - 1
            key = batch.column("k").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes.view(np.int64)), pa.array(key[doc]), pa.array((place - at[doc]).astype(np.int32))], names=["h", "k", "pos"]
            )

    return docs.select("k", "text").mapInArrow(run, "h long, k long, pos int")


def repeated_anchors(docs: DataFrame, w: Windows) -> DataFrame:
    """k, pos, leader of the anchors that occur more than once.

    Counting combines in map tasks; the way back is an equi-join whose hot keys adaptive
    execution splits.
    """
    found = anchors(docs, w)
    leaders = cut(found.groupBy("h").agg(F.count("*").alias("n"), F.min(F.hash("k")).alias("leader")).filter("n > 1").drop("n"))
    return cut(found.join(leaders, "h").select("k", "pos", "leader"))


REGION = "shard int, id long, k long, start int, n int, digest binary, blob binary"


def _regions(w: Windows) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, byte_at = text_bytes(batch.column("text"))
            _, start, end, at = w.elements(data, byte_at) if w.unit == "words" else (None, np.arange(len(data)), np.arange(1, len(data) + 1), byte_at)
            lists = batch.column("places")
            doc = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            packed = lists.flatten().to_numpy()
            order = np.lexsort((packed, doc))
            doc, packed = doc[order], packed[order]
            shard, place = packed >> 32, at[doc] + (packed & 0xFFFFFFFF)
            low, high = np.maximum(place - w.span + 1, at[doc]), np.minimum(place + w.size, at[doc + 1])
            new = np.ones(len(doc), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (shard[1:] != shard[:-1]) | (low[1:] > high[:-1])
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(doc)) - 1
            whole = high[last] - low[first] >= w.size
            first, last = first[whole], last[whole]
            low, high, doc, shard = low[first], high[last], doc[first], shard[first]
            raw = data.tobytes()
            blobs = [raw[a:b] for a, b in zip(start[low].tolist(), end[high - 1].tolist(), strict=True)] if len(low) else []
            row = pa.array(doc)
            yield pa.RecordBatch.from_arrays([
                pa.array(shard.astype(np.int32)), batch.column("id").take(row), batch.column("k").take(row),
                pa.array((low - at[doc]).astype(np.int32)), pa.array((high - low).astype(np.int32)),
                pa.array([hashlib.blake2b(b, digest_size=16).digest() for b in blobs], pa.binary()), pa.array(blobs, pa.binary()),
            ], names=["shard", "id", "k", "start", "n", "digest", "blob"])

    return run


def regions(docs: DataFrame, w: Windows) -> DataFrame:
    """The regions of all shards (REGION); shards follow the amount of repeated text."""
    places = repeated_anchors(docs, w)
    spacing = (w.span + 1) / 2 * w.bytes_per_element()
    shards = max(width(docs.sparkSession), math.ceil(places.count() * spacing / w.shard_bytes))
    packed = F.shiftleft(F.pmod("leader", F.lit(shards)).cast("long"), 32) + F.col("pos")
    lists = places.groupBy("k").agg(F.collect_list(packed).alias("places"))
    return cut(docs.join(lists, "k").select("id", "k", "text", "places").mapInArrow(_regions(w), REGION))


Solver = Callable[[list[bytes]], list[list[tuple[int, int]]]]


def _solve(solver: Solver) -> Callable:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates(["k", "start"]).sort_values(["id", "k", "start"], kind="stable")
        spans = solver(rows["blob"].tolist())
        counts = np.array([len(s) for s in spans])
        flat = np.array([x for s in spans for x in s], np.int64).reshape(-1, 2)
        start = np.repeat(rows["start"].to_numpy(), counts)
        return pd.DataFrame({"k": np.repeat(rows["k"].to_numpy(), counts), "first": start + flat[:, 0], "last": start + flat[:, 1]})

    return run


def repeated_spans(docs: DataFrame, w: Windows, solver: Solver, all_copies: bool) -> DataFrame:
    """k and spans (array of first << 32 | last element) to remove from that document.

    ``solver`` gets the regions of a task in the order (id, k, start), null ids first, and
    returns spans for each.  Of equal regions only the first goes to a solver; the others
    are spans as a whole, and so is the first if ``all_copies``.
    """
    found = regions(docs.withColumn("id", F.coalesce("id", F.lit(NULL_ID))), w)
    place = F.struct("id", "k", "start")
    groups = found.groupBy("shard", "digest")
    alone = groups.agg(F.min(F.struct("id", "k", "start", "n", "blob")).alias("r")).select("shard", "r.*")
    large = (
        alone.groupBy("shard").agg(F.sum(F.octet_length("blob")).alias("b")).filter(F.col("b") > 2 * w.shard_bytes)
        .select("shard", F.ceil(F.col("b") / w.shard_bytes).cast("int").alias("chunks"))
    )
    own = F.pmod(F.xxhash64("k", "start"), F.col("chunks")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("chunks") - 1), lambda x: x != F.col("own"))
    paired = (
        alone.join(large, "shard", "left").withColumn("own", own)
        .withColumn("other", F.explode(F.when(F.col("chunks").isNull(), F.array(F.lit(0))).otherwise(others)))
        .withColumn("own", F.coalesce("own", F.lit(0)))
        .withColumns({"a": F.least("own", "other"), "b": F.greatest("own", "other")})
        .select("shard", "a", "b", "id", "k", "start", "blob")
    )
    solved = paired.groupBy("shard", "a", "b").applyInPandas(_solve(solver), "k long, first int, last int")
    bounds = cut(groups.agg(F.min(place).alias("least"), F.max(place).alias("most")).filter("least < most").withColumnsRenamed({"digest": "d", "shard": "s"}))
    copies = found.join(bounds, (F.col("shard") == F.col("s")) & (F.col("digest") == F.col("d")))
    if not all_copies:
        copies = copies.filter(place > F.col("least"))
    copies = copies.select("k", F.col("start").alias("first"), (F.col("start") + F.col("n")).alias("last"))
    packed = F.shiftleft(F.col("first").cast("long"), 32) + F.col("last")
    return cut(solved.unionByName(copies).groupBy("k").agg(F.collect_set(packed).alias("spans")))


def remove_spans(docs: DataFrame, spans: DataFrame, w: Windows, *carry: str) -> DataFrame:
    """id, kept (binary), n_elements, n_removed, n_spans, and ``carry``, for every row.

    Words kept are joined by one space; bytes kept are joined as they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, byte_at = text_bytes(batch.column("text"))
            if w.unit == "words":
                start, end, at = words(data, byte_at)
            else:
                at = byte_at
            lists = batch.column("spans")
            doc = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            packed = lists.flatten().to_numpy()
            mark = np.zeros(at[-1] + 1, np.int64)
            np.add.at(mark, at[doc] + (packed >> 32), 1)
            np.add.at(mark, at[doc] + (packed & 0xFFFFFFFF), -1)
            gone = np.cumsum(mark[:-1]) > 0
            removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[at])
            run_start = gone.copy()
            run_start[1:] &= ~gone[:-1]
            borders = at[:-1][at[:-1] < len(gone)]
            run_start[borders] = gone[borders]
            n_runs = np.diff(np.concatenate([[0], np.cumsum(run_start)])[at])
            if w.unit == "words":
                raw, held = data.tobytes(), np.flatnonzero(~gone)
                kept_at = np.searchsorted(held, at).tolist()
                parts = [raw[a:b] for a, b in zip(start[held].tolist(), end[held].tolist(), strict=True)]
                kept = [b" ".join(parts[a:b]) for a, b in zip(kept_at[:-1], kept_at[1:], strict=True)]
            else:
                held_at = (at - np.concatenate([[0], np.cumsum(gone)])[at]).tolist()
                raw = data[~gone].tobytes()
                kept = [raw[a:b] for a, b in zip(held_at[:-1], held_at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *[batch.column(c) for c in carry], pa.array(kept, pa.binary()), pa.array(np.diff(at), pa.int64()), pa.array(removed, pa.int64()), pa.array(n_runs, pa.int64())],
                names=["id", *carry, "kept", "n_elements", "n_removed", "n_spans"],
            )

    joined = docs.join(spans, "k", "left").withColumn("spans", F.coalesce("spans", F.array().cast("array<long>")))
    kinds = "".join(f"{c} {docs.schema[c].dataType.simpleString()}, " for c in carry)
    return joined.select("id", "text", "spans", *carry).mapInArrow(run, f"id long, {kinds}kept binary, n_elements long, n_removed long, n_spans long")
