"""Operator 11 - ranked lexical search over an inverted index in segments of documents.

``build_index`` writes one row per segment (a bounded slice of the documents): its terms,
their lists of documents with counts, and the documents' lengths.  ``search`` takes the
items in blocks of bounded size; each task goes through its segments with the best rows
of every item so far, and returns these.  In a segment, the lists of an item's terms that
are short are summed up at once (term at a time); the sums then are one more list, with a
bound of its own, beside the long lists.  These are gone through in order of documents:
ranges whose bounds cannot reach the item's threshold are skipped, only lists that can
make a candidate are read, and the others are looked up for candidates still in reach.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut
from .spark_util import discard_table
from .text_arrays import doc_of, ranges, release, runs, slices, span_hashes, text_bytes

#: Bytes of text in a segment, and documents at most (their numbers are held in 16 bits).
SEGMENT, SEGMENT_DOCS = 6 << 20, 1 << 16
#: Bytes of terms in a block of items; an item with more is a block of its own.
BLOCK = 8 << 20
#: A list in up to one of so many documents of a segment is short.
SHORT = 16
#: Documents that share a bound, and documents gone through between two looks at the threshold.
RANGE, STEP = 256, 2048

#: [\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F] part terms.
PARTING = np.ones(256, bool)
PARTING[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

INDEX = "ids array<long>, lengths binary, hashes binary, term_at binary, terms binary, list_at binary, docs binary, counts binary, n_docs long, n_terms long"


def terms_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with A-Z lowered, starts and ends of the terms, and offsets of the texts' terms."""
    data, at = text_bytes(texts)
    if not len(data):
        return data, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    start, end = runs(~PARTING[data], at)
    return _LOWER[data], start, end, np.searchsorted(start, at)


def _segment(batch: pa.RecordBatch) -> pa.RecordBatch:
    data, start, end, at = terms_of(batch.column("text"))
    lengths = np.diff(at)
    hashes = span_hashes(data, start, end) if len(start) else np.zeros(0, np.uint64)
    order = np.argsort(hashes, kind="stable")  # within a term the documents stay ascending
    term, doc = hashes[order], doc_of(at)[order]
    new_term = np.ones(len(term), bool)
    new_term[1:] = term[1:] != term[:-1]
    new = new_term.copy()
    new[1:] |= doc[1:] != doc[:-1]
    first, head = np.flatnonzero(new), np.flatnonzero(new_term)
    list_at = np.append(np.searchsorted(first, head), len(first))
    own, sizes = _spans(data, start[order[head]], end[order[head]])
    columns = {
        "lengths": lengths.astype(np.int64), "hashes": term[head], "term_at": np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), "terms": own, "list_at": list_at.astype(np.int32),
        "docs": doc[first].astype(np.uint16), "counts": np.diff(np.append(first, len(term))).astype(np.int32),
    }
    return pa.RecordBatch.from_arrays(
        [pa.array([batch.column("id").to_pylist()], pa.list_(pa.int64())), *[pa.array([c.tobytes()], pa.binary()) for c in columns.values()], pa.array([int((lengths > 0).sum())], pa.int64()), pa.array([int(lengths.sum())], pa.int64())],
        names=["ids", *columns, "n_docs", "n_terms"],
    )


def _spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lengths = end - start
    return data[np.repeat(start, lengths) + ranges(lengths)], lengths


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per segment, columns INDEX; every row and every term of ``docs`` is in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, SEGMENT):
            for first in range(0, part.num_rows, SEGMENT_DOCS):
                yield _segment(part.slice(first, SEGMENT_DOCS))

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, INDEX)


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item, term (bytes): the distinct terms of each item id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            data, start, end, at = terms_of(part.column("text"))
            own, sizes = _spans(data, start, end)
            body = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)), pa.py_buffer(own.tobytes())])
            yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(doc_of(at))), body.cast(pa.binary())], names=["item", "term"])

    return items.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "item long, term binary").distinct()


@dataclass
class Block:
    """Items and their terms: hashes ascending, bytes, each item's places in them, weights."""

    items: list[int | None]
    hashes: np.ndarray
    terms: list[bytes]
    places: list[np.ndarray]
    weights: np.ndarray | None = None
    documents: int = 0
    words: int = 0


def _block(rows: pa.Table) -> Block:
    terms = sorted(set(rows.column("term").to_pylist()))
    sizes = np.array([len(t) for t in terms], np.int64)
    ends = np.cumsum(sizes)
    hashes = span_hashes(np.frombuffer(b"".join(terms), np.uint8), ends - sizes, ends)
    order = np.argsort(hashes, kind="stable")
    terms = [terms[i] for i in order]
    place = {t: i for i, t in enumerate(terms)}
    held: dict[int | None, list[int]] = {}
    for item, term in zip(rows.column("item").to_pylist(), rows.column("term").to_pylist(), strict=True):
        held.setdefault(item, []).append(place[term])
    return Block(list(held), hashes[order], terms, [np.sort(np.array(p)) for p in held.values()])


class Segment:
    """One row of the index as arrays."""

    def __init__(self, batch: pa.RecordBatch, k: int):
        read = lambda c, kind: np.frombuffer(batch.column(c)[k].as_buffer(), kind)
        self.ids = batch.column("ids")[k].values if "ids" in batch.schema.names else None
        self.hashes, self.list_at = read("hashes", np.uint64), read("list_at", np.int32).astype(np.int64)
        self.term_at, self.terms = read("term_at", np.int32), batch.column("terms")[k].as_buffer()
        if self.ids is not None:
            self.lengths, self.docs, self.counts = read("lengths", np.int64), read("docs", np.uint16).astype(np.int64), read("counts", np.int32).astype(np.int64)

    def find(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """Which terms of the block the segment has, and their places in it; equal in bytes."""
        if not len(self.hashes) or not len(block.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, block.hashes), len(self.hashes) - 1)
        hit = np.flatnonzero(self.hashes[at] == block.hashes)
        raw = memoryview(self.terms).cast("B")
        same = [raw[self.term_at[p] : self.term_at[p + 1]] == block.terms[t] for t, p in zip(hit.tolist(), at[hit].tolist(), strict=True)]
        hit = hit[np.array(same, bool)]
        return hit, at[hit]


class Best:
    """The k best (score, id) of an item: highest score first, then smallest id, null ids last."""

    def __init__(self, k: int):
        self.k = k
        self.scores, self.ids, self.null = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    @property
    def threshold(self) -> int:
        """The least score that can still enter."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def offer(self, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        scores, ids, null = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids]), np.concatenate([self.null, null])
        order = np.lexsort((ids, null, -scores))[: self.k]
        self.scores, self.ids, self.null = scores[order], ids[order], null[order]


def _bounds(docs: np.ndarray, scores: np.ndarray, n: int) -> np.ndarray:
    """The largest score in each range of RANGE documents."""
    out = np.zeros(-(-n // RANGE), np.int64)
    if len(docs):
        block = docs // RANGE
        head = np.flatnonzero(np.diff(block, prepend=-1))
        out[block[head]] = np.maximum.reduceat(scores, head)
    return out


def summed(docs: list[np.ndarray], scores: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Documents of all lists, ascending, with their summed scores."""
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    doc, score = np.concatenate(docs), np.concatenate(scores)
    order = np.argsort(doc, kind="stable")
    doc = doc[order]
    head = np.flatnonzero(np.diff(doc, prepend=-1))
    return doc[head], np.add.reduceat(score[order], head) if len(head) else score


def _looked_up(lists: tuple[np.ndarray, np.ndarray], docs: np.ndarray) -> np.ndarray:
    own, scores = lists
    at = np.minimum(np.searchsorted(own, docs), len(own) - 1)
    return np.where(own[at] == docs, scores[at], 0)


def best_of_item(lists: list[tuple[np.ndarray, np.ndarray]], bounds: dict[int, np.ndarray], keys: list[int], n: int, best: Best, ids: np.ndarray, null: np.ndarray) -> None:
    """Offer ``best`` every document of the segment that can enter.

    ``lists`` are (documents, scores) of the item's terms, ``keys`` their names in ``bounds``,
    which keeps the long lists' bounds by range for other items.
    """
    short = [i for i, (docs, _) in enumerate(lists) if len(docs) * SHORT <= n]
    rest = [i for i in range(len(lists)) if i not in set(short)]
    iterators, by_range = [lists[i] for i in rest], []
    for i in rest:
        if keys[i] not in bounds:
            bounds[keys[i]] = _bounds(*lists[i], n)
        by_range.append(bounds[keys[i]])
    if short:
        sums = summed([lists[i][0] for i in short], [lists[i][1] for i in short])
        iterators.append(sums)
        by_range.append(_bounds(*sums, n))
    tops = np.array([b.max() for b in by_range])
    if tops.sum() < best.threshold:
        return
    order = np.argsort(tops, kind="stable")
    iterators, by_range, tops = [iterators[i] for i in order], np.stack([by_range[i] for i in order]), tops[order]
    reach = by_range.sum(0)
    for begin in range(0, n, STEP):
        least, blocks = best.threshold, slice(begin // RANGE, (begin + STEP) // RANGE)
        alive = reach[blocks] >= least
        if not alive.any():
            continue
        # Lists that together stay below the threshold cannot make a candidate alone.
        top = np.cumsum(by_range[:, blocks].max(1))
        needed = int(np.searchsorted(top, least))
        got = []
        for docs, scores in iterators[needed:]:
            a, b = np.searchsorted(docs, (begin, begin + STEP))
            inside = alive[(docs[a:b] - begin) // RANGE]
            got.append((docs[a:b][inside], scores[a:b][inside]))
        docs, total = summed([d for d, _ in got], [s for _, s in got])
        for i in range(needed - 1, -1, -1):
            hopeful = total + by_range[: i + 1, docs // RANGE].sum(0) >= least
            docs, total = docs[hopeful], total[hopeful]
            if not len(docs):
                break
            total = total + _looked_up(iterators[i], docs)
        enough = total >= least
        if enough.any():
            best.offer(total[enough], ids[docs[enough]], null[docs[enough]])


def search_segment(segment: Segment, block: Block, found: list[Best]) -> None:
    """Go through one segment with all items of the block."""
    hit, place = segment.find(block)
    if not len(hit):
        return
    n, lengths = len(segment.lengths), np.diff(segment.list_at)[place]
    posting = np.repeat(segment.list_at[place], lengths) + ranges(lengths)
    docs, tf = segment.docs[posting], segment.counts[posting]
    norm = 50 + (50 * segment.lengths * block.documents) // block.words
    scores = np.repeat(block.weights[hit], lengths) * ((1_000_000_000 * tf) // (1000 * tf + 20 * norm[docs]))
    at = np.concatenate([[0], np.cumsum(lengths)])
    ids = segment.ids.fill_null(0).to_numpy(zero_copy_only=False)
    null = segment.ids.is_null().to_numpy(zero_copy_only=False)
    own = np.full(len(block.hashes), -1, np.int64)
    own[hit] = np.arange(len(hit))
    bounds: dict[int, np.ndarray] = {}
    for places, best in zip(block.places, found, strict=True):
        keys = own[places]
        keys = keys[keys >= 0].tolist()
        if keys:
            best_of_item([(docs[at[k] : at[k + 1]], scores[at[k] : at[k + 1]]) for k in keys], bounds, keys, n, best, ids, null)


def _frequencies(index: DataFrame, block: Block) -> np.ndarray:
    """In how many documents each term of the block is."""
    shared = index.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shared.value.hashes), np.int64)
        for batch in batches:
            for k in range(batch.num_rows):
                segment = Segment(batch, k)
                hit, place = segment.find(shared.value)
                total[hit] += np.diff(segment.list_at)[place]
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["term", "n"])

    out = np.zeros(len(block.hashes), np.int64)
    rows = index.select("hashes", "list_at", "term_at", "terms").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out[rows.column("term").to_numpy()] = rows.column("n").to_numpy()
    return out


def _search(index: DataFrame, block: Block, k: int) -> DataFrame:
    """item, doc_id, score, task: the k best of each item in each task."""
    shared = index.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [Best(k) for _ in shared.value.items]
        for batch in batches:
            for row in range(batch.num_rows):
                search_segment(Segment(batch, row), shared.value, found)
        sizes = [len(b.scores) for b in found]
        items = pa.array(shared.value.items, pa.int64()).take(pa.array(np.repeat(np.arange(len(found)), sizes)))
        whole = lambda c, kind: np.concatenate([np.zeros(0, kind), *[getattr(b, c) for b in found]])
        yield pa.RecordBatch.from_arrays([items, pa.array(whole("ids", np.int64), mask=whole("null", bool)), pa.array(whole("scores", np.int64))], names=["item", "doc_id", "score"])
        release()

    columns = ["ids", "lengths", "hashes", "term_at", "terms", "list_at", "docs", "counts"]
    return index.select(columns).mapInArrow(run, "item long, doc_id long, score long").withColumn("task", F.spark_partition_id())


def search(index: DataFrame, items: DataFrame, k: int = 50, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of ``index`` for each item.

    Terms are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z
    lowered.  Scores are those of the module's formula in whole numbers: weight
    floor(1000 * ln((2N + 2) / (2 df + 1))) times (10**9 tf) div (1000 tf + 20 m), with
    m = 50 + (50 n N) div L, summed over an item's distinct terms; documents with score 0
    are no answer.  Equal scores go by id, null ids last; repeated rows of documents each
    have a rank.  Rows with one item id (null is one) are one item with the terms of all.
    Items without terms and empty tables give no rows.

    Items go in blocks of BLOCK bytes of terms; a block is what is broadcast.  The best
    rows of the tasks are merged in two steps, so that no task gets more than k times
    about the square root of the number of tasks for an item.
    """
    stats = index.agg(F.sum("n_docs"), F.sum("n_terms"), F.count("*")).first()
    terms = cut(item_terms(items, item_col, text_col))
    size = terms.agg(F.sum(F.octet_length("term"))).first()[0] or 0
    blocks = -(-size // BLOCK)
    best, tasks = None, 1
    for b in range(blocks if stats[0] else 0):
        block = _block(terms.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).toArrow())
        block.documents, block.words = stats[0], stats[1]
        block.weights = np.floor(1000 * np.log((2 * stats[0] + 2) / (2.0 * _frequencies(index, block) + 1))).astype(np.int64)
        own = cut(_search(index, block, k))
        tasks, best = max(tasks, stats[2]), own if best is None else best.union(own)
    if best is None:
        best = index.sparkSession.createDataFrame([], "item long, doc_id long, score long, task int")
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    first = best.withColumn("salt", F.pmod("task", F.lit(max(1, math.isqrt(tasks)))))
    first = first.withColumn("rank", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*order))).filter(F.col("rank") <= k)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= k)
    return ranked.select(F.col("item").alias("item_id"), "rank", "doc_id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """``search`` over the index of all ``docs``; the index goes when the answers are written."""
    index = cut(build_index(docs))
    out = cut(search(index, items, k))
    discard_table(index)
    return out
