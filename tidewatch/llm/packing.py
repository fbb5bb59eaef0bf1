"""Operator 5 - sum-of-squares packing of token pieces into fixed windows.

Documents are encoded and cut in map tasks: whole windows first, the rest is one
piece.  Only piece descriptions travel.  Documents are dealt to groups of bounded
size by hash; within a group pieces are placed one after another at the fill level
that makes the sum of squared level counts smallest.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import encoder, text_batches
from .spark_util import cut

#: Documents in a packing group: a bounded task, and enough pieces to fill windows well.
GROUP_DOCS = 16_384
PIECES = "id long, k long, start long, length long, ids_crc32 long, doc_tokens long"


class LevelArray:
    """Counts of partly filled windows by fill level; places pieces one at a time."""

    def __init__(self, size: int):
        self.size = size
        self.count = np.zeros(size + 1, np.int64)  # count[0] and count[size] stay 0
        self.open: list[list[int]] = [[] for _ in range(size + 1)]
        self.windows = 0

    def place(self, length: int) -> tuple[int, int]:
        """(window, offset) of a piece of 1 to ``size`` tokens."""
        if length == self.size:
            self.windows += 1
            return self.windows - 1, 0
        # From level h to h + length the sum of squares changes by 2(N[h+length] - N[h]) + 2,
        # by 1 less where the window becomes full, by 2N[length] + 1 for a new window.
        levels = self.count[1 : self.size - length + 1]
        change = np.where(levels > 0, 2 * (self.count[length + 1 :] - levels) + 2, np.iinfo(np.int64).max)
        change[-1] -= levels[-1] > 0
        best = len(change) - 1 - int(np.argmin(change[::-1]))  # of equals the fullest
        if change[best] >= 2 * self.count[length] + 1:
            self.windows += 1
            window, level = self.windows - 1, 0
        else:
            level = best + 1
            window = self.open[level].pop()
            self.count[level] -= 1
        if level + length < self.size:
            self.open[level + length].append(window)
            self.count[level + length] += 1
        return window, level


def token_pieces(docs: DataFrame, vocabulary_path: str, size: int = 1024, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    """The pieces of every row: its ids and one ``end_id``, cut every ``size`` ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocabulary_path)
        ending = np.array([end_id], "<u4")
        for batch, texts in text_batches(batches):
            ids, at = e.encode(texts)
            rows: list[tuple[int, int, int, int, int]] = []
            for doc, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                own = np.concatenate([ids[a:b].astype("<u4"), ending])
                rows += [(doc, s, min(size, len(own) - s), zlib.crc32(own[s : s + size].tobytes()), len(own)) for s in range(0, len(own), size)]
            columns = np.array(rows, np.int64).T
            doc = pa.array(columns[0])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(doc), batch.column("k").take(doc), *[pa.array(c, pa.int64()) for c in columns[1:]]],
                names=["id", "k", "start", "length", "ids_crc32", "doc_tokens"],
            )

    identity = F.col(id_col).cast("long")
    read = docs.select(identity.alias("id"), F.xxhash64(identity, F.col(text_col)).alias("k"), F.col(text_col).alias("text"))
    return read.mapInArrow(run, PIECES)


def _pack(size: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["k", "start"], kind="stable")
        levels = LevelArray(size)
        placed = [levels.place(n) for n in rows["length"].tolist()]
        return rows.assign(window=[w for w, _ in placed], offset=[o for _, o in placed])

    return run


def pack_pieces(pieces: DataFrame, size: int = 1024, group_docs: int = GROUP_DOCS) -> DataFrame:
    """``pieces`` with sequence_id (from 0 without gaps) and offset in the sequence.

    The number of groups follows the number of documents; what stays open at the end of
    a group is its only padding.  Sequence numbers come from running sums of the
    groups' window counts.  Pieces of zero length do not exist: every document has the
    closing id, also an empty or null text.
    """
    n = pieces.filter("start = 0").count()
    groups = max(1, math.ceil(n / group_docs))
    dealt = pieces.withColumn("pack", F.pmod(F.xxhash64("k"), F.lit(groups)).cast("int"))
    packed = cut(dealt.groupBy("pack").applyInPandas(_pack(size), f"{PIECES}, pack int, window long, offset long"))
    totals = packed.groupBy("pack").agg((F.max("window") + 1).alias("windows"))
    before = Window.orderBy("pack").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("pack", F.coalesce(F.sum("windows").over(before), F.lit(0)).alias("first"))
    return packed.join(starts, "pack").withColumn("sequence_id", F.col("first") + F.col("window")).drop("pack", "window", "first")


def pack_documents(docs: DataFrame, vocabulary_path: str, size: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` encoded, cut and packed; see ``token_pieces`` and ``pack_pieces``."""
    return pack_pieces(cut(token_pieces(docs, vocabulary_path, size, id_col, text_col)), size)
