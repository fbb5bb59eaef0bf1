"""Operator 3 - exact dedup against a minimal perfect hash of historical digests.

The history's distinct digests are dealt to index shards by hash.  Each shard is a
minimal perfect hash (levels of bit arrays, ranked) whose slots hold the full digest,
the group's size and the locator of its winner.  New digests are looked up shard by
shard; a slot counts only if its 32 bytes equal the digest asked for.  Digests that
are no members are grouped on their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spark_util import NULL_ID, cut
from .text_arrays import mix

#: Distinct digests in an index shard: about 6 MB of slots.
SHARD_DIGESTS = 1 << 16
_LAST_LEVEL = 60
INDEX_SCHEMA = "index_shard int, n long, level_bits binary, level_sizes array<long>, digests binary, winner_ids binary, winner_lengths binary, sizes binary"


def level_slots(digests: np.ndarray, level: int, size: int) -> np.ndarray:
    """Slot of each digest (n x 4 array of 64-bit words) in a level of ``size`` bits."""
    seed = mix(np.array([level + 1], np.uint64) * np.uint64(0x9E3779B97F4A7C15))[0]
    return mix(mix(digests[:, 0] ^ seed) ^ digests[:, 1]) % np.uint64(size)


def build_levels(digests: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Bit arrays of the levels, and each distinct digest's rank: a bijection to 0..n-1."""
    rank = np.zeros(len(digests), np.int64)
    left, levels, base = np.arange(len(digests)), [], 0
    while len(left):
        if len(levels) == _LAST_LEVEL:
            raise ValueError("digests are not distinct")
        size = max(64, 2 * len(left))
        slot = level_slots(digests[left], len(levels), size).astype(np.int64)
        alone = np.bincount(slot, minlength=size) == 1
        ranked = np.cumsum(alone) - 1
        placed = alone[slot]
        rank[left[placed]] = base + ranked[slot[placed]]
        base += int(alone.sum())
        levels.append(alone)
        left = left[~placed]
    return levels, rank


def find_slots(levels: list[np.ndarray], digests: np.ndarray) -> np.ndarray:
    """The slot to look at for each digest, -1 if no level has one."""
    slot_of = np.full(len(digests), -1, np.int64)
    left, base = np.arange(len(digests)), 0
    for number, bits in enumerate(levels):
        if not len(left):
            break
        slot = level_slots(digests[left], number, len(bits)).astype(np.int64)
        here = bits[slot]
        slot_of[left[here]] = base + (np.cumsum(bits) - 1)[slot[here]]
        base += int(bits.sum())
        left = left[~here]
    return slot_of


def _words(digests: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 4)


def _build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    digests = _words(rows["digest"])
    levels, rank = build_levels(digests)
    put = np.empty(len(rank), np.int64)
    put[rank] = np.arange(len(rank))
    packed = lambda c: rows[c].to_numpy(np.int64)[put].tobytes()
    return pd.DataFrame([{
        "index_shard": key[0], "n": len(rows), "level_bits": np.packbits(np.concatenate(levels)).tobytes(),
        "level_sizes": [len(x) for x in levels], "digests": digests[put].tobytes(),
        "winner_ids": packed("best_id"), "winner_lengths": packed("best_length"), "sizes": packed("size"),
    }])


def _look_up(asked: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    out = asked[["digest", "size", "best_length", "best_id"]].assign(member=False, old_id=0, old_length=0, old_size=0)
    if len(asked) and len(index):
        shard, digests = index.iloc[0], _words(asked["digest"])
        bits = np.unpackbits(np.frombuffer(shard["level_bits"], np.uint8)).astype(bool)
        ends = np.cumsum(shard["level_sizes"])
        slot = find_slots([bits[e - s : e] for s, e in zip(shard["level_sizes"], ends, strict=True)], digests)
        held = np.frombuffer(shard["digests"], np.uint64).reshape(-1, 4)
        member = (slot >= 0) & (held[slot] == digests).all(axis=1)
        out["member"] = member
        for to, source in (("old_id", "winner_ids"), ("old_length", "winner_lengths"), ("old_size", "sizes")):
            out[to] = np.where(member, np.frombuffer(shard[source], np.int64)[slot], 0)
    return out


def normalised_digest(text: Column) -> Column:
    """SHA-256 (binary) of the text's UTF-8 without [\\x20\\x09-\\x0D]; null: of nothing."""
    bare = F.translate(F.coalesce(text, F.lit("")), " \t\n\x0b\x0c\r", "")
    return F.unhex(F.sha2(bare, 256))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, digest, length (code points of the whole text; null: 0) for each row."""
    return docs.select(
        F.col(id_col).cast("long").alias("id"),
        normalised_digest(F.col(text_col)).alias("digest"),
        F.coalesce(F.length(F.col(text_col)), F.lit(0)).cast("long").alias("length"),
    )


def group_digests(rows: DataFrame) -> DataFrame:
    """One row per digest: size and winner (longest, then smallest id; null id last).

    The aggregate combines within map tasks, so a digest that a third of all rows
    share reaches the shuffle as one row per task.
    """
    best = F.min(F.struct((-F.col("length")).alias("l"), F.col("id").isNull().alias("u"), F.coalesce("id", F.lit(NULL_ID)).alias("i")))
    return rows.groupBy("digest").agg(F.count("*").alias("size"), best.alias("best")).select(
        "digest", "size", (-F.col("best.l")).alias("best_length"), F.col("best.i").alias("best_id")
    )


def _dealt(groups: DataFrame, shards: int) -> DataFrame:
    return groups.withColumn("index_shard", F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int"))


def index_shards(n_digests: int) -> int:
    return max(1, math.ceil(n_digests / SHARD_DIGESTS))


def build_index(history_groups: DataFrame, shards: int) -> DataFrame:
    """The history's minimal perfect hashes, a row per index shard (INDEX_SCHEMA)."""
    return _dealt(history_groups, shards).groupBy("index_shard").applyInPandas(_build, INDEX_SCHEMA)


def look_up(index: DataFrame, groups: DataFrame, shards: int) -> DataFrame:
    """``groups`` with member, and the historical winner and size where it is one."""
    schema = "digest binary, size long, best_length long, best_id long, member boolean, old_id long, old_length long, old_size long"
    return _dealt(groups, shards).groupBy("index_shard").cogroup(index.groupBy("index_shard")).applyInPandas(_look_up, schema)


def exact_dedup(history: DataFrame, incoming: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Verdicts for all rows of both tables; ``history`` is indexed, ``incoming`` looked up.

    Texts are equal when identical without [\\x20\\x09-\\x0D]; null and white texts equal
    the empty one.  Of equal texts the one with the most code points stays, then the
    smallest id; a null id loses to any other.  Rows that repeat id and length share
    the verdict.  Either table may be empty.

    Returns id, digest, keep_id, group_size, kept, seen_before (incoming rows whose
    digest the history holds).
    """
    rows = cut(digests(history, id_col, text_col).withColumn("old", F.lit(True)).unionByName(digests(incoming, id_col, text_col).withColumn("old", F.lit(False))))
    old = group_digests(rows.filter("old"))
    shards = index_shards(old.count())
    asked = cut(look_up(build_index(old, shards), group_digests(rows.filter("not old")), shards))
    members, others = asked.filter("member"), asked.filter("not member")
    order = lambda length, at: F.struct(-F.col(length), F.col(at) == NULL_ID, F.col(at))
    better = order("best_length", "best_id") < order("old_length", "old_id")
    met = members.select(
        "digest",
        (F.col("size") + F.col("old_size")).alias("size"),
        F.when(better, F.col("best_length")).otherwise(F.col("old_length")).alias("best_length"),
        F.when(better, F.col("best_id")).otherwise(F.col("old_id")).alias("best_id"),
        F.lit(True).alias("seen"),
    )
    rest = old.join(members.select("digest"), "digest", "left_anti").withColumn("seen", F.lit(False))
    groups = met.unionByName(rest).unionByName(others.select("digest", "size", "best_length", "best_id", F.lit(False).alias("seen")))
    # Only groups of several rows go back to the documents; a row without one stays.
    repeated = groups.filter("size > 1").withColumnRenamed("digest", "d")
    same = F.col("id").eqNullSafe(F.when(F.col("best_id") != NULL_ID, F.col("best_id")))
    return rows.join(repeated, F.col("digest") == F.col("d"), "left").select(
        "id",
        "digest",
        F.when(F.col("d").isNull(), F.col("id")).when(F.col("best_id") != NULL_ID, F.col("best_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("d").isNull() | (same & (F.col("length") == F.col("best_length")))).alias("kept"),
        (~F.col("old") & F.coalesce("seen", F.lit(False))).alias("seen_before"),
    )
