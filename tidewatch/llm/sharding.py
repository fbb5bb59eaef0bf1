"""Operator 1 - contiguous shards of near equal bytes by global prefix sums.

Rows are laid out once in id order over range partitions.  Each partition gives one
total; a running sum over these few totals makes every local running sum a global
one, and the global sum is cut at equal targets.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .spark_util import cut, width


def byte_prefix_shards(docs: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """Assign every row to one of ``n_shards`` contiguous shards of near equal bytes.

    A row's size is its UTF-8 bytes plus 8 (null text: 8).  It goes to the shard that
    holds the middle of its byte range, so a shard differs from the equal target by at
    most one document.  Null ids come first; rows with equal ids are ordered by text,
    equal rows stay in the order read.  A document larger than a target leaves shards
    empty; with no rows the result is empty.

    Returns id, size, text_crc32 (of the UTF-8 text, null: of the empty text), shard,
    slot (place in the shard, from 0) and byte_start (bytes before it in all shards).
    The totals have one row per partition, the shard starts one per shard: both are
    fixed numbers, whatever the data, so they are broadcast.
    """
    spark = docs.sparkSession
    partitions = partitions or width(spark)
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long") + 8).alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(F.col(text_col)).alias("tie"),
        F.monotonically_increasing_id().alias("seen"),
    )
    order = ["id", "tie", "seen"]
    rows = cut(rows.repartitionByRange(partitions, *order).withColumn("part", F.spark_partition_id()))
    local = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        rows.groupBy("part")
        .agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
        .select(
            "part",
            F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("part_start"),
            F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_first"),
            F.sum("bytes").over(everything).alias("total"),
        )
    )
    placed = (
        rows.withColumns({
            "local_bytes": F.coalesce(F.sum("size").over(local), F.lit(0)),
            "local_rows": F.count("*").over(local),
        })
        .join(F.broadcast(totals), "part")
        .withColumns({
            "byte_start": F.col("part_start") + F.col("local_bytes"),
            "row": F.col("part_first") + F.col("local_rows"),
        })
        .withColumn("shard", F.least(F.lit(n_shards - 1).cast("long"), F.expr(f"((2 * byte_start + size) * {n_shards}) div (2 * total)")).cast("int"))
    )
    starts = placed.groupBy("shard").agg(F.min("row").alias("first_row"))
    return placed.join(F.broadcast(starts), "shard").select(
        F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("row") - F.col("first_row")).alias("slot"), "byte_start"
    )
