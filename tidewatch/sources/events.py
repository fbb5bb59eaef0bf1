"""Event log sources (S4, S5): text lines of JSON, batch or stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row (``value``) per line."""
    return spark.read.text(path)


def stream_lines(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Lines of files that land in ``folder``, in rotated pieces, as a stream.

    For a file that grows in place see ``tail.tail_lines``.
    """
    return spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder)
