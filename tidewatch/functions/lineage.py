"""Cutting a plan's lineage with a written table."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, else the folder given to ``setCheckpointDir``, else (on one
    machine only, where driver and executors share its disk) a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return folder or tempfile.mkdtemp(prefix="spark-checkpoint-")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table below ``checkpoint_folder`` and read it from there.

    A table, not ``checkpoint()``: that hands the optimizer's constraints on, which double
    with every derived column.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that ``cut`` wrote."""
    spark = df.sparkSession
    for name in df.inputFiles()[:1]:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name.rsplit("/", 1)[0])
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
