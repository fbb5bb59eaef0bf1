"""Small helpers shared by the operators: lineage cuts and input projection."""

from __future__ import annotations

import gc
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import checkpoint_folder

#: Stands for a null id in sort and join keys.
NULL_ID = -(2**63)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and read it from there.

    The folder is the session's ``spark.checkpoint.dir``, or the one given to
    ``setCheckpointDir``; see ``lineage.checkpoint_folder``.  Before it writes, the driver is
    asked to let go of what fed earlier cuts; while this call runs, its caller still holds
    ``df``, so its own shuffles go with the next cut or ``let_go``.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(checkpoint_folder(df.sparkSession))
    let_go(df.sparkSession)
    return df.checkpoint(eager=True)


def let_go(spark: SparkSession, wait: float = 0.0) -> None:
    """Have the driver drop shuffles and checkpoints that nothing refers to any more.

    Python tells the JVM in the background, up to a second later, which objects it has
    given up; with ``wait`` (seconds) their files go now, else with a later call.
    """
    gc.collect()
    time.sleep(wait)
    for _ in range(2):  # what goes first holds on to the shuffles
        spark.sparkContext._jvm.System.gc()
        time.sleep(wait / 4)


def bucketed(df: DataFrame, key: str, number: int) -> tuple[DataFrame, str]:
    """Write ``df`` in ``number`` buckets of ``key`` to the checkpoint folder: table and path.

    A join on ``key`` then reads it where it lies and moves the other side only, as long as
    ``number`` is not below the session's shuffle partitions.  Each task writes its own rows;
    there is no shuffle before.  Nothing deletes the files but ``discard``.
    """
    spark = df.sparkSession
    name = f"bucketed_{uuid.uuid4().hex}"
    path = f"{checkpoint_folder(spark).rstrip('/')}/tables/{name}"
    df.write.bucketBy(number, key).options(path=path, compression="uncompressed").saveAsTable(name, format="parquet")
    found = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the entry only: the files lie outside the warehouse
    return found, path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder that ``bucketed`` wrote."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(found, True)


def discard_table(df: DataFrame) -> None:
    """Delete the files of a table that ``lineage.cut`` wrote."""
    for path in {name.rsplit("/", 1)[0] for name in df.inputFiles()[:1]}:
        discard(df.sparkSession, path)


def width(spark: SparkSession) -> int:
    """Number of shuffle partitions the session asks for."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def keyed(docs: DataFrame, *more: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` (as given), ``k`` (64-bit key of id and text), ``text``, and ``more``.

    ``k`` names a document in joins: it is never null and repeated rows share it.
    """
    identity = F.col(id_col).cast("long")
    return docs.select(
        identity.alias("id"),
        F.xxhash64(identity, F.col(text_col)).alias("k"),
        F.col(text_col).alias("text"),
        *[F.col(c) for c in more],
    )
