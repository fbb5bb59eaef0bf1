"""Labelled flow CSV readers.

No types are inferred, which would read every file once more: the headers (one line of each
file) say which columns there are, all are read as text, and the known ones but the label
are doubles.
"""

from __future__ import annotations

import csv
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.fixed import CSV_COLUMNS_V2, CSV_COLUMNS_V3, REQUIRED_V3, TASK_FILES


def _stripped(df: DataFrame) -> DataFrame:
    """Header names without padding; of names that become equal later ones get a suffix."""
    seen: dict[str, int] = {}
    names = []
    for c in df.columns:
        name = c.strip()
        if name.lower() == "label":
            name = "Label"
        seen[name] = seen.get(name, 0) + 1
        names.append(name if seen[name] == 1 else f"{name}.{seen[name] - 1}")
    return df.toDF(*names)


def _file_system(spark: SparkSession, path: str) -> tuple:
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def headers(spark: SparkSession, paths: Sequence[str]) -> dict[str, list[str]]:
    """The header fields of each file; of every file only the first line is read."""
    jvm = spark.sparkContext._jvm

    def first_line(path: str) -> list[str]:
        found, fs = _file_system(spark, path)
        lines = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(fs.open(found), "UTF-8"))
        try:
            return next(csv.reader([(lines.readLine() or "").lstrip("\ufeff")]), [])
        finally:
            lines.close()

    with ThreadPoolExecutor(16) as pool:
        return dict(zip(paths, pool.map(first_line, paths), strict=True))


def read_csv(spark: SparkSession, path: str | list[str], names: Sequence[str] | None = None) -> DataFrame:
    """Files of one header as text columns."""
    paths = [path] if isinstance(path, str) else list(path)
    names = names or headers(spark, paths[:1])[paths[0]]
    schema = StructType([StructField(f"c{i}", StringType()) for i in range(len(names))])
    return _stripped(spark.read.csv(paths, header=True, schema=schema, enforceSchema=True).toDF(*[f"{c}" for c in _apart(names)]))


def _apart(names: Sequence[str]) -> list[str]:
    """Names as they are, with spaces behind those that occur before, as ``toDF`` needs them apart."""
    seen: dict[str, int] = {}
    out = []
    for c in names:
        seen[c] = seen.get(c, 0) + 1
        out.append(c + " " * (seen[c] - 1))
    return out


def _numbers(df: DataFrame, known: Sequence[str]) -> DataFrame:
    """The known text columns as doubles, null where they are no number."""
    texts = [c for c in known if c in df.columns and c != "Label" and df.schema[c].dataType == StringType()]
    return df.withColumns({c: F.trim(F.col(f"`{c}`")).try_cast("double") for c in texts}) if texts else df


def labelled(df: DataFrame) -> DataFrame:
    """Rename to internal columns (profile v3) and insist on the label and required columns."""
    df = _stripped(df)
    if "Label" not in df.columns:
        raise KeyError(f"no column 'Label' among {df.columns}")
    df = df.withColumnsRenamed({k: v for k, v in CSV_COLUMNS_V3.items() if k in df.columns})
    for c in REQUIRED_V3:
        if c not in df.columns:
            raise KeyError(f"no column {c!r} among {df.columns}")
    return _numbers(df, list(CSV_COLUMNS_V3.values()))


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """One file."""
    return labelled(read_csv(spark, path))


def list_csv(spark: SparkSession, folder: str) -> list[str]:
    """CSV files of a folder on any Hadoop file system."""
    found, fs = _file_system(spark, folder)
    if not fs.exists(found):
        return []
    return sorted(str(x.getPath()) for x in fs.listStatus(found) if str(x.getPath()).endswith(".csv"))


def read_folder(spark: SparkSession, folder: str) -> DataFrame:
    """The union of a folder's files that have a label column, mapped columns only.

    One look at the headers makes the catalogue; files of equal headers share a reader.
    """
    groups: dict[tuple[str, ...], list[str]] = {}
    for path, names in headers(spark, list_csv(spark, folder)).items():
        groups.setdefault(tuple(names), []).append(path)
    frames = [df for names, paths in groups.items() if names for df in [read_csv(spark, paths, names)] if "Label" in df.columns]
    if not frames:
        raise ValueError(f"no CSV file with a label column in {folder}")
    frames = [_numbers(df, list(CSV_COLUMNS_V2)).select([c for c in CSV_COLUMNS_V2 if c in df.columns]) for df in frames]
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out.withColumnsRenamed({k: v for k, v in CSV_COLUMNS_V2.items() if k in out.columns})


def task_paths(spark: SparkSession, folder: str, files: dict[str, str] = TASK_FILES) -> dict[str, str]:
    """S3: the training file of each task that is there."""
    there = {f.rsplit("/", 1)[-1]: f for f in list_csv(spark, folder)}
    return {task: there[name] for task, name in files.items() if name in there}
