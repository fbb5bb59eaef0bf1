"""Make this package importable in the executors' Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Add the package to the session's Python files, unless workers find it anyway."""
    root = str(_PACKAGE.parent)
    context = spark.sparkContext
    if root in map(os.path.realpath, filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep))):
        return
    if any(Path(f).name == f"{_PACKAGE.name}.zip" for f in context._python_includes):
        return
    archive = Path(tempfile.mkdtemp()) / f"{_PACKAGE.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for f in sorted(_PACKAGE.rglob("*.py")):
            out.write(f, f.relative_to(root))
    context.addPyFile(str(archive))
