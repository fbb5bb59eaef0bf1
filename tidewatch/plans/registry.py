"""All registered queries of the detection operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import behavior, boosting, events, rows, sessions, training

Query = Callable[[SparkSession, str], DataFrame]
MODULES = (events, rows, sessions, behavior, boosting, training)

flagship = behavior.scan_alerts


def queries() -> dict[str, Query]:
    return {name: q for m in MODULES for name, (q, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
