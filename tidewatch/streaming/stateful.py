"""Cooldown, zero-byte bursts and sessions as streams."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import CLOSING_STATES, COOLDOWN_S, SESSION_TIMEOUT_S, ZERO_BYTE_COUNT, ZERO_BYTE_RATE
from .ordered import Ordered

SECOND = 1_000_000
#: Times keep their microseconds in the rows that wait as JSON.
JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


class Cooldown(Ordered):
    """The last alert that passed; forgotten when nothing it could hold back is left."""

    columns = ["row"]

    def __init__(self, seconds: float):
        self.gap = int(seconds * SECOND)

    def fold(self, state: Any, row: dict) -> tuple[Any, list[dict]]:
        if state is None or row["t_us"] - state["last"] >= self.gap:
            return {"last": row["t_us"]}, [{"row": json.dumps(row)}]
        return state, []

    def deadline(self, state: Any) -> int | None:
        return (state["last"] + self.gap) // 1000 + 1


class ZeroBytes(Ordered):
    """Count and first time of sessions without bytes, forgotten after a silence if one is given."""

    columns = ["row_id", "t_us", "zero_count", "zero_rate", "zero_detected"]

    def __init__(self, forget_s: float | None = None):
        self.forget = None if forget_s is None else int(forget_s * SECOND)

    def deadline(self, state: Any) -> int | None:
        return None if self.forget is None else (state["last"] + self.forget) // 1000 + 1

    def fold(self, state: Any, row: dict) -> tuple[Any, list[dict]]:
        if state is not None and self.forget is not None and row["t_us"] - state["last"] > self.forget:
            state = None
        state = state or {"n": 0, "first": row["t_us"]}
        state |= {"n": state["n"] + 1, "last": row["t_us"]}
        rate = state["n"] / max((row["t_us"] - state["first"]) / SECOND, 0.001)
        found = state["n"] >= ZERO_BYTE_COUNT and rate > ZERO_BYTE_RATE
        return state, [row | {"zero_count": state["n"], "zero_rate": rate, "zero_detected": found}]


class Sessions(Ordered):
    """Events of an open session; a closing flow or the timeout ends it."""

    columns = ["epoch_start_us", "last_us", "events", "total_bytes", "closed"]

    def __init__(self, timeout_s: float):
        self.timeout = int(timeout_s * SECOND)

    def fold(self, state: Any, row: dict) -> tuple[Any, list[dict]]:
        state = state or {"first": row["t_us"], "n": 0, "bytes": 0}
        state |= {"n": state["n"] + 1, "last": row["t_us"]}
        if row["kind"] == "flow":
            state["bytes"] = (row.get("sbytes") or 0) + (row.get("dbytes") or 0)
            if row.get("state") in CLOSING_STATES:
                return None, [self._row(state, True)]
        return state, []

    def deadline(self, state: Any) -> int | None:
        return (state["last"] + self.timeout) // 1000 + 1

    def expire(self, state: Any, now_ms: int) -> tuple[Any, list[dict]]:
        return None, [self._row(state, False)]

    @staticmethod
    def _row(state: dict, closed: bool) -> dict:
        return {"epoch_start_us": state["first"], "last_us": state["last"], "events": state["n"], "total_bytes": state["bytes"], "closed": closed}


def _run(rows: DataFrame, key: list[str], processor: Ordered, schema: str, delay: str) -> DataFrame:
    """Rows (t_us, row_id and the key) through ``processor``; ``delay`` is the watermark's."""
    packed = rows.select(*key, F.timestamp_micros("t_us").alias("ts"), F.to_json(F.struct("*"), JSON).alias("row")).withWatermark("ts", delay)
    keys = [f"coalesce(cast({k} as string), '')" for k in key]
    named = packed.withColumn("key", F.expr(f"concat_ws('\\u0001', {', '.join(keys)})"))
    return named.groupBy("key").transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="append", timeMode="eventtime")


def cooldown(alerts: DataFrame, key: list[str], seconds: float = COOLDOWN_S, delay: str = "30 seconds") -> DataFrame:
    """The alerts that pass, with all their columns.  Needs t_us and row_id; an alert without a time passes."""
    timed = _run(alerts.filter("t_us is not null"), key, Cooldown(seconds), "row string", delay)
    passed = timed.select(F.from_json("row", alerts.schema, JSON).alias("r")).select("r.*")
    return passed.unionByName(alerts.filter("t_us is null"))


def zero_byte_bursts(sessions: DataFrame, delay: str = "30 seconds", forget_s: float | None = None) -> DataFrame:
    """W13 for sessions without bytes.  Without ``forget_s`` every pair seen stays in state."""
    key = ["saddr", "daddr", "dport", "proto"]
    quiet = sessions.filter(F.coalesce("total_fwd_bytes", F.lit(0)) + F.coalesce("total_bwd_bytes", F.lit(0)) <= 0)
    return _run(quiet.select("t_us", "row_id", *key), key, ZeroBytes(forget_s), "row_id long, t_us long, zero_count long, zero_rate double, zero_detected boolean", delay)


def sessions(events: DataFrame, timeout_s: float = SESSION_TIMEOUT_S, delay: str = "30 seconds") -> DataFrame:
    """A row for each session that ends (events: uid, kind, state, sbytes, dbytes)."""
    columns = ["uid", "kind", "state", "sbytes", "dbytes"]
    return _run(events.select("t_us", "row_id", *columns), ["uid"], Sessions(timeout_s), "epoch_start_us long, last_us long, events long, total_bytes long, closed boolean", delay)
