"""Behaviour of sources and whole sessions as streams: exact, row by row.

Both hold what the batch operators compute from all rows: a source's window of sessions
with counters of its values, and a session's figures and lists in the order of their
first event.  Rows come in time order (``Ordered``), state ends by timers.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import BEHAVIOR_WINDOW_S, CLOSING_STATES, SESSION_TIMEOUT_S
from ..operators import behavior
from ..operators import sessions as batch
from .ordered import Ordered
from .stateful import JSON, SECOND, _run

#: Lifetime counters: name -> what a session adds.
COUNTERS = {
    "total_flows": lambda r: 1, "completed_flows": lambda r: int(r.get("is_complete") is True), "active_flows": lambda r: int(r.get("is_complete") is False),
    "bytes_sent": lambda r: r.get("total_fwd_bytes") or 0, "bytes_received": lambda r: r.get("total_bwd_bytes") or 0, "packets_sent": lambda r: r.get("total_fwd_packets") or 0, "packets_received": lambda r: r.get("total_bwd_packets") or 0,
    "all_http": lambda r: r.get("http_event_count") or 0, "all_http_errors": lambda r: r.get("http_errors") or 0, "all_dns": lambda r: r.get("dns_event_count") or 0, "all_dns_failures": lambda r: r.get("dns_failures") or 0,
    "all_tls": lambda r: r.get("tls_event_count") or 0, "all_tls_failures": lambda r: r.get("tls_failures") or 0, "all_ssh": lambda r: r.get("ssh_event_count") or 0, "all_auth_failures": lambda r: r.get("auth_failures") or 0,
    "rejected_flows": lambda r: int(r.get("state") == "rejected"), "reset_flows": lambda r: int(r.get("state") == "rst"), "tcp_flows": lambda r: int(r.get("proto") == "TCP"), "udp_flows": lambda r: int(r.get("proto") == "UDP"),
}
FIGURES = ["ports", "ips", "window_bytes", "window_packets", "failures", "first_seen_us", "unique_dst_ips", "unique_dst_ports", *COUNTERS]


class Sources(Ordered):
    """A source's window and lifetime counters; forgotten when it is silent for longer than the window.

    Sessions of one instant see each other, so they wait for the instant to be over.
    """

    columns = ["row"]

    def __init__(self, window_s: float):
        self.window = int(window_s * SECOND)

    def fold(self, state: Any, row: dict) -> tuple[Any, list[dict]]:
        out = []
        if state is not None and state["now"] and state["now"][0]["t_us"] != row["t_us"]:
            state, out = self._flushed(state)
        if state is not None and not state["now"] and row["t_us"] - state["last"] > self.window:
            state = None  # the next epoch
        state = state or {"first": row["t_us"], "last": row["t_us"], "now": [], "held": [], "ips": {}, "ports": {}, "failed": {}, "bytes": 0, "packets": 0, "scan": [0.0, 0.0], "all_ips": {}, "all_ports": {}, "n": {}}
        state["now"].append(row)
        state["last"] = row["t_us"]
        return state, out

    def deadline(self, state: Any) -> int | None:
        return (state["last"] if state["now"] else state["last"] + self.window) // 1000 + 1

    def expire(self, state: Any, now_ms: int) -> tuple[Any, list[dict]]:
        return self._flushed(state) if state["now"] else (None, [])

    def _count(self, state: dict, entry: list, sign: int) -> None:
        for name, value, n in (("ips", entry[1], 1), ("ports", entry[2], 1), ("failed", entry[5], entry[6])):
            if value is not None and n:
                left = state[name].get(value, 0) + sign * n
                if left:
                    state[name][value] = left
                else:
                    state[name].pop(value)
        state["bytes"] += sign * entry[3]
        state["packets"] += sign * entry[4]

    def _flushed(self, state: dict) -> tuple[dict, list[dict]]:
        """The sessions of the instant that is over."""
        now = state["now"][0]["t_us"]
        gone = 0
        while gone < len(state["held"]) and state["held"][gone][0] <= now - self.window:
            self._count(state, state["held"][gone], -1)
            gone += 1
        del state["held"][:gone]
        for r in state["now"]:
            port = r.get("dport") or 0
            entry = [now, r.get("daddr") or None, str(port) if port > 0 else None, r.get("total_fwd_bytes") or 0, r.get("total_fwd_packets") or 0, r.get("service") or "", r.get("auth_failures") or 0]
            state["held"].append(entry)
            self._count(state, entry, 1)
        ports, ips = len(state["ports"]), len(state["ips"])
        for k, (a, b, least, most) in enumerate(((ports, ips, 10, 50), (ips, ports, 5, 20))):
            if b > 0:
                state["scan"][k] = min(1.0, a / b / most) if a / b > least else 0.0
        failures = min(20, max(state["failed"].values(), default=0))
        out = []
        for r in state["now"]:
            for name, add in COUNTERS.items():
                state["n"][name] = state["n"].get(name, 0) + add(r)
            if r.get("daddr"):
                state["all_ips"][r["daddr"]] = 1
            if (r.get("dport") or 0) > 0:
                state["all_ports"][str(r["dport"])] = 1
            figures = {"ports": ports, "ips": ips, "window_bytes": state["bytes"], "window_packets": state["packets"], "failures": failures if failures >= behavior.LEVELS[0] else 0, "first_seen_us": state["first"], "unique_dst_ips": len(state["all_ips"]), "unique_dst_ports": len(state["all_ports"])}
            out.append({"row": json.dumps(r | figures | state["n"] | {"port_scan_score": state["scan"][0], "host_scan_score": state["scan"][1]})})
        state["now"] = []
        return state, out


def analyze(sessions: DataFrame, window_s: int = BEHAVIOR_WINDOW_S, delay: str = "30 seconds") -> DataFrame:
    """``behavior.analyze`` as a stream (no ``epoch`` number, as sources are forgotten).

    Needs row_id and t_us; sessions without a source or a time go.
    """
    ready = behavior.auth_failures(sessions).filter("saddr is not null and saddr != '' and t_us is not null")
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in ready.schema], ) + ", " + ", ".join(f"{c} long" for c in FIGURES) + ", port_scan_score double, host_scan_score double"
    found = _run(ready, ["saddr"], Sources(window_s), "row string", delay)
    rows = found.select(F.from_json("row", schema, JSON).alias("r")).select("r.*")
    return behavior.features(behavior.overall(rows, window_s), window_s)


class Merged(Ordered):
    """An open session: figures of the last flow event, lists in the order of their first event."""

    columns = ["row"]

    def __init__(self, timeout_s: float):
        self.timeout = int(timeout_s * SECOND)

    def fold(self, state: Any, row: dict) -> tuple[Any, list[dict]]:
        out = []
        if state is not None and row["t_us"] - state["last_us"] > self.timeout:
            state, out = None, [self._row(state, False)]
        kind, flow = row["kind"], row["kind"] == "flow"
        if state is None:
            state = {c: row.get(c) for c in ("uid", "saddr", "sport", "daddr", "dport", "proto")}
            state |= {"start_us": None if flow else row["t_us"], "end_us": None, "duration": 0.0, "state": None, "named": None, "app": None, "n": {}, "lists": {}, **dict.fromkeys(batch.COUNTERS, 0)}
        state["last_us"] = row["t_us"]
        state["n"][kind] = state["n"].get(kind, 0) + 1
        if flow:
            if row.get("start_us") is not None:
                state["start_us"] = min(x for x in (state["start_us"], row["start_us"]) if x is not None)
            if row.get("end_us") is not None:
                state["end_us"] = max(x for x in (state["end_us"], row["end_us"]) if x is not None)
            state["duration"] = row.get("dur") or state["duration"]
            state["state"] = row.get("state")
            state["named"] = row.get("appproto") or state["named"]
            state |= {name: row.get(c) or 0 for name, c in batch.COUNTERS.items()}
        elif kind in ("http", "dns", "tls", "ssh"):
            state["app"] = state["app"] or kind
        for name, values in [(n, [row.get(c)]) for n, (k, c) in batch.LISTS.items() if k == kind] + ([("dns_answers", row.get("answers") or [])] if kind == "dns" else []):
            held = state["lists"].setdefault(name, {})
            for v in values:
                if v is not None and (v != "" or name == "dns_answers"):
                    held[v] = 1
        if flow and row.get("state") in CLOSING_STATES:
            return None, [*out, self._row(state, True)]
        return state, out

    def deadline(self, state: Any) -> int | None:
        return (state["last_us"] + self.timeout) // 1000 + 1

    def expire(self, state: Any, now_ms: int) -> tuple[Any, list[dict]]:
        return None, [self._row(state, False)]

    @staticmethod
    def _row(state: dict, closed: bool) -> dict:
        held, n = state["lists"], state["n"]
        own = {c: state[c] for c in ("uid", "saddr", "sport", "daddr", "dport", "proto", "start_us", "end_us", "duration", "last_us", *batch.COUNTERS)}
        own |= {name: list(held.get(name, {})) for name in (*batch.LISTS, "dns_answers")} | {f"{k}_event_count": n.get(k, 0) for k in ("http", "dns", "tls", "ssh", "file", "flow")}
        return {"row": json.dumps(own | {"state": state["state"] or "", "appproto": state["named"] or state["app"] or "", "closed": closed, "has_app_data": any(k != "flow" for k in n)})}


def sessions(events: DataFrame, order: str, timeout_s: float = SESSION_TIMEOUT_S, delay: str = "30 seconds") -> DataFrame:
    """``sessions.build`` as a stream of decoded events, a row where a session ends.

    All columns but ``epoch``, as ended sessions are forgotten; events without flow id or
    time go.  ``order`` (a whole number) tells events of one instant apart.
    """
    rows = batch.unified(events, order).filter("uid is not null and ts is not null")
    numbers = {"ord": "row_id", "ts": "t_us", "starttime": "start_us", "endtime": "end_us"}
    ready = rows.select(*[c for c in rows.columns if c not in numbers], F.col("ord").cast("long").alias("row_id"), *[F.unix_micros(c).alias(n) for c, n in numbers.items() if c != "ord"])
    whole = "saddr string, sport {0}, daddr string, dport {0}, proto string".format(rows.schema["dport"].dataType.simpleString())
    lists = ", ".join(f"{c} array<string>" for c in (*batch.LISTS, "dns_answers"))
    counts = ", ".join(f"{c} long" for c in (*batch.COUNTERS, *[f"{k}_event_count" for k in ("http", "dns", "tls", "ssh", "file", "flow")]))
    schema = f"uid string, {whole}, start_us long, end_us long, duration double, state string, appproto string, {counts}, {lists}, last_us long, closed boolean, has_app_data boolean"
    found = _run(ready, ["uid"], Merged(timeout_s), "row string", delay).select(F.from_json("row", schema).alias("r")).select("r.*")
    times = {"starttime": "start_us", "endtime": "end_us", "last_updated": "last_us"}
    return batch.finalize(found.withColumns({c: F.timestamp_micros(n) for c, n in times.items()}).drop(*times.values()))
