"""Sessions: flow and application events of one flow id merged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import seconds_between
from ..functions.fixed import CLOSING_STATES, MAX_SESSIONS, SESSION_TIMEOUT_S
from . import parse

#: List columns of a session: name -> (event kind, event column).
LISTS = {
    "http_methods": ("http", "method"), "http_status_codes": ("http", "status_code"), "http_hosts": ("http", "host"), "http_uris": ("http", "uri"), "http_user_agents": ("http", "user_agent"),
    "dns_queries": ("dns", "query"), "dns_rrtypes": ("dns", "qtype"), "tls_sni": ("tls", "server_name"), "tls_versions": ("tls", "sslversion"),
    "tls_subjects": ("tls", "subject"), "tls_issuers": ("tls", "issuer"), "ssh_client_versions": ("ssh", "client"), "ssh_server_versions": ("ssh", "server"),
}
COUNTERS = {"total_fwd_packets": "spkts", "total_bwd_packets": "dpkts", "total_fwd_bytes": "sbytes", "total_bwd_bytes": "dbytes"}


def unified(events: DataFrame, order: str) -> DataFrame:
    """All events of known kinds in one layout (``kind``, ``ord``), absent values null.

    ``order`` is a column of ``events`` that tells events of one instant apart.
    """
    return parse.every_kind(events, order).withColumnRenamed(order, "ord")


def epochs(events: DataFrame, timeout_s: float = SESSION_TIMEOUT_S) -> DataFrame:
    """Number the sessions of a flow id: a new one starts after a closing flow
    event and after more than ``timeout_s`` without events.  Only rows before decide."""
    w = Window.partitionBy("uid").orderBy("ts", "ord")
    closes = F.coalesce((F.col("kind") == "flow") & F.col("state").isin(CLOSING_STATES), F.lit(False))
    idle = F.coalesce(seconds_between(F.lag("ts").over(w), F.col("ts")) > timeout_s, F.lit(False))
    marked = events.filter("uid is not null").withColumn("closes", closes).withColumn("starts", F.coalesce(F.lag("closes").over(w), F.lit(False)) | idle)
    return marked.withColumn("epoch", F.sum(F.col("starts").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def _ordered_distinct(value: Column, present: Column) -> Column:
    """Values in the order of their first event."""
    held = F.collect_list(F.when(present, F.struct("ts", "ord", value.alias("v"))))
    return F.array_distinct(F.transform(F.array_sort(held), lambda x: x["v"]))


def merge(numbered: DataFrame) -> DataFrame:
    """One row per flow id and epoch."""
    at = F.struct("ts", "ord")
    is_flow = F.col("kind") == "flow"
    last = lambda c, when=is_flow: F.max_by(F.when(when, F.col(c)), F.when(when, at))
    first = lambda c: F.min_by(c, at)
    named = is_flow & (F.coalesce("appproto", F.lit("")) != "")
    app = F.col("kind").isin("http", "dns", "tls", "ssh")
    lists = {name: _ordered_distinct(F.col(c), (F.col("kind") == kind) & (F.col(c) != "")) for name, (kind, c) in LISTS.items()}
    answers = F.collect_list(F.when(F.col("kind") == "dns", F.struct("ts", "ord", F.col("answers").alias("v"))))
    return (
        numbered.groupBy("uid", "epoch")
        .agg(
            *[first(c).alias(c) for c in ("saddr", "sport", "daddr", "dport", "proto")],
            # An application event sets the start only where it comes first.
            F.least(F.min(F.when(is_flow, F.col("starttime"))), F.when(first("kind") != "flow", F.min("ts"))).alias("starttime"),
            F.max(F.when(is_flow, F.col("endtime"))).alias("endtime"),
            F.coalesce(last("dur", is_flow & (F.col("dur") != 0)), F.lit(0.0)).alias("duration"),
            F.coalesce(last("state"), F.lit("")).alias("state"),
            F.coalesce(last("appproto", named), F.min_by(F.when(app, F.col("kind")), F.when(app, at)), F.lit("")).alias("appproto"),
            *[F.coalesce(last(source), F.lit(0)).alias(name) for name, source in COUNTERS.items()],
            *[c.alias(name) for name, c in lists.items()],
            F.array_distinct(F.filter(F.flatten(F.transform(F.array_sort(answers), lambda x: x["v"])), lambda x: x.isNotNull())).alias("dns_answers"),
            *[F.count_if(F.col("kind") == k).alias(f"{k}_event_count") for k in ("http", "dns", "tls", "ssh", "file", "flow")],
            F.max("ts").alias("last_updated"),
            F.max_by("closes", at).alias("closed"),
        )
        .withColumn("has_app_data", F.col("http_event_count") + F.col("dns_event_count") + F.col("tls_event_count") + F.col("ssh_event_count") + F.col("file_event_count") > 0)
    )


def finalize(sessions: DataFrame) -> DataFrame:
    """Duration from the times if it is 0; rates over at least 0.001 s."""
    span = F.coalesce(seconds_between(F.col("starttime"), F.col("endtime")), F.lit(0.0))
    sessions = sessions.withColumn("duration", F.when(F.col("duration") == 0, span).otherwise(F.col("duration")))
    s, fb, bb = F.greatest("duration", F.lit(0.001)), F.col("total_fwd_bytes"), F.col("total_bwd_bytes")
    return sessions.withColumns({
        "flow_bytes_per_sec": (fb + bb) / s, "flow_packets_per_sec": (F.col("total_fwd_packets") + F.col("total_bwd_packets")) / s,
        "down_up_ratio": F.when(fb > 0, bb / F.nullif(fb, F.lit(0))).otherwise(0.0),
    })


def build(events: DataFrame, order: str, timeout_s: float = SESSION_TIMEOUT_S) -> DataFrame:
    """Decoded events -> finalized sessions; at the end of the input all sessions close.

    One shuffle on the flow id serves both the numbering and the merge.
    """
    return finalize(merge(epochs(unified(events, order), timeout_s)))


def newest(sessions: DataFrame, most: int = MAX_SESSIONS) -> DataFrame:
    """The ``most`` sessions that were updated last (a report of the feature's size)."""
    return sessions.orderBy(F.desc("last_updated"), "uid", "epoch").limit(most)


def by_source(sessions: DataFrame, address: str) -> DataFrame:
    """A12."""
    return sessions.filter(F.col("saddr") == address)


def by_destination_port(sessions: DataFrame, port: int) -> DataFrame:
    """A12."""
    return sessions.filter(F.col("dport") == port)


def _totals() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("total_sessions"),
        F.count_if(F.col("closed")).alias("closed_sessions"),
        F.count_if(~F.col("closed")).alias("expired_sessions"),
        *[F.coalesce(F.sum(f"{k}_event_count"), F.lit(0)).alias(f"{k}_events") for k in ("flow", "http", "dns", "tls", "ssh", "file")],
    ]


def statistics(sessions: DataFrame) -> DataFrame:
    """Totals; sessions neither closed by a flow event count as expired."""
    return sessions.agg(*_totals())


def observed(sessions: DataFrame, name: str = "sessions") -> DataFrame:
    """A13 of a running query: the same totals as observed metrics ``name``, in each batch's
    progress (``observedMetrics``) or through an ``Observation``; no further pass."""
    return sessions.observe(name, *_totals())
