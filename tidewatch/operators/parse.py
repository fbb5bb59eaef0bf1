"""Parsing and routing of event log lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import number, timestamp, whole

#: All leaves are strings: numbers may come as numbers, as text or with a fraction.
SCHEMA = """
event_type string, timestamp string, flow_id string, src_ip string, src_port string, dest_ip string,
dest_port string, proto string, app_proto string,
flow struct<start string, end string, age string, state string, pkts_toserver string, pkts_toclient string,
            bytes_toserver string, bytes_toclient string>,
tcp struct<syn string, rst string, ack string, fin string, tcp_flags string>,
http struct<http_method string, hostname string, url string, http_user_agent string, status string,
            protocol string, request_body_len string, length string>,
dns struct<rrname string, ttl string, rrtype string, grouped struct<CNAME array<string>, A array<string>>>,
tls struct<version string, subject string, issuerdn string, sni string, notbefore string, notafter string>,
fileinfo struct<size string>,
ssh struct<client struct<software_version string, proto_version string>, server struct<software_version string>>,
alert struct<signature string, category string, severity string>
""".replace("end string", "`end` string")

KINDS = ["flow", "http", "dns", "tls", "fileinfo", "ssh"]


def decode(lines: DataFrame, column: str = "value") -> DataFrame:
    """Every line with its decoded event ``e``; ``e.event_type`` is null for bad lines."""
    return lines.withColumn("e", F.from_json(column, SCHEMA))


def rejected(lines: DataFrame, column: str = "value") -> DataFrame:
    """Lines that are no event (malformed, empty, no or unknown event_type), with a reason."""
    kind = F.col("e.event_type")
    reason = F.when(kind.isNull() | (kind == ""), "no event").when(~kind.isin([*KINDS, "alert"]), "unknown event type")
    return decode(lines, column).withColumn("reason", reason).filter("reason is not null").select(F.col(column).alias("line"), "reason")


def _text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def _count(c: str) -> Column:
    return F.coalesce(whole(c), F.lit(0))


def _flag(c: str) -> Column:
    return F.coalesce(~F.lower(F.col(c)).isin("false", "0", ""), F.lit(False))


def envelope(*keep: str) -> list[Column]:
    """Columns that all events share."""
    return [
        *[F.col(c) for c in keep],
        F.col("e.flow_id").alias("uid"),
        F.col("e.src_ip").alias("saddr"),
        whole("e.src_port").cast("int").alias("sport"),
        F.col("e.dest_ip").alias("daddr"),
        whole("e.dest_port").cast("int").alias("dport"),
        F.col("e.proto").alias("proto"),
        F.col("e.app_proto").alias("appproto"),
        F.try_to_timestamp("e.timestamp").alias("ts"),
    ]


def _time() -> Column:
    return F.try_to_timestamp("e.timestamp")


def fields(kind: str) -> dict[str, Column]:
    """Columns of a kind of event beside the envelope."""
    none = F.array().cast("array<string>")
    if kind == "flow":
        sizes = {"spkts": _count("e.flow.pkts_toserver"), "dpkts": _count("e.flow.pkts_toclient"), "sbytes": _count("e.flow.bytes_toserver"), "dbytes": _count("e.flow.bytes_toclient")}
        return sizes | {
            "state": _text("e.flow.state"), "dur": F.coalesce(number("e.flow.age"), F.lit(0.0)), **{f"tcp_{x}": _flag(f"e.tcp.{x}") for x in ("syn", "rst", "ack", "fin")}, "tcpflags": _text("e.tcp.tcp_flags"),
            "starttime": F.coalesce(timestamp(F.col("e.flow.start")), _time()), "endtime": F.coalesce(timestamp(F.col("e.flow.end")), _time()),
            "pkts": sizes["spkts"] + sizes["dpkts"], "bytes": sizes["sbytes"] + sizes["dbytes"],
        }
    own = {
        "http": lambda: {
            "method": _text("e.http.http_method"), "host": _text("e.http.hostname"), "uri": _text("e.http.url"), "user_agent": _text("e.http.http_user_agent"), "status_code": _text("e.http.status"), "version": _text("e.http.protocol"),
            "request_body_len": _count("e.http.request_body_len"), "response_body_len": _count("e.http.length"),
        },
        "dns": lambda: {"query": _text("e.dns.rrname"), "ttl": _text("e.dns.ttl"), "qtype": _text("e.dns.rrtype"), "answers": F.concat(F.coalesce("e.dns.grouped.CNAME", none), F.coalesce("e.dns.grouped.A", none))},
        "tls": lambda: {b: _text(f"e.tls.{a}") for a, b in (("version", "sslversion"), ("subject", "subject"), ("issuerdn", "issuer"), ("sni", "server_name"), ("notbefore", "notbefore"), ("notafter", "notafter"))},
        "fileinfo": lambda: {"size": _count("e.fileinfo.size")},
        "ssh": lambda: {"client": _text("e.ssh.client.software_version"), "version": _text("e.ssh.client.proto_version"), "server": _text("e.ssh.server.software_version")},
    }
    return {"starttime": _time()} | own[kind]()


def _of_kind(events: DataFrame, kind: str, keep: tuple[str, ...]) -> DataFrame:
    return events.filter(F.col("e.event_type") == kind).select(*envelope(*keep), *[c.alias(n) for n, c in fields(kind).items()])


def flows(events: DataFrame, *keep: str) -> DataFrame:
    """Flow events; start and end fall back to the event's time."""
    return _of_kind(events, "flow", keep)


def http(events: DataFrame, *keep: str) -> DataFrame:
    """P7."""
    return _of_kind(events, "http", keep)


def dns(events: DataFrame, *keep: str) -> DataFrame:
    """Answers are the CNAME list followed by the A list."""
    return _of_kind(events, "dns", keep)


def tls(events: DataFrame, *keep: str) -> DataFrame:
    """P9."""
    return _of_kind(events, "tls", keep)


def files(events: DataFrame, *keep: str) -> DataFrame:
    """P10."""
    return _of_kind(events, "fileinfo", keep)


def ssh(events: DataFrame, *keep: str) -> DataFrame:
    """P11."""
    return _of_kind(events, "ssh", keep)


def every_kind(events: DataFrame, *keep: str) -> DataFrame:
    """All events of known kinds in one layout (``kind``, of files "file"), from one scan: a
    column is null where its kind has none."""
    kind, columns = F.col("e.event_type"), {}
    for k in KINDS:
        for name, c in fields(k).items():
            columns[name] = columns[name].when(kind == k, c) if name in columns else F.when(kind == k, c)
    named = F.when(kind == "fileinfo", "file").otherwise(kind)
    return events.filter(kind.isin(KINDS)).select(*envelope(*keep), named.alias("kind"), *[c.alias(n) for n, c in columns.items()])


def route(events: DataFrame) -> DataFrame:
    """Events with ``branch``: alert, flow, app (other known kinds) or reject."""
    kind = F.col("e.event_type")
    return events.withColumn("branch", F.when(kind.isin("alert", "flow"), kind).when(kind.isin(KINDS), "app").otherwise("reject"))
