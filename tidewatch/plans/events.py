"""Queries of parsing, routing, features, whitelist and address filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import cidr_range
from ..functions.fixed import FEATURES_V2, FEATURES_V3
from ..operators import alerts, features, parse, whitelist
from .fixtures import EVENTS_SQL, FLOWS_SQL, event_lines, flow_lines, flows


def rounded(df: DataFrame, *keep: str, digits: int = 6, **named: str) -> DataFrame:
    """``keep`` as they are, then columns as doubles rounded for comparison."""
    return df.select(*keep, *[F.round(F.col(c).cast("double"), digits).alias(n) for n, c in named.items()])


def parsed_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = parse.flows(parse.decode(flow_lines(spark, sf_dir)), "row_id")
    return f.select(
        "row_id", "uid", "saddr", "sport", "daddr", "dport", "proto", "appproto", F.unix_micros("ts").alias("ts_us"), F.unix_micros("starttime").alias("start_us"), "spkts", "dpkts", "sbytes", "dbytes", "pkts", "bytes",
        "state", "dur", "tcp_syn", "tcp_rst", "tcpflags",
    )


PARSED_FLOWS = f"""WITH {FLOWS_SQL} SELECT row_id, flow_id AS uid, saddr, 40000 AS sport, daddr, dport, proto, CAST(NULL AS VARCHAR) AS appproto, t_us AS ts_us, t_us AS start_us,
  spkts, dpkts, sbytes, dbytes, spkts + dpkts AS pkts, sbytes + dbytes AS bytes, state, CAST(age_s AS DOUBLE) AS dur, row_id % 2 = 0 AS tcp_syn, false AS tcp_rst, '1b' AS tcpflags FROM flows"""


def parsed_http(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.http(parse.decode(event_lines(spark, sf_dir)), "row_id").select("row_id", "uid", "saddr", "dport", "method", "host", "uri", "status_code", "user_agent", "response_body_len")


PARSED_HTTP = f"""WITH {EVENTS_SQL} SELECT row_id, uid, saddr, dport, method, 'h.example' AS host, '/p' || (row_id % 7) AS uri, status AS status_code, '' AS user_agent, sbytes AS response_body_len
  FROM eve WHERE kind = 'http'"""


def parsed_dns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.dns(parse.decode(event_lines(spark, sf_dir)), "row_id").select("row_id", "uid", "query", "qtype", "ttl", F.array_join("answers", ",").alias("answers"))


PARSED_DNS = f"""WITH {EVENTS_SQL} SELECT row_id, uid, 'q' || (row_id % 5) || '.example' AS query, 'A' AS qtype, '' AS ttl,
  CASE WHEN row_id % 8 <> 1 THEN '' WHEN row_id % 3 = 0 THEN 'c.example,' || daddr ELSE daddr END AS answers FROM eve WHERE kind = 'dns'"""


def parsed_tls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.tls(parse.decode(event_lines(spark, sf_dir)), "row_id").select("row_id", "uid", "sslversion", "server_name", "subject", "issuer")


PARSED_TLS = f"""WITH {EVENTS_SQL} SELECT row_id, uid, 'TLS 1.2' AS sslversion, 's' || (row_id % 4) AS server_name, '' AS subject, '' AS issuer FROM eve WHERE kind = 'tls'"""


def parsed_ssh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.ssh(parse.decode(event_lines(spark, sf_dir)), "row_id").select("row_id", "uid", "client", "version", "server")


PARSED_SSH = f"""WITH {EVENTS_SQL} SELECT row_id, uid, 'c' || (row_id % 3) AS client, '2.0' AS version, 'OpenSSH' AS server FROM eve WHERE kind = 'ssh'"""


def parsed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.files(parse.decode(event_lines(spark, sf_dir)), "row_id").select("row_id", "uid", "size")


PARSED_FILES = f"""WITH {EVENTS_SQL} SELECT row_id, uid, dbytes AS size FROM eve WHERE kind = 'fileinfo'"""


def damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event lines of which some are cut short, empty, untyped or of an unknown type."""
    v, i = F.col("value"), F.col("row_id")
    bad = F.when(i % 50 == 7, F.substring(v, 1, 20)).when(i % 50 == 11, "").when(i % 50 == 13, "[1]").when(i % 50 == 17, F.lit('{"flow_id":1}'))
    bad = bad.when(i % 50 == 19, F.lit('{"event_type":"stats"}')).when(i % 50 == 23, F.concat(F.lit('{"event_type":"alert","src_ip":"192.168.0.'), (i % 8).cast("string"), F.lit('","alert":{"category":"c"}}')))
    return event_lines(spark, sf_dir).withColumn("value", F.coalesce(bad, v))


def routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.route(parse.decode(damaged(spark, sf_dir))).groupBy("branch").agg(F.count("*").alias("n"))


_BAD = "row_id % 50 IN (7, 11, 13, 17, 19)"
ROUTED = f"""WITH {EVENTS_SQL} SELECT CASE WHEN {_BAD} THEN 'reject' WHEN row_id % 50 = 23 THEN 'alert' WHEN kind = 'flow' THEN 'flow' ELSE 'app' END AS branch, count(*) AS n FROM eve GROUP BY 1"""


def dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.rejected(damaged(spark, sf_dir)).groupBy("reason").agg(F.count("*").alias("n"))


DEAD_LETTERS = f"""WITH {EVENTS_SQL} SELECT CASE WHEN row_id % 50 = 19 THEN 'unknown event type' ELSE 'no event' END AS reason, count(*) AS n FROM eve WHERE {_BAD} GROUP BY 1"""


def serve_v3(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features.serve_v3(parse.flows(parse.decode(flow_lines(spark, sf_dir)), "row_id"))
    return rounded(features.aligned(f, FEATURES_V3, "row_id"), "row_id", **{c: c for c in FEATURES_V3})


SERVE_V3 = f"""WITH {FLOWS_SQL}, x AS (SELECT row_id, dport, CAST(age_s AS DOUBLE) AS s, CAST(spkts AS DOUBLE) AS f, CAST(dpkts AS DOUBLE) AS b FROM flows),
y AS (SELECT *, f + b AS n, log10(greatest(s * 1e6, 1.0)) AS l FROM x)
SELECT row_id, CAST(dport AS DOUBLE) AS dest_port, round(s * 1e6, 6) AS duration, round(s * 1000, 6) AS duration_ms, f AS total_fwd_packets, b AS total_bwd_packets, n AS total_packets,
  round(n / greatest(s, 1e-6), 6) AS flow_packets_per_sec, round(f / (b + 1), 6) AS fwd_bwd_ratio, round(b / greatest(f, 1.0), 6) AS pkt_ratio, CAST(b > 0 AS DOUBLE) AS has_response,
  round(s * 1e6 / greatest(n - 1, 1.0), 6) AS flow_iat_mean, CAST(s > 1 AS DOUBLE) AS is_long_connection, round(l, 6) AS log_duration, round(n / greatest(l, 1.0), 6) AS pkts_per_duration,
  s AS acc_age, CAST(ceil(s / 30.0) AS DOUBLE) AS n_flushes, round(log10(s + 1), 6) AS log_acc_age FROM y"""


def serve_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features.serve_v2(parse.flows(parse.decode(flow_lines(spark, sf_dir)), "row_id"))
    return rounded(features.aligned(f, FEATURES_V2, "row_id"), "row_id", **{c: c for c in FEATURES_V2})


SERVE_V2 = f"""WITH {FLOWS_SQL}, x AS (SELECT row_id, dport, CASE WHEN age_s = 0 THEN 1e-6 ELSE CAST(age_s AS DOUBLE) END AS s, CAST(spkts AS DOUBLE) AS f, CAST(dpkts AS DOUBLE) AS b,
  CAST(sbytes AS DOUBLE) AS fb, CAST(dbytes AS DOUBLE) AS bb FROM flows), y AS (SELECT *, fb / greatest(f, 1) AS fp, bb / greatest(b, 1) AS bp FROM x)
SELECT row_id, CAST(dport AS DOUBLE) AS dest_port, round(s * 1e6, 6) AS duration, f AS total_fwd_packets, b AS total_bwd_packets, round((f + b) / greatest(s, 1e-6), 6) AS flow_packets_per_sec,
  round(bb / greatest(fb, 1.0), 6) AS down_up_ratio, f + b AS total_packets, round(f / (b + 1), 6) AS fwd_bwd_ratio, round(s * 1000.0, 6) AS duration_ms, round(fp, 6) AS fwd_bytes_per_pkt,
  round(bp, 6) AS bwd_bytes_per_pkt, round(fp / (bp + 1), 6) AS bytes_ratio, round(fp / (bp + 1), 6) AS pkt_size_ratio, round((fb + bb) / greatest(f + b, 1), 6) AS flow_bytes_per_pkt FROM y"""


def adaptive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values under other names: packets nested in ``flow``, bytes and port at the top."""
    raw = flows(spark, sf_dir).select(
        "row_id", F.col("dport").cast("string").alias("dest_port"), F.struct(F.col("spkts").cast("string").alias("pkts_toserver"), F.when(F.col("dpkts") > 0, F.col("dpkts")).alias("pkts_toclient"),
        F.expr("t_us div 1000000").alias("start"), (F.expr("t_us div 1000000") + F.col("age_s")).alias("end")).alias("flow"), F.col("sbytes").alias("bytes_toserver"), "dbytes",
    )
    out = features.adaptive(raw)
    return rounded(out, "row_id", "dest_port", "total_fwd_packets", "total_bwd_packets", "total_fwd_bytes", "total_bwd_bytes", digits=1, duration="duration", flow_bytes_per_sec="flow_bytes_per_sec", down_up_ratio="down_up_ratio")


ADAPTIVE = f"""WITH {FLOWS_SQL} SELECT row_id, CAST(dport AS BIGINT) AS dest_port, spkts AS total_fwd_packets, dpkts AS total_bwd_packets, sbytes AS total_fwd_bytes, dbytes AS total_bwd_bytes,
  round(CAST(age_s AS DOUBLE), 1) AS duration, round((sbytes + dbytes) / greatest(CAST(age_s AS DOUBLE), 0.001), 1) AS flow_bytes_per_sec,
  round(CASE WHEN sbytes > 0 THEN CAST(dbytes AS DOUBLE) / sbytes ELSE 0.0 END, 1) AS down_up_ratio FROM flows"""


def hashed_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct states keep distinct stable buckets; checked by counts per bucket rank."""
    f = flows(spark, sf_dir).withColumn("bucket", features.hashed(F.col("state")))
    return f.groupBy("bucket").agg(F.count("*").alias("n"), F.min("state").alias("state")).select("state", "n")


HASHED_STATES = f"WITH {FLOWS_SQL} SELECT state, count(*) AS n FROM flows GROUP BY state"

EXTRA_RULES = [("test", "10.0.0.0/30", [80, 443], [], "a"), ("test", "10.1.0.0/24", [443], ["TCP"], "b"), ("dns", "10.0.0.1", [53], [], "local DNS")]
_RULES = whitelist.default_rules() + EXTRA_RULES


def _values() -> str:
    text = lambda xs: "[" + ", ".join(repr(x) for x in xs) + "]"
    return ", ".join(f"({cidr_range(a)[0]}, {cidr_range(a)[1]}, {text(p)}::INT[], {text(q)}::VARCHAR[])" for _, a, p, q, _ in _RULES)


def whitelisted(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = whitelist.whitelist(spark, whitelist.default_rules())
    rules = whitelist.extended(base, whitelist.whitelist(spark, EXTRA_RULES + whitelist.default_rules()[:3]))
    return whitelist.mark_whitelisted(flows(spark, sf_dir).select("row_id", "daddr", "dport", "proto"), rules)


_IP = "(split_part(daddr, '.', 1)::BIGINT * 16777216 + split_part(daddr, '.', 2)::BIGINT * 65536 + split_part(daddr, '.', 3)::BIGINT * 256 + split_part(daddr, '.', 4)::BIGINT)"
_HIT = f"EXISTS (SELECT 1 FROM rules r WHERE {_IP} BETWEEN lo AND hi AND (len(ports) = 0 OR list_contains(ports, dport)) AND (len(protos) = 0 OR list_contains(protos, proto)))"
WHITELISTED = f"WITH {FLOWS_SQL}, rules(lo, hi, ports, protos) AS (VALUES {_values()}) SELECT row_id, daddr, dport, proto, {_HIT} AS whitelisted FROM flows"


def not_whitelisted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = whitelist.whitelist(spark, _RULES)
    return whitelist.drop_whitelisted(flows(spark, sf_dir), rules).groupBy("saddr", "proto").agg(F.count("*").alias("n"))


NOT_WHITELISTED = f"WITH {FLOWS_SQL}, rules(lo, hi, ports, protos) AS (VALUES {_values()}) SELECT saddr, proto, count(*) AS n FROM flows WHERE NOT {_HIT} GROUP BY 1, 2"


def filtered_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """local sources and unroutable addresses go; membership in one block is told."""
    f = flows(spark, sf_dir)
    odd = F.when(F.col("row_id") % 20 == 3, "224.0.0.251").when(F.col("row_id") % 20 == 4, "ff02:1::").when(F.col("row_id") % 20 == 5, "255.255.255.255").otherwise(F.col("daddr"))
    src = F.when(F.col("row_id") % 20 == 6, "fe80::1").when(F.col("row_id") % 20 == 7, "0.0.0.0").otherwise(F.col("saddr"))
    left = whitelist.routable(whitelist.drop_sources(f.withColumns({"daddr": odd, "saddr": src}), ["192.168.0.2", "127.0.0.1"]))
    return left.select("row_id", whitelist.in_cidr(F.col("daddr"), "10.1.0.0/17").alias("in_block"))


FILTERED_FLOWS = f"""WITH {FLOWS_SQL} SELECT row_id, daddr LIKE '10.1.%' AND split_part(daddr, '.', 3)::INT < 128 AS in_block FROM flows
  WHERE row_id % 20 NOT IN (3, 4, 5, 6, 7) AND saddr <> '192.168.0.2'"""


def signature_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id and a decoded signature event for every flow."""
    i = F.col("row_id")
    category = F.when(i % 3 == 0, "Not Suspicious Traffic").when(i % 3 == 1, "Web Attack")
    line = F.to_json(F.struct(F.lit("alert").alias("event_type"), F.col("saddr").alias("src_ip"), F.col("daddr").alias("dest_ip"), F.col("dport").alias("dest_port"), "proto", F.struct(F.lit("sig").alias("signature"), category.alias("category"), (i % 4).alias("severity")).alias("alert")))
    return parse.decode(flows(spark, sf_dir).select("row_id", line.alias("value")))


def signature_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alerts.signature_alerts(signature_lines(spark, sf_dir), "row_id")
    return found.select("row_id", "src_ip", "dst_ip", "dst_port", "predicted_class", "signature", "category", "severity", "is_attack")


SIGNATURE_ALERTS = f"""WITH {FLOWS_SQL} SELECT row_id, saddr AS src_ip, daddr AS dst_ip, dport AS dst_port, 'Suricata Alert' AS predicted_class, 'sig' AS signature,
  CASE WHEN row_id % 3 = 1 THEN 'Web Attack' END AS category, CAST(row_id % 4 AS INTEGER) AS severity, true AS is_attack FROM flows WHERE row_id % 3 <> 0"""

QUERIES = {
    "parsed_flows": (parsed_flows, PARSED_FLOWS), "parsed_http": (parsed_http, PARSED_HTTP), "parsed_dns": (parsed_dns, PARSED_DNS), "parsed_tls": (parsed_tls, PARSED_TLS),
    "parsed_ssh": (parsed_ssh, PARSED_SSH), "parsed_files": (parsed_files, PARSED_FILES), "routed_events": (routed, ROUTED), "dead_letters": (dead_letters, DEAD_LETTERS),
    "features_serve_v3": (serve_v3, SERVE_V3), "features_serve_v2": (serve_v2, SERVE_V2), "features_adaptive": (adaptive, ADAPTIVE), "hashed_states": (hashed_states, HASHED_STATES),
    "whitelisted_flows": (whitelisted, WHITELISTED), "not_whitelisted": (not_whitelisted, NOT_WHITELISTED), "filtered_flows": (filtered_flows, FILTERED_FLOWS), "signature_alerts": (signature_alerts, SIGNATURE_ALERTS),
}
