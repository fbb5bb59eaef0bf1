"""Queries of source behaviour, and the flagship query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features, parse
from ..operators import behavior as ops
from .events import rounded
from .fixtures import FLOWS_SQL, flow_lines, flows


def as_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows as finished sessions with application events by arithmetic."""
    i = F.col("row_id")
    none = F.array().cast("array<string>")
    status = F.element_at(F.array(*map(F.lit, ("200", "401", "404", "500", "403"))), (i % 5 + 1).cast("int"))
    when = lambda test: F.when(test, 1).otherwise(0)
    f = flows(spark, sf_dir).withColumnsRenamed({"spkts": "total_fwd_packets", "dpkts": "total_bwd_packets", "sbytes": "total_fwd_bytes", "dbytes": "total_bwd_bytes"})
    return f.withColumns({
        "http_event_count": when(i % 4 == 0), "http_status_codes": F.when(i % 4 == 0, F.array(status)).otherwise(none), "dns_event_count": when(i % 4 == 1),
        "dns_answers": F.when(i % 8 == 1, F.array("daddr")).otherwise(none), "tls_event_count": when(i % 8 == 2), "ssh_event_count": when(i % 8 == 6),
        "appproto": F.when(i % 4 == 0, "http").otherwise(""), "is_complete": F.col("state").isin("established", "closed", "rst"),
    })


def scan_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines -> parsed flows -> serving features -> window scores -> alerts above 0.5."""
    parsed = features.serve_v3(parse.flows(parse.decode(flow_lines(spark, sf_dir)), "row_id", "t_us"))
    rows = parsed.select("row_id", "t_us", "saddr", "daddr", "dport", "flow_packets_per_sec", F.col("sbytes").alias("total_fwd_bytes"), F.col("spkts").alias("total_fwd_packets"))
    found = ops.anomalous(ops.scores(ops.window_figures(rows, failures=False)))
    kind = F.when(F.col("port_scan_score") >= F.col("host_scan_score"), "port_scan").otherwise("host_scan")
    return rounded(found.withColumn("kind", kind), "row_id", "saddr", "kind", "ports", "ips", digits=4, score="overall_score", flow_packets_per_sec="flow_packets_per_sec")


_W = "(PARTITION BY saddr ORDER BY t_us RANGE BETWEEN 299999999 PRECEDING AND CURRENT ROW)"
_COUNTS = f"""counts AS (SELECT *, count(DISTINCT dport) OVER {_W} AS ports, count(DISTINCT daddr) OVER {_W} AS ips, sum(sbytes) OVER {_W} AS window_bytes, sum(spkts) OVER {_W} AS window_packets FROM flows)"""
_SCANS = """CASE WHEN CAST(ports AS DOUBLE) / ips > 10 THEN least(1.0, CAST(ports AS DOUBLE) / ips / 50) ELSE 0.0 END AS port_scan_score, CASE WHEN CAST(ips AS DOUBLE) / ports > 5 THEN least(1.0, CAST(ips AS DOUBLE) / ports / 20) ELSE 0.0 END AS host_scan_score,
  greatest(CASE WHEN window_bytes / 300.0 > 1e6 THEN least(1.0, window_bytes / 300.0 / 1e7) ELSE 0.0 END, CASE WHEN window_packets / 300.0 > 1e3 THEN least(1.0, window_packets / 300.0 / 1e4) ELSE 0.0 END) AS volume_score"""
SCAN_ALERTS = f"""WITH {FLOWS_SQL}, {_COUNTS}, s AS (SELECT *, {_SCANS} FROM counts)
SELECT row_id, saddr, CASE WHEN port_scan_score >= host_scan_score THEN 'port_scan' ELSE 'host_scan' END AS kind, ports, ips, round(greatest(port_scan_score, host_scan_score, volume_score), 4) AS score,
  round((spkts + dpkts) / greatest(CAST(age_s AS DOUBLE), 1e-6), 4) AS flow_packets_per_sec FROM s WHERE greatest(port_scan_score, host_scan_score, volume_score) > 0.5"""

_SESSIONS = FLOWS_SQL + f""",
ses AS (SELECT *, CASE row_id % 5 WHEN 0 THEN '200' WHEN 1 THEN '401' WHEN 2 THEN '404' WHEN 3 THEN '500' ELSE '403' END AS status, CASE WHEN row_id % 4 = 0 THEN 'http' ELSE proto || '-' || dport END AS service FROM flows),
auth AS (SELECT *, CASE WHEN row_id % 4 = 0 AND (status LIKE '4%' OR status LIKE '5%') THEN 1 ELSE 0 END AS http_errors, CASE WHEN row_id % 8 = 5 THEN 1 ELSE 0 END AS dns_failures,
  CASE WHEN row_id % 8 = 2 AND state = 'rejected' THEN 1 ELSE 0 END AS tls_failures, CASE WHEN row_id % 4 = 0 AND status IN ('401', '403') THEN 1 WHEN row_id % 8 = 6 AND state = 'rejected' THEN 1 ELSE 0 END AS auth_failures FROM ses),
counts AS (SELECT *, count(DISTINCT dport) OVER {_W} AS ports, count(DISTINCT daddr) OVER {_W} AS ips, sum(sbytes) OVER {_W} AS window_bytes, sum(spkts) OVER {_W} AS window_packets FROM auth),
bad AS (SELECT row_id, max(n) AS most FROM (SELECT f.row_id, a.service, sum(a.auth_failures) AS n FROM auth f JOIN auth a ON a.saddr = f.saddr AND a.auth_failures > 0 AND a.t_us <= f.t_us AND a.t_us > f.t_us - 300000000 GROUP BY 1, 2) GROUP BY 1),
scored AS (SELECT c.*, coalesce(most, 0) AS most, {_SCANS}, CASE WHEN coalesce(most, 0) > 3 THEN least(1.0, most / 20.0) ELSE 0.0 END AS brute_force_score FROM counts c LEFT JOIN bad USING (row_id)),
total AS (SELECT *, greatest(port_scan_score, host_scan_score, brute_force_score, volume_score) AS overall_score FROM scored)"""

_NAMES = ["port_scan_score", "host_scan_score", "brute_force_score", "volume_score", "overall_score"]


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = ops.auth_failures(as_sessions(spark, sf_dir))
    return rounded(ops.scores(ops.window_figures(s)), "row_id", "saddr", "ports", "ips", "window_bytes", "window_packets", "http_errors", "dns_failures", "tls_failures", "auth_failures", **{c: c for c in _NAMES})


SCORES = f"""WITH {_SESSIONS} SELECT row_id, saddr, ports, ips, CAST(window_bytes AS BIGINT) AS window_bytes, CAST(window_packets AS BIGINT) AS window_packets, http_errors, dns_failures, tls_failures, auth_failures,
  {", ".join(f"round({c}, 6) AS {c}" for c in _NAMES)} FROM total"""

_RATES = ["flow_rate", "complete_flow_ratio", "dst_ips_per_second", "dst_ports_per_second", "bytes_sent_per_second", "packets_sent_per_second", "http_error_ratio", "dns_failure_ratio", "tls_failure_ratio", "auth_failures_per_second", "rejected_ratio", "reset_ratio"]


def analyzed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions with figures, scores and features, without the columns that are only read to count failures."""
    return ops.analyze_counted(ops.auth_failures(as_sessions(spark, sf_dir)).drop("flow_id", "event_type", "age_s", "appproto", "http_status_codes", "dns_answers"))


def behavior_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(analyzed(spark, sf_dir), "row_id", "saddr", "epoch", "total_flows", "unique_dst_ips", "unique_dst_ports", digits=9, **{c: c for c in _RATES})


_LIFE = _SESSIONS + """,
idle AS (SELECT *, CASE WHEN t_us - lag(t_us) OVER (PARTITION BY saddr ORDER BY t_us, row_id) > 300000000 THEN 1 ELSE 0 END AS gap FROM total),
ep AS (SELECT *, CAST(sum(gap) OVER (PARTITION BY saddr ORDER BY t_us, row_id) AS BIGINT) AS epoch FROM idle),
life AS (SELECT *, min(t_us) OVER w AS first_us, count(*) OVER w AS total_flows, count(DISTINCT daddr) OVER w AS u_ips, count(DISTINCT dport) OVER w AS u_ports, count(*) FILTER (state IN ('established', 'closed', 'rst')) OVER w AS done,
    sum(http_errors) OVER w AS he, count(*) FILTER (row_id % 4 = 0) OVER w AS h, sum(dns_failures) OVER w AS de, count(*) FILTER (row_id % 4 = 1) OVER w AS dn, sum(tls_failures) OVER w AS te, count(*) FILTER (row_id % 8 = 2) OVER w AS tl,
    sum(auth_failures) OVER w AS af, count(*) FILTER (state = 'rejected') OVER w AS rej, count(*) FILTER (state = 'rst') OVER w AS rst
  FROM ep WINDOW w AS (PARTITION BY saddr, epoch ORDER BY t_us, row_id ROWS UNBOUNDED PRECEDING)),
rate AS (SELECT *, greatest(least((t_us - first_us) / 1e6, 300.0), 0.001) AS s FROM life)"""
BEHAVIOR_FEATURES = f"""WITH {_LIFE} SELECT row_id, saddr, epoch, total_flows, u_ips AS unique_dst_ips, u_ports AS unique_dst_ports, round(total_flows / s, 9) AS flow_rate, round(CAST(done AS DOUBLE) / total_flows, 9) AS complete_flow_ratio,
  round(ips / s, 9) AS dst_ips_per_second, round(ports / s, 9) AS dst_ports_per_second, round(window_bytes / s, 9) AS bytes_sent_per_second, round(window_packets / s, 9) AS packets_sent_per_second,
  round(CAST(he AS DOUBLE) / greatest(1, h), 9) AS http_error_ratio, round(CAST(de AS DOUBLE) / greatest(1, dn), 9) AS dns_failure_ratio, round(CAST(te AS DOUBLE) / greatest(1, tl), 9) AS tls_failure_ratio, round(af / s, 9) AS auth_failures_per_second,
  round(CAST(rej AS DOUBLE) / total_flows, 9) AS rejected_ratio, round(CAST(rst AS DOUBLE) / total_flows, 9) AS reset_ratio FROM rate"""


STRETCH = 60  # so far apart many sessions of a source come more than 300 s after the last


def source_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W11 where sources do fall silent: the epoch of each session and the counters that start anew with it."""
    stretched = ops.auth_failures(as_sessions(spark, sf_dir)).withColumn("t_us", F.col("t_us") * STRETCH)
    counted = ops.lifetime(ops.source_epochs(stretched))
    return counted.select("row_id", "saddr", "epoch", "total_flows", "unique_dst_ports", "first_seen_us")


SOURCE_EPOCHS = f"""WITH {FLOWS_SQL}, s AS (SELECT *, t_us * {STRETCH} AS t FROM flows), idle AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY saddr ORDER BY t, row_id) > 300000000 THEN 1 ELSE 0 END AS gap FROM s),
ep AS (SELECT *, CAST(sum(gap) OVER (PARTITION BY saddr ORDER BY t, row_id) AS BIGINT) AS epoch FROM idle)
SELECT row_id, saddr, epoch, count(*) OVER w AS total_flows, count(DISTINCT dport) OVER w AS unique_dst_ports, min(t) OVER w AS first_seen_us FROM ep WINDOW w AS (PARTITION BY saddr, epoch ORDER BY t, row_id ROWS UNBOUNDED PRECEDING)"""


def scored_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.scores(ops.window_figures(ops.auth_failures(as_sessions(spark, sf_dir))))


def anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ops.anomalous(scored_sources(spark, sf_dir)), "row_id", "saddr", overall_score="overall_score")


ANOMALIES = f"WITH {_SESSIONS} SELECT row_id, saddr, round(overall_score, 6) AS overall_score FROM total WHERE overall_score > 0.5"
_LATEST = _SESSIONS + ", latest AS (SELECT * FROM total QUALIFY row_number() OVER (PARTITION BY saddr ORDER BY t_us DESC, row_id DESC) = 1)"


def top_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ops.top_sources(scored_sources(spark, sf_dir), 5), "saddr", overall_score="overall_score")


TOP_SOURCES = f"WITH {_LATEST} SELECT saddr, round(overall_score, 6) AS overall_score FROM latest ORDER BY latest.overall_score DESC, saddr LIMIT 5"


def scan_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ops.scan_activity(scored_sources(spark, sf_dir), 0.1), "saddr", "scan_type", score="score")


SCAN_ACTIVITY = f"""WITH {_LATEST} SELECT saddr, CASE WHEN port_scan_score > 0.1 THEN 'port_scan' ELSE 'host_scan' END AS scan_type, round(CASE WHEN port_scan_score > 0.1 THEN port_scan_score ELSE host_scan_score END, 6) AS score
  FROM latest WHERE port_scan_score > 0.1 OR host_scan_score > 0.1"""


def brute_force(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ops.brute_force_activity(scored_sources(spark, sf_dir), 0.1), "saddr", brute_force_score="brute_force_score")


BRUTE_FORCE = f"WITH {_LATEST} SELECT saddr, round(brute_force_score, 6) AS brute_force_score FROM latest WHERE brute_force_score > 0.1"


def source_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.statistics(scored_sources(spark, sf_dir))


SOURCE_STATISTICS = f"WITH {_LATEST} SELECT count(*) AS tracked_ips, count(*) FILTER (overall_score > 0.5) AS anomalous_ips FROM latest"


def source_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ops.of_source(scored_sources(spark, sf_dir), "192.168.0.1"), "row_id", "saddr", overall_score="overall_score")


SOURCE_LOOKUP = f"WITH {_LATEST} SELECT row_id, saddr, round(overall_score, 6) AS overall_score FROM latest WHERE saddr = '192.168.0.1'"


def newest_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.newest_sources(as_sessions(spark, sf_dir), 3).select("saddr", "t_us", "row_id")


NEWEST_SOURCES = f"WITH {FLOWS_SQL} SELECT saddr, t_us, row_id FROM flows QUALIFY row_number() OVER (PARTITION BY saddr ORDER BY t_us DESC, row_id DESC) = 1 ORDER BY t_us DESC, saddr LIMIT 3"


def source_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = as_sessions(spark, sf_dir)
    named = lambda c: ops.counters_by(s, c).select("saddr", F.lit(c).alias("what"), F.col(c).alias("value"), "n")
    return named("proto").unionByName(named("appproto")).unionByName(named("state"))


SOURCE_COUNTERS = f"""WITH {FLOWS_SQL} SELECT saddr, 'proto' AS what, proto AS value, count(*) AS n FROM flows GROUP BY 1, 3 UNION ALL SELECT saddr, 'appproto', 'http', count(*) FROM flows WHERE row_id % 4 = 0 GROUP BY 1
  UNION ALL SELECT saddr, 'state', state, count(*) FROM flows GROUP BY 1, 3"""


def coarse_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = as_sessions(spark, sf_dir).withColumn("ts", F.timestamp_micros("t_us"))
    return ops.coarse(s).select(F.unix_micros("start").alias("start_us"), "saddr", "window_bytes", "window_packets")


COARSE_WINDOWS = f"""WITH {FLOWS_SQL}, w AS (SELECT saddr, sbytes, spkts, unnest(generate_series((t_us // 60000000) * 60000000 - 240000000, (t_us // 60000000) * 60000000, 60000000)) AS start_us FROM flows)
SELECT start_us, saddr, sum(sbytes)::BIGINT AS window_bytes, sum(spkts)::BIGINT AS window_packets FROM w GROUP BY 1, 2"""

QUERIES = {
    "source_epochs": (source_epochs, SOURCE_EPOCHS),
    "scan_alerts": (scan_alerts, SCAN_ALERTS), "behavior_scores": (scores, SCORES), "behavior_features": (behavior_features, BEHAVIOR_FEATURES), "behavior_anomalies": (anomalies, ANOMALIES), "top_sources": (top_sources, TOP_SOURCES),
    "scan_activity": (scan_activity, SCAN_ACTIVITY), "brute_force_activity": (brute_force, BRUTE_FORCE), "source_statistics": (source_statistics, SOURCE_STATISTICS), "source_lookup": (source_lookup, SOURCE_LOOKUP),
    "newest_sources": (newest_sources, NEWEST_SOURCES), "source_counters": (source_counters, SOURCE_COUNTERS), "coarse_windows": (coarse_windows, COARSE_WINDOWS),
}
