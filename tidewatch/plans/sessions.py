"""Queries of sessions, alerts, cooldown and results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import alerts, features, parse, scoring
from ..operators import sessions as ops
from .events import rounded, signature_lines
from .fixtures import EVENTS_SQL, FLOWS_SQL, SCORES_SQL, event_lines, flows, scores

CLOSER = 10_000  # sessions without bytes lie too far apart for bursts; so many times closer some are
TIMEOUT_S = 0.5  # the tables' events lie close together; so some sessions expire


def built(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.build(parse.decode(event_lines(spark, sf_dir)), "row_id", TIMEOUT_S)


_SESSIONS = EVENTS_SQL + f""",
marked AS (SELECT *, kind = 'flow' AND state IN ('closed', 'established', 'fin', 'rst') AS closes, lag(t_us) OVER w AS before_us FROM eve WINDOW w AS (PARTITION BY uid ORDER BY t_us, row_id)),
started AS (SELECT *, CASE WHEN lag(closes) OVER w OR t_us - before_us > {int(TIMEOUT_S * 1e6)} THEN 1 ELSE 0 END AS starts FROM marked WINDOW w AS (PARTITION BY uid ORDER BY t_us, row_id)),
numbered AS (SELECT *, sum(starts) OVER (PARTITION BY uid ORDER BY t_us, row_id) AS epoch FROM started),
merged AS (
  SELECT uid, CAST(epoch AS BIGINT) AS epoch, first(saddr ORDER BY t_us, row_id) AS saddr, first(daddr ORDER BY t_us, row_id) AS daddr, first(dport ORDER BY t_us, row_id) AS dport, first(proto ORDER BY t_us, row_id) AS proto,
    least(min(t_us) FILTER (kind = 'flow'), CASE WHEN first(kind ORDER BY t_us, row_id) <> 'flow' THEN min(t_us) END) AS start_us, max(t_us) FILTER (kind = 'flow') AS end_us,
    coalesce(last(state ORDER BY t_us, row_id) FILTER (kind = 'flow'), '') AS state, coalesce(first(kind ORDER BY t_us, row_id) FILTER (kind IN ('http', 'dns', 'tls', 'ssh')), '') AS appproto,
    coalesce(last(age_s ORDER BY t_us, row_id) FILTER (kind = 'flow' AND age_s <> 0), 0) AS age,
    coalesce(max(spkts) FILTER (kind = 'flow'), 0) AS fp, coalesce(max(dpkts) FILTER (kind = 'flow'), 0) AS bp, coalesce(max(sbytes) FILTER (kind = 'flow'), 0) AS fb, coalesce(max(dbytes) FILTER (kind = 'flow'), 0) AS bb,
    count(*) FILTER (kind = 'http') AS http_n, count(*) FILTER (kind = 'dns') AS dns_n, count(*) FILTER (kind = 'tls') AS tls_n, count(*) FILTER (kind = 'ssh') AS ssh_n, count(*) FILTER (kind = 'fileinfo') AS file_n, count(*) FILTER (kind = 'flow') AS flow_n,
    max(status) FILTER (kind = 'http') AS status, max(method) FILTER (kind = 'http') AS method, coalesce(sum(CASE WHEN row_id % 24 = 9 THEN 2 WHEN row_id % 8 = 1 THEN 1 ELSE 0 END) FILTER (kind = 'dns'), 0) AS answers_n,
    max(t_us) AS last_us, last(closes ORDER BY t_us, row_id) AS closed
  FROM numbered GROUP BY uid, epoch),
sessions AS (SELECT *, CASE WHEN age <> 0 THEN CAST(age AS DOUBLE) ELSE coalesce((end_us - start_us) / 1e6, 0.0) END AS duration FROM merged)"""


def session_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = built(spark, sf_dir).withColumns({"start_us": F.unix_micros("starttime"), "end_us": F.unix_micros("endtime"), "last_us": F.unix_micros("last_updated")})
    keep = ["uid", "epoch", "saddr", "daddr", "dport", "proto", "start_us", "end_us", "state", "appproto", "total_fwd_packets", "total_bwd_packets", "total_fwd_bytes", "total_bwd_bytes", "http_event_count", "dns_event_count", "tls_event_count", "ssh_event_count", "file_event_count", "last_us", "closed"]
    lists = [F.array_join(c, ",").alias(c) for c in ("http_methods", "http_status_codes")] + [F.size("dns_answers").alias("dns_answer_count")]
    return rounded(s.select(*keep, *lists, "duration", "flow_bytes_per_sec", "flow_packets_per_sec", "down_up_ratio"), *keep, "http_methods", "http_status_codes", "dns_answer_count", digits=3, duration="duration", flow_bytes_per_sec="flow_bytes_per_sec", flow_packets_per_sec="flow_packets_per_sec", down_up_ratio="down_up_ratio")


SESSION_ROWS = f"""WITH {_SESSIONS} SELECT uid, epoch, saddr, daddr, dport, proto, start_us, end_us, state, appproto, fp AS total_fwd_packets, bp AS total_bwd_packets, fb AS total_fwd_bytes, bb AS total_bwd_bytes,
  http_n AS http_event_count, dns_n AS dns_event_count, tls_n AS tls_event_count, ssh_n AS ssh_event_count, file_n AS file_event_count, last_us, closed, coalesce(method, '') AS http_methods, coalesce(status, '') AS http_status_codes,
  CAST(answers_n AS INTEGER) AS dns_answer_count, round(duration, 3) AS duration, round((fb + bb) / greatest(duration, 0.001), 3) AS flow_bytes_per_sec, round((fp + bp) / greatest(duration, 0.001), 3) AS flow_packets_per_sec,
  round(CASE WHEN fb > 0 THEN CAST(bb AS DOUBLE) / fb ELSE 0.0 END, 3) AS down_up_ratio FROM sessions"""


def session_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = features.app_layer(built(spark, sf_dir))
    return s.select(
        "uid", "epoch", "has_http", "has_http_get", "has_http_post", "http_method_count", "has_http_error", "has_http_auth_error", "has_dns", "dns_query_count", "dns_answer_count", "has_dns_failure", "has_tls", "tls_sni_count",
        "has_ssh", "is_rejected", "is_established", "is_closed", "is_reset", "app_layer_count", "has_mixed_protocols",
    )


_LAYERS = "(http_n > 0)::INT + (dns_n > 0)::INT + (tls_n > 0)::INT + (ssh_n > 0)::INT"
SESSION_FEATURES = f"""WITH {_SESSIONS} SELECT uid, epoch, (http_n > 0)::INT AS has_http, coalesce(method = 'GET', false)::INT AS has_http_get, coalesce(method = 'POST', false)::INT AS has_http_post, (method IS NOT NULL)::INT AS http_method_count,
  coalesce(status LIKE '4%' OR status LIKE '5%', false)::INT AS has_http_error, coalesce(status IN ('401', '403', '407'), false)::INT AS has_http_auth_error, (dns_n > 0)::INT AS has_dns, dns_n::INT AS dns_query_count, answers_n::INT AS dns_answer_count,
  (dns_n > 0 AND answers_n = 0)::INT AS has_dns_failure, (tls_n > 0)::INT AS has_tls, tls_n::INT AS tls_sni_count, (ssh_n > 0)::INT AS has_ssh, (state = 'rejected')::INT AS is_rejected, (state = 'established')::INT AS is_established,
  (state IN ('closed', 'fin'))::INT AS is_closed, (state = 'rst')::INT AS is_reset, {_LAYERS} AS app_layer_count, ({_LAYERS} > 1)::INT AS has_mixed_protocols FROM sessions"""


def session_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.app_info(built(spark, sf_dir)).select("uid", "epoch", "unique_http_methods", "has_http_error", "has_http_auth", "unique_dns_queries", "dns_answer_count", "tls_sni_count", "has_mixed_app_data", "file_event_count")


SESSION_INFO = f"""WITH {_SESSIONS} SELECT uid, epoch, (method IS NOT NULL)::INT AS unique_http_methods, coalesce(status LIKE '4%' OR status LIKE '5%', false) AS has_http_error, coalesce(status IN ('401', '407'), false) AS has_http_auth,
  dns_n::INT AS unique_dns_queries, answers_n::INT AS dns_answer_count, tls_n::INT AS tls_sni_count, {_LAYERS} > 1 AS has_mixed_app_data, file_n AS file_event_count FROM sessions"""


def session_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = features.session_row(built(spark, sf_dir))
    return rounded(s, "uid", "epoch", "dest_port", digits=3, duration="duration", flow_bytes_per_sec="flow_bytes_per_sec", down_up_ratio="down_up_ratio")


SESSION_FALLBACK = f"""WITH {_SESSIONS}, x AS (SELECT *, CASE WHEN duration = 0 THEN 1e-6 ELSE duration END AS s FROM sessions)
SELECT uid, epoch, dport AS dest_port, round(s, 3) AS duration, round((fb + bb) / s, 3) AS flow_bytes_per_sec, round(CAST(bb AS DOUBLE) / greatest(fb, 1), 3) AS down_up_ratio FROM x"""


def session_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.statistics(built(spark, sf_dir))


SESSION_STATISTICS = f"""WITH {_SESSIONS} SELECT count(*) AS total_sessions, count(*) FILTER (closed) AS closed_sessions, count(*) FILTER (NOT closed) AS expired_sessions, sum(flow_n)::BIGINT AS flow_events, sum(http_n)::BIGINT AS http_events,
  sum(dns_n)::BIGINT AS dns_events, sum(tls_n)::BIGINT AS tls_events, sum(ssh_n)::BIGINT AS ssh_events, sum(file_n)::BIGINT AS file_events FROM sessions"""


def newest_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.newest(built(spark, sf_dir), 100).select("uid", "epoch", F.unix_micros("last_updated").alias("last_us"))


NEWEST_SESSIONS = f"WITH {_SESSIONS} SELECT uid, epoch, last_us FROM sessions ORDER BY last_us DESC, uid, epoch LIMIT 100"


def session_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = built(spark, sf_dir)
    return ops.by_source(s, "192.168.0.3").withColumn("found", F.lit("source")).unionByName(ops.by_destination_port(s, 443).withColumn("found", F.lit("port"))).select("uid", "epoch", "found")


SESSION_LOOKUP = f"WITH {_SESSIONS} SELECT uid, epoch, 'source' AS found FROM sessions WHERE saddr = '192.168.0.3' UNION ALL SELECT uid, epoch, 'port' FROM sessions WHERE dport = 443"


EACH = 24  # events of a flow id, several of them flows, in sessions that never expire
_LISTED = ["http_methods", "http_status_codes", "http_hosts", "http_uris", "dns_queries", "dns_answers", "tls_sni", "tls_versions", "ssh_client_versions", "ssh_server_versions"]


def busy_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2-A6 where they matter: several flows with other figures each, and many values of each list."""
    s = ops.build(parse.decode(event_lines(spark, sf_dir, EACH)), "row_id", 1e9)
    figures = ["uid", "epoch", "state", "appproto", "closed", "total_fwd_packets", "total_bwd_packets", "total_fwd_bytes", "total_bwd_bytes", "flow_event_count", "http_event_count"]
    return rounded(s.select(*figures, "duration", *[F.array_join(c, ",").alias(c) for c in _LISTED]), *figures, *_LISTED, duration="duration")


_LIST_VALUES = {
    "http_methods": ("http", "method"), "http_status_codes": ("http", "status"), "http_hosts": ("http", "'h.example'"), "http_uris": ("http", "'/p' || (row_id % 7)"), "dns_queries": ("dns", "'q' || (row_id % 5) || '.example'"),
    "tls_sni": ("tls", "'s' || (row_id % 4)"), "tls_versions": ("tls", "'TLS 1.2'"), "ssh_client_versions": ("ssh", "'c' || (row_id % 3)"), "ssh_server_versions": ("ssh", "'OpenSSH'"),
}
BUSY_SESSIONS = f"""WITH {EVENTS_SQL},
own AS (SELECT * REPLACE (CAST(row_id // {EACH} AS VARCHAR) AS uid), row_number() OVER (ORDER BY t_us, row_id) * 2 AS o, kind = 'flow' AND state IN ('closed', 'established', 'fin', 'rst') AS closes FROM eve),
numbered AS (SELECT *, CAST(coalesce(sum(closes::INT) OVER (PARTITION BY uid ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS epoch FROM own),
merged AS (SELECT uid, epoch, coalesce(last(state ORDER BY o) FILTER (kind = 'flow'), '') AS state, coalesce(first(kind ORDER BY o) FILTER (kind IN ('http', 'dns', 'tls', 'ssh')), '') AS appproto, last(closes ORDER BY o) AS closed,
  coalesce(last(age_s ORDER BY o) FILTER (kind = 'flow' AND age_s <> 0), 0) AS age, coalesce(last(spkts ORDER BY o) FILTER (kind = 'flow'), 0) AS fp, coalesce(last(dpkts ORDER BY o) FILTER (kind = 'flow'), 0) AS bp,
  coalesce(last(sbytes ORDER BY o) FILTER (kind = 'flow'), 0) AS fb, coalesce(last(dbytes ORDER BY o) FILTER (kind = 'flow'), 0) AS bb, count(*) FILTER (kind = 'flow') AS flow_n, count(*) FILTER (kind = 'http') AS http_n,
  least(min(t_us) FILTER (kind = 'flow'), CASE WHEN first(kind ORDER BY o) <> 'flow' THEN min(t_us) END) AS start_us, max(t_us) FILTER (kind = 'flow') AS end_us FROM numbered GROUP BY uid, epoch),
vals AS ({" UNION ALL ".join(f"SELECT uid, epoch, '{n}' AS name, {v} AS v, o FROM numbered WHERE kind = '{k}'" for n, (k, v) in _LIST_VALUES.items())}
  UNION ALL SELECT uid, epoch, 'dns_answers', 'c.example', o FROM numbered WHERE row_id % 24 = 9 UNION ALL SELECT uid, epoch, 'dns_answers', daddr, o + 1 FROM numbered WHERE row_id % 8 = 1),
firsts AS (SELECT uid, epoch, name, v, min(o) AS o FROM vals GROUP BY ALL),
lists AS (SELECT uid, epoch, {", ".join(f"coalesce(string_agg(v, ',' ORDER BY o) FILTER (name = '{n}'), '') AS {n}" for n in _LISTED)} FROM firsts GROUP BY uid, epoch)
SELECT m.uid, m.epoch, state, appproto, closed, fp AS total_fwd_packets, bp AS total_bwd_packets, fb AS total_fwd_bytes, bb AS total_bwd_bytes, flow_n AS flow_event_count, http_n AS http_event_count,
  round(CASE WHEN age <> 0 THEN CAST(age AS DOUBLE) ELSE coalesce((end_us - start_us) / 1e6, 0.0) END, 6) AS duration, {", ".join(f"coalesce({n}, '') AS {n}" for n in _LISTED)}
FROM merged m LEFT JOIN lists l ON l.uid = m.uid AND l.epoch = m.epoch"""


def as_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = flows(spark, sf_dir)
    return f.withColumnsRenamed({"spkts": "total_fwd_packets", "dpkts": "total_bwd_packets", "sbytes": "total_fwd_bytes", "dbytes": "total_bwd_bytes"})


def zero_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    closer = as_sessions(spark, sf_dir).withColumn("t_us", F.expr(f"t_us div {CLOSER}"))
    return rounded(alerts.zero_byte_bursts(closer), "row_id", "dest_key", "zero_count", "zero_detected", zero_rate="zero_rate")


_ZERO = f"""z AS (SELECT *, daddr || ':' || dport || ':' || proto AS dest_key, CAST(row_number() OVER w AS INTEGER) AS zero_count, greatest(((t_us // {CLOSER}) - min((t_us // {CLOSER})) OVER w) / 1e6, 0.001) AS since FROM flows WHERE sbytes + dbytes <= 0
  WINDOW w AS (PARTITION BY saddr, daddr || ':' || dport || ':' || proto ORDER BY (t_us // {CLOSER}), row_id))"""
ZERO_BYTES = f"WITH {FLOWS_SQL}, {_ZERO} SELECT row_id, dest_key, zero_count, zero_count >= 3 AND zero_count / since > 1.0 AS zero_detected, round(zero_count / since, 6) AS zero_rate FROM z"


def scored_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows(spark, sf_dir).join(scoring.decide(scores(spark, sf_dir)), "row_id")


_DECIDED = """d0 AS (SELECT *, 0.2::DOUBLE * "PortScan_dt" + 0.3::DOUBLE * "PortScan_rf" + 0.5::DOUBLE * "PortScan_xgb" AS p, 0.2::DOUBLE * "DoS_dt" + 0.3::DOUBLE * "DoS_rf" + 0.5::DOUBLE * "DoS_xgb" AS q FROM scores),
d AS (SELECT *, CASE WHEN p >= q THEN 'PortScan' ELSE 'DoS' END AS best_label, greatest(p, q) AS top, greatest(p, q) >= CASE WHEN p >= q THEN 0.5 ELSE 0.55 END AS is_attack FROM d0)"""


def passed_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts.cooldown(alerts.model_alerts(scored_flows(spark, sf_dir))).select("row_id", "src_ip", "dst_ip", "dst_port", "predicted_class")


PASSED_ALERTS = f"""WITH RECURSIVE {FLOWS_SQL}, {SCORES_SQL}, {_DECIDED},
a AS (SELECT row_id, t_us, saddr, daddr, dport, best_label, row_number() OVER (PARTITION BY saddr, daddr, dport, best_label ORDER BY t_us, row_id) AS n FROM flows JOIN d USING (row_id) WHERE is_attack),
walk AS (SELECT row_id, saddr, daddr, dport, best_label, n, t_us AS last_us, true AS passed FROM a WHERE n = 1
  UNION ALL SELECT a.row_id, a.saddr, a.daddr, a.dport, a.best_label, a.n, CASE WHEN a.t_us - walk.last_us >= 10000000 THEN a.t_us ELSE walk.last_us END, a.t_us - walk.last_us >= 10000000
  FROM walk JOIN a ON a.saddr = walk.saddr AND a.daddr = walk.daddr AND a.dport = walk.dport AND a.best_label = walk.best_label AND a.n = walk.n + 1)
SELECT row_id, saddr AS src_ip, daddr AS dst_ip, dport AS dst_port, best_label AS predicted_class FROM walk WHERE passed"""


def alert_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidences are cut to fewer digits first, so that both engines round the same number."""
    found = alerts.model_alerts(scored_flows(spark, sf_dir)).withColumn("confidence", F.floor(F.col("confidence") * 100 + 1e-6) / 100)
    return alerts.log_rows(found)


ALERT_LOG = f"""WITH {FLOWS_SQL}, {SCORES_SQL}, {_DECIDED} SELECT saddr AS src_ip, daddr AS dest_ip, dport AS dest_port, printf('%.3f', floor(top * 100 + 1e-6) / 100) AS confidence, best_label AS predicted_attack
  FROM flows JOIN d USING (row_id) WHERE is_attack"""


def result_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model alerts and, with the settings of v2, signature alerts."""
    signatures = alerts.signature_alerts(signature_lines(spark, sf_dir).filter("row_id % 5 = 0"), "row_id", v2=True)
    found = alerts.model_alerts(scored_flows(spark, sf_dir)).withColumns({"timestamp": F.col("t_us"), "total_bytes": F.col("sbytes") + F.col("dbytes"), "total_packets": F.col("spkts") + F.col("dpkts"), "duration": F.col("age_s"), "confidence": F.round("confidence", 6)})
    return alerts.result_rows(alerts.all_alerts(signatures, found))


RESULT_LOG = f"""WITH {FLOWS_SQL}, {SCORES_SQL}, {_DECIDED} SELECT t_us AS timestamp, saddr AS src_ip, daddr AS dst_ip, dport AS dst_port, proto, best_label AS predicted_class, round(top, 6) AS confidence, 'ml' AS detection_method,
  CAST(NULL AS VARCHAR) AS suricata_signature, CASE WHEN CASE best_label WHEN 'PortScan' THEN "PortScan_dt" ELSE "DoS_dt" END >= 0.5 THEN best_label ELSE 'Benign' END AS dt_vote,
  CASE WHEN CASE best_label WHEN 'PortScan' THEN "PortScan_rf" ELSE "DoS_rf" END >= 0.5 THEN best_label ELSE 'Benign' END AS rf_vote, CASE WHEN CASE best_label WHEN 'PortScan' THEN "PortScan_xgb" ELSE "DoS_xgb" END >= 0.5 THEN best_label ELSE 'Benign' END AS xgb_vote,
  age_s AS duration, sbytes + dbytes AS total_bytes, spkts + dpkts AS total_packets FROM flows JOIN d USING (row_id) WHERE is_attack
UNION ALL SELECT NULL, saddr, daddr, dport, proto, 'Suricata Alert', 1.0, 'suricata_signature', 'sig', NULL, NULL, NULL, 0, 0, 0 FROM flows WHERE row_id % 5 = 0"""


def alert_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alerts.model_alerts(scored_flows(spark, sf_dir)).withColumn("confidence", F.floor(F.col("confidence") * 100 + 1e-6) / 100)
    return alerts.numbered_text(found).select("row_id", "alert_no", "text")


ALERT_TEXTS = f"""WITH {FLOWS_SQL}, {SCORES_SQL}, {_DECIDED}, a AS (SELECT *, CAST(row_number() OVER (PARTITION BY saddr ORDER BY t_us, row_id) AS INTEGER) AS alert_no FROM flows JOIN d USING (row_id) WHERE is_attack)
SELECT row_id, alert_no, '[' || alert_no || '] ' || saddr || ' -> ' || daddr || ':' || dport || ' | Class: ' || best_label || '  Conf: ' || printf('%.3f', floor(top * 100 + 1e-6) / 100) AS text FROM a"""


def alert_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model and signature alerts with numbers over all of them, and both kinds of text."""
    signatures = alerts.signature_alerts(signature_lines(spark, sf_dir), "row_id", v2=True).withColumns({"t_us": F.unix_micros("ts"), "row_id": F.col("row_id") + 0.5})
    models = alerts.model_alerts(scored_flows(spark, sf_dir)).withColumns({"confidence": F.floor(F.col("confidence") * 100 + 1e-6) / 100, "row_id": F.col("row_id").cast("double")})
    return alerts.numbered_text(alerts.all_alerts(signatures, models), per_source=False).select("row_id", F.col("alert_no").cast("long").alias("alert_no"), "text")


ALERT_NUMBERS = f"""WITH {FLOWS_SQL}, {SCORES_SQL}, {_DECIDED},
a AS (SELECT CAST(row_id AS DOUBLE) AS row_id, t_us, saddr || ' -> ' || daddr || ':' || dport || ' | Class: ' || best_label || '  Conf: ' || printf('%.3f', floor(top * 100 + 1e-6) / 100) AS text FROM flows JOIN d USING (row_id) WHERE is_attack
  UNION ALL SELECT row_id + 0.5, NULL, 'Suricata Alert | ' || saddr || ' -> ' || daddr || ':' || dport || ' | severity=' || (row_id % 4) || ' | category=' || CASE row_id % 3 WHEN 0 THEN 'Not Suspicious Traffic' WHEN 1 THEN 'Web Attack' ELSE '' END || ' | signature=sig' FROM flows),
n AS (SELECT *, row_number() OVER (ORDER BY t_us NULLS FIRST, row_id) AS alert_no FROM a)
SELECT CAST(row_id AS DOUBLE) AS row_id, alert_no, '[' || alert_no || '] ' || text AS text FROM n"""


def finalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = as_sessions(spark, sf_dir).withColumns({"uid": F.col("flow_id"), "starttime": F.timestamp_micros("t_us"), "appproto": F.when(F.col("dport") == 80, "http"), "duration": F.col("age_s")})
    scored = scoring.detector_result(scored_flows(spark, sf_dir)).filter("row_id % 10 != 0")  # the others stand for failed extraction
    closer = s.withColumn("t_us", F.expr(f"t_us div {CLOSER}"))
    out = alerts.finalized(s, scored, alerts.zero_byte_bursts(closer))
    told = out.withColumns({"n_notes": F.size("notes"), "start_us": F.unix_micros("timestamp"), "zero_count": F.col("zero_byte_info.count"), "zero_destination": F.col("zero_byte_info.destination"), "zero_rate": F.col("zero_byte_info.rate"), "portscan": F.col("proba_per_class")["PortScan"], "benign": F.col("proba_per_class")["Benign"], "xgb_vote": F.col("model_votes")["xgb"], "ml_class": F.col("ml_result.predicted_class")})
    return rounded(told, "row_id", "flow_id", "start_us", "app_proto", "zero_count", "zero_destination", "src_ip", "dst_port", "total_bytes", "total_packets", "is_attack", "predicted_class", "zero_byte", "n_notes", "proto", "xgb_vote", "ml_class", confidence="confidence", duration="duration", zero_rate="zero_rate", portscan="portscan", benign="benign")


_XGB = """CASE best_label WHEN 'PortScan' THEN "PortScan_xgb" ELSE "DoS_xgb" END"""
FINALIZED = f"""WITH {FLOWS_SQL}, {SCORES_SQL}, {_DECIDED}, {_ZERO}, hit AS (SELECT row_id, zero_count, zero_count / since AS zero_rate, dest_key FROM z WHERE zero_count >= 3 AND zero_count / since > 1.0)
SELECT f.row_id, f.proto, CASE WHEN f.row_id % 10 <> 0 THEN CASE WHEN {_XGB} >= 0.5 THEN best_label ELSE 'Benign' END END AS xgb_vote, CASE WHEN f.row_id % 10 <> 0 THEN CASE WHEN is_attack THEN best_label ELSE 'Benign' END END AS ml_class,
  CASE WHEN f.row_id % 10 <> 0 THEN round(p, 6) END AS portscan, CASE WHEN f.row_id % 10 <> 0 THEN round(1.0 - top, 6) END AS benign, f.flow_id, f.t_us AS start_us, CASE WHEN f.dport = 80 THEN 'http' END AS app_proto, CAST(f.age_s AS DOUBLE) AS duration, CASE WHEN f.row_id % 10 <> 0 THEN hit.zero_count END AS zero_count,
  CASE WHEN f.row_id % 10 <> 0 THEN hit.dest_key END AS zero_destination, round(CASE WHEN f.row_id % 10 <> 0 THEN hit.zero_rate END, 6) AS zero_rate, f.saddr AS src_ip, f.dport AS dst_port, sbytes + dbytes AS total_bytes, spkts + dpkts AS total_packets, f.row_id % 10 <> 0 AND is_attack AS is_attack,
  CASE WHEN f.row_id % 10 = 0 THEN 'Unknown' WHEN is_attack THEN best_label ELSE 'Benign' END AS predicted_class, hit.row_id IS NOT NULL AND f.row_id % 10 <> 0 AS zero_byte,
  CASE WHEN f.row_id % 10 = 0 OR hit.row_id IS NOT NULL THEN 1 ELSE 0 END AS n_notes, round(CASE WHEN f.row_id % 10 = 0 THEN 0.0 WHEN is_attack THEN top ELSE 1.0 - top END, 6) AS confidence
FROM flows f JOIN d USING (row_id) LEFT JOIN hit ON hit.row_id = f.row_id"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = flows(spark, sf_dir)
    detail = F.struct(F.lit("bytes").alias("feature"), F.lit(5.0).alias("value"), F.lit(1.25).alias("z_score"))
    rows = f.withColumns({"details": F.array_repeat(detail, (F.col("row_id") % 5).cast("int")), "combined_score": (F.col("row_id") % 4) / 4, "src_port": F.lit(None).cast("int"), "ts": F.when(F.col("row_id") % 7 != 0, F.timestamp_micros("t_us")), "app_proto": F.when(F.col("row_id") % 2 == 0, "http")})
    return alerts.message(rows.withColumnsRenamed({"saddr": "src_ip", "daddr": "dst_ip", "dport": "dst_port"})).select("row_id", "message")


_WHEN = "CASE WHEN row_id % 7 <> 0 THEN strftime(TIMESTAMP '1970-01-01' + to_microseconds(t_us), '%Y-%m-%d %H:%M:%S') ELSE 'Unknown' END"
MESSAGES = f"""WITH {FLOWS_SQL} SELECT row_id, chr(9888) || chr(65039) || ' ANOMALY DETECTED ' || chr(9888) || chr(65039) || chr(10) || chr(10) || 'Time: ' || {_WHEN} || chr(10) || repeat('-', 40) || chr(10) || 'CONNECTION DETAILS:' || chr(10) || 'Source IP: ' || saddr || chr(10) || 'Source Port: Unknown' || chr(10) || 'Destination IP: ' || daddr || chr(10) || 'Destination Port: ' || dport
  || chr(10) || 'Protocol: ' || proto || CASE WHEN row_id % 2 = 0 THEN chr(10) || 'App Protocol: http' ELSE '' END || chr(10) || chr(10) || 'Anomaly Score: ' || printf('%.4f', (row_id % 4) / 4.0)
  || CASE WHEN row_id % 5 > 0 THEN chr(10) || chr(10) || 'Statistical Anomalies:' || repeat(chr(10) || '- bytes: 5.0 (z-score: 1.25)', least(row_id % 5, 3)::INT) ELSE '' END || chr(10) || chr(10) || 'Alert generated at ' || {_WHEN} AS message FROM flows"""

QUERIES = {
    "busy_sessions": (busy_sessions, BUSY_SESSIONS), "sessions": (session_rows, SESSION_ROWS), "session_app_features": (session_features, SESSION_FEATURES), "session_app_info": (session_info, SESSION_INFO), "session_fallback_features": (session_fallback, SESSION_FALLBACK),
    "session_statistics": (session_statistics, SESSION_STATISTICS), "newest_sessions": (newest_sessions, NEWEST_SESSIONS), "session_lookup": (session_lookup, SESSION_LOOKUP), "zero_byte_bursts": (zero_bytes, ZERO_BYTES),
    "alert_cooldown": (passed_alerts, PASSED_ALERTS), "alert_log": (alert_log, ALERT_LOG), "result_log": (result_log, RESULT_LOG), "alert_texts": (alert_texts, ALERT_TEXTS), "alert_numbers": (alert_numbers, ALERT_NUMBERS), "finalized_sessions": (finalized, FINALIZED), "alert_messages": (messages, MESSAGES),
}
