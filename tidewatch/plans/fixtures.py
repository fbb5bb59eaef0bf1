"""Detection inputs derived from the provided tables, and the same as SQL.

Integer arithmetic only, so that both engines agree to the last digit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH = "2024-01-01 00:00:00"

FLOWS_SQL = """flows_fx AS (
  SELECT event_id AS row_id, CAST(event_id AS VARCHAR) AS flow_id,
    CAST(date_diff('microsecond', TIMESTAMP '2024-01-01 00:00:00', ts) // 400 AS BIGINT) AS t_us,
    '192.168.0.' || (user_id % 8) AS saddr,
    CASE WHEN user_id % 8 = 1 THEN '10.1.' || ((event_id // 250) % 250) || '.' || (event_id % 250) ELSE '10.0.0.' || (user_id % 3) END AS daddr,
    CAST(CASE WHEN user_id % 8 = 0 THEN 1 + event_id % 1000 WHEN user_id % 8 = 1 THEN 443
      ELSE CASE event_id % 4 WHEN 0 THEN 22 WHEN 1 THEN 53 WHEN 2 THEN 80 ELSE 443 END END AS INTEGER) AS dport,
    CAST(floor(value) AS BIGINT) AS spkts,
    CASE WHEN event_type = 'error' THEN 0 ELSE CAST(floor(value / 2) AS BIGINT) END AS dpkts,
    CASE event_type WHEN 'signup' THEN 'established' WHEN 'click' THEN 'closed' WHEN 'view' THEN 'new' WHEN 'purchase' THEN 'rst' ELSE 'rejected' END AS state,
    CAST(floor(value / 10) AS BIGINT) AS age_s, event_type
  FROM events),
flows AS (
  SELECT *, CASE WHEN dport = 53 THEN 'UDP' ELSE 'TCP' END AS proto,
    CASE WHEN event_type = 'error' AND row_id % 5 = 0 THEN 0 ELSE spkts * 60 END AS sbytes,
    CASE WHEN event_type = 'error' AND row_id % 5 = 0 THEN 0 ELSE dpkts * 400 END AS dbytes
  FROM flows_fx)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")



def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flow records from events: eight sources, one scanning ports, one scanning hosts."""
    i, u, kind = F.col("event_id"), F.col("user_id"), F.col("event_type")
    digit = lambda c: c.cast("string")
    port = F.when(u % 8 == 0, 1 + i % 1000).when(u % 8 == 1, 443).otherwise(F.when(i % 4 == 0, 22).when(i % 4 == 1, 53).when(i % 4 == 2, 80).otherwise(443))
    quiet = (kind == "error") & (i % 5 == 0)
    states = {"signup": "established", "click": "closed", "view": "new", "purchase": "rst"}
    state = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in states.items() for x in kv]), kind), F.lit("rejected"))
    return (
        table(spark, sf_dir, "events")
        .select(
            i.alias("row_id"), digit(i).alias("flow_id"), F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'{EPOCH}', cast(ts as timestamp_ntz)) div 400").alias("t_us"),
            F.concat(F.lit("192.168.0."), digit(u % 8)).alias("saddr"),
            F.when(u % 8 == 1, F.concat(F.lit("10.1."), digit(F.expr("event_id div 250 % 250")), F.lit("."), digit(i % 250))).otherwise(F.concat(F.lit("10.0.0."), digit(u % 3))).alias("daddr"),
            port.cast("int").alias("dport"), F.floor("value").cast("long").alias("spkts"), F.when(kind == "error", 0).otherwise(F.floor(F.col("value") / 2)).cast("long").alias("dpkts"),
            state.alias("state"), F.floor(F.col("value") / 10).cast("long").alias("age_s"), kind, quiet.alias("quiet"),
        )
        .withColumns({
            "proto": F.when(F.col("dport") == 53, "UDP").otherwise("TCP"), "sbytes": F.when(F.col("quiet"), 0).otherwise(F.col("spkts") * 60).cast("long"),
            "dbytes": F.when(F.col("quiet"), 0).otherwise(F.col("dpkts") * 400).cast("long"),
        })
        .drop("quiet")
    )


def flow_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flows as event log lines (``value``), with row_id and t_us beside them."""
    f = flows(spark, sf_dir)
    text = lambda c: F.col(c).cast("string")
    when = F.date_format(F.timestamp_micros("t_us"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXX")
    line = F.to_json(F.struct(
        F.lit("flow").alias("event_type"), when.alias("timestamp"), F.col("row_id").alias("flow_id"), F.col("saddr").alias("src_ip"), F.lit(40000).alias("src_port"),
        F.col("daddr").alias("dest_ip"), F.col("dport").alias("dest_port"), "proto",
        F.struct(F.col("age_s").alias("age"), "state", F.col("spkts").alias("pkts_toserver"), F.col("dpkts").cast("double").alias("pkts_toclient"), text("sbytes").alias("bytes_toserver"), F.col("dbytes").alias("bytes_toclient")).alias("flow"),
        F.struct((F.col("row_id") % 2 == 0).alias("syn"), F.lit("1b").alias("tcp_flags")).alias("tcp"),
    ))
    return f.select("row_id", "t_us", line.alias("value"))


EVENTS_SQL = FLOWS_SQL + """,
eve AS (
  SELECT *, CAST(row_id // 4 AS VARCHAR) AS uid,
    CASE WHEN row_id % 16 = 15 THEN 'fileinfo' WHEN row_id % 4 = 0 THEN 'http' WHEN row_id % 4 = 1 THEN 'dns' WHEN row_id % 8 = 2 THEN 'tls' WHEN row_id % 8 = 6 THEN 'ssh' ELSE 'flow' END AS kind,
    CAST(CASE row_id % 5 WHEN 0 THEN 200 WHEN 1 THEN 401 WHEN 2 THEN 404 WHEN 3 THEN 500 ELSE 403 END AS VARCHAR) AS status,
    CASE WHEN row_id % 3 = 0 THEN 'POST' ELSE 'GET' END AS method
  FROM flows)"""


def event_lines(spark: SparkSession, sf_dir: str, each: int = 4) -> DataFrame:
    """Mixed events, ``each`` to a flow id: http, dns, tls or ssh, then flow (or a file), and again."""
    i = F.col("row_id")
    f = flows(spark, sf_dir).withColumn(
        "kind", F.when(i % 16 == 15, "fileinfo").when(i % 4 == 0, "http").when(i % 4 == 1, "dns").when(i % 8 == 2, "tls").when(i % 8 == 6, "ssh").otherwise("flow")
    )
    only = lambda kind, *c: F.when(F.col("kind") == kind, F.struct(*c))
    status = F.element_at(F.array(*map(F.lit, (200, 401, 404, 500, 403))), (i % 5 + 1).cast("int"))
    when = F.date_format(F.timestamp_micros("t_us"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXX")
    answers = F.struct(F.when(i % 3 == 0, F.array(F.lit("c.example"))).alias("CNAME"), F.when(i % 2 == 1, F.array(F.col("daddr"))).alias("A"))
    line = F.to_json(F.struct(
        F.col("kind").alias("event_type"), when.alias("timestamp"), F.expr(f"row_id div {each}").alias("flow_id"), F.col("saddr").alias("src_ip"), F.lit(40000).alias("src_port"),
        F.col("daddr").alias("dest_ip"), F.col("dport").alias("dest_port"), "proto",
        only("flow", F.col("age_s").alias("age"), F.col("state").alias("state"), F.col("spkts").alias("pkts_toserver"), F.col("dpkts").alias("pkts_toclient"), F.col("sbytes").alias("bytes_toserver"), F.col("dbytes").alias("bytes_toclient")).alias("flow"),
        only("http", F.when(i % 3 == 0, "POST").otherwise("GET").alias("http_method"), F.lit("h.example").alias("hostname"), F.concat(F.lit("/p"), (i % 7).cast("string")).alias("url"), status.alias("status"), F.col("sbytes").alias("length")).alias("http"),
        only("dns", F.concat(F.lit("q"), (i % 5).cast("string"), F.lit(".example")).alias("rrname"), F.lit("A").alias("rrtype"), F.when(i % 8 == 1, answers).alias("grouped")).alias("dns"),
        only("tls", F.lit("TLS 1.2").alias("version"), F.concat(F.lit("s"), (i % 4).cast("string")).alias("sni")).alias("tls"),
        only("ssh", F.struct(F.concat(F.lit("c"), (i % 3).cast("string")).alias("software_version"), F.lit("2.0").alias("proto_version")).alias("client"), F.struct(F.lit("OpenSSH").alias("software_version")).alias("server")).alias("ssh"),
        only("fileinfo", F.col("dbytes").alias("size")).alias("fileinfo"),
    ))
    return f.select("row_id", "t_us", line.alias("value"))


LABELS = ["BENIGN", "DoS Hulk", " PortScan ", "Port Scan", "DDoS", "Bot", "DoS slowloris"]
LABELLED_SQL = """labelled AS (
  SELECT l_partkey % 65536 AS dest_port, CAST(floor(l_extendedprice * l_linenumber) AS BIGINT) AS duration,
    CAST(floor(l_quantity) AS BIGINT) AS total_fwd_packets, CAST(floor(l_quantity) AS BIGINT) % 7 AS total_bwd_packets,
    CAST(floor(l_quantity) AS BIGINT) * 60 AS total_fwd_bytes, (CAST(floor(l_quantity) AS BIGINT) % 7) * 400 AS total_bwd_bytes,
    CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(l_suppkey % 997 AS DOUBLE) END AS flow_iat_mean,
    CASE (l_orderkey + l_linenumber) % 8 WHEN 0 THEN 'DoS Hulk' WHEN 1 THEN ' PortScan ' WHEN 2 THEN 'Port Scan' WHEN 3 THEN 'DDoS' WHEN 4 THEN 'Bot' ELSE 'BENIGN' END AS raw_label
  FROM lineitem),
classed AS (
  SELECT *, CASE trim(raw_label) WHEN 'BENIGN' THEN 'Benign' WHEN 'DoS Hulk' THEN 'DoS' WHEN 'PortScan' THEN 'PortScan' WHEN 'Port Scan' THEN 'PortScan' END AS "Label"
  FROM labelled)"""


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A labelled flow table from lineitem, internal column names, raw labels."""
    q = F.floor("l_quantity").cast("long")
    kind = (F.col("l_orderkey") + F.col("l_linenumber")) % 8
    label = F.when(kind == 0, "DoS Hulk").when(kind == 1, " PortScan ").when(kind == 2, "Port Scan").when(kind == 3, "DDoS").when(kind == 4, "Bot").otherwise("BENIGN")
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_partkey") % 65536).alias("dest_port"), F.floor(F.col("l_extendedprice") * F.col("l_linenumber")).cast("long").alias("duration"),
        q.alias("total_fwd_packets"), (q % 7).alias("total_bwd_packets"), (q * 60).alias("total_fwd_bytes"), (q % 7 * 400).alias("total_bwd_bytes"),
        F.when(F.col("l_linenumber") != 7, (F.col("l_suppkey") % 997).cast("double")).alias("flow_iat_mean"), label.alias("Label"),
    )


PRIMES = {"PortScan_dt": 7, "PortScan_rf": 11, "PortScan_xgb": 13, "DoS_dt": 17, "DoS_rf": 19, "DoS_xgb": 23}
SCORES_SQL = "scores AS (SELECT event_id AS row_id, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS target, " + ", ".join(
    f'(event_id * {p} % 1000) / 1000.0::DOUBLE AS "{c}"' for c, p in PRIMES.items()
) + " FROM events)"


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model probabilities of both tasks by arithmetic, to check decisions without training."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("row_id"), F.when(F.col("event_type") == "error", 1).otherwise(0).alias("target"), *[((F.col("event_id") * p % 1000) / F.lit(1000.0)).alias(c) for c, p in PRIMES.items()]
    )
