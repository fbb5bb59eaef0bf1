import json

from pyspark.sql import functions as F

from tidewatch.functions.columns import cidr_range, ipv4, timestamp
from tidewatch.operators import features, parse, sessions
from tidewatch.streaming import live


def lines(spark, *events):
    return spark.createDataFrame([(i, e if isinstance(e, str) else json.dumps(e)) for i, e in enumerate(events)], "n long, value string")


def test_bad_lines_are_rejected_and_counted(spark):
    df = lines(spark, "{", "null", "[1]", "", {"flow_id": 1}, {"event_type": "stats"}, {"event_type": "flow"}, {"event_type": "alert"})
    assert [r["reason"] for r in parse.rejected(df).collect()] == ["no event"] * 5 + ["unknown event type"]


def test_flow_numbers_times_and_flags(spark):
    flow = {
        "event_type": "flow", "timestamp": "2024-01-01T00:00:10.500000+0000", "flow_id": 12, "src_ip": "1.2.3.4", "src_port": "99", "dest_ip": "5.6.7.8", "dest_port": 80.0, "proto": "TCP",
        "flow": {"start": 1704067200, "pkts_toserver": "12", "pkts_toclient": 5.0, "bytes_toserver": 7, "age": None}, "tcp": {"syn": True, "rst": False},
    }
    r = parse.flows(parse.decode(lines(spark, flow, {"event_type": "flow", "timestamp": "2024-01-01T00:00:10+0700"})), "n").orderBy("n").collect()
    assert (r[0]["uid"], r[0]["sport"], r[0]["dport"], r[0]["spkts"], r[0]["dpkts"], r[0]["pkts"], r[0]["bytes"], r[0]["dur"]) == ("12", 99, 80, 12, 5, 17, 7, 0.0)
    assert (r[0]["tcp_syn"], r[0]["tcp_rst"], r[0]["state"], str(r[0]["starttime"]), str(r[0]["endtime"])) == (True, False, "", "2024-01-01 00:00:00", "2024-01-01 00:00:10.500000")
    assert str(r[1]["ts"]) == "2023-12-31 17:00:10" and r[1]["spkts"] == 0


def test_http_status_is_text_and_flow_ids_meet(spark):
    df = lines(
        spark,
        {"event_type": "http", "timestamp": "2024-01-01T00:00:01+0000", "flow_id": 7, "http": {"status": 404, "http_method": "GET"}},
        {"event_type": "http", "timestamp": "2024-01-01T00:00:02+0000", "flow_id": "7", "http": {"status": "401", "http_method": "GET"}},
        {"event_type": "dns", "timestamp": "2024-01-01T00:00:03+0000", "flow_id": 7, "dns": {"rrname": "q", "grouped": {"A": ["1.1.1.1"], "CNAME": ["c"]}}},
        {"event_type": "flow", "timestamp": "2024-01-01T00:00:04+0000", "flow_id": "7", "flow": {"state": "closed", "bytes_toserver": 10, "bytes_toclient": 5, "age": 2}},
        {"event_type": "http", "timestamp": "2024-01-01T00:00:05+0000", "flow_id": 7, "http": {"status": 200}},
        {"event_type": "http", "timestamp": "2024-01-01T00:01:05.000001+0000", "flow_id": 7, "http": {"status": 500}},
    )
    s = sessions.build(parse.decode(df), "n").orderBy("epoch").collect()
    assert [x["epoch"] for x in s] == [0, 1, 2]
    assert (s[0]["http_status_codes"], s[0]["http_methods"], s[0]["dns_answers"], s[0]["appproto"], s[0]["closed"]) == (["404", "401"], ["GET"], ["c", "1.1.1.1"], "http", True)
    assert (s[0]["flow_bytes_per_sec"], s[0]["down_up_ratio"], s[1]["closed"]) == (7.5, 0.5, False)
    assert features.app_layer(sessions.build(parse.decode(df), "n")).filter("epoch = 0").first()["has_http_auth_error"] == 1


def test_live_detection_as_a_batch(spark):
    flow = {"event_type": "flow", "flow_id": 1, "src_ip": "9.9.9.1", "dest_ip": "5.6.7.8", "dest_port": 80, "proto": "TCP", "flow": {"pkts_toserver": 500, "age": 1}}
    alert = {"event_type": "alert", "src_ip": "127.0.0.1", "dest_ip": "b", "dest_port": 1, "alert": {"category": "x", "signature": "s"}}
    quiet = alert | {"alert": {"category": "Not Suspicious Traffic"}}
    score = lambda df: df.withColumns({"is_attack": F.col("total_packets") > 100, "predicted_class": F.lit("DoS"), "confidence": F.lit(0.9)})
    found = live.detect(lines(spark, flow, flow | {"src_ip": "127.0.0.1"}, alert, quiet).select("value"), score, ["127.0.0.1"])
    assert sorted((r["src_ip"], r["predicted_class"]) for r in found.collect()) == [("127.0.0.1", "Suricata Alert"), ("9.9.9.1", "DoS")]


def test_addresses_and_times(spark):
    assert cidr_range("10.1.0.0/24") == (167837696, 167837951) and cidr_range("1.1.1.1")[0] == cidr_range("1.1.1.1")[1]
    r = spark.sql("select '10.1.0.255' a, 'fe80::1' b, '1704067200.5' c, '2024-01-01T00:00:00Z' d, 'x' e").select(ipv4(F.col("a")), ipv4(F.col("b")), timestamp(F.col("c")), timestamp(F.col("d")), timestamp(F.col("e"))).first()
    assert r[0] == 167837951 and r[1] is None and str(r[2]) == "2024-01-01 00:00:00.500000" and str(r[3]) == "2024-01-01 00:00:00" and r[4] is None
