"""Whole sessions and exact behaviour windows: stream = batch, rows out of order."""

import json
import random

from pyspark.sql import functions as F
from test_streaming import run

from tidewatch.operators import behavior, parse
from tidewatch.operators import sessions as batch
from tidewatch.streaming import windows

S = 1_000_000
KINDS = ["flow", "http", "dns", "tls", "ssh", "fileinfo"]


def event(rng, i, t):
    kind = rng.choice(KINDS)
    some = lambda *v: rng.choice(v)
    body = {
        "flow": {"age": some(0, 3, 7), "state": some("new", "closed", "established", "rejected", None), "pkts_toserver": rng.randrange(9), "pkts_toclient": rng.randrange(9), "bytes_toserver": rng.randrange(900), "bytes_toclient": rng.randrange(900), "start": f"2024-01-01T00:{rng.randrange(60):02}:00.000003+0000", "end": some(None, f"2024-01-01T01:{rng.randrange(60):02}:09+0000")},
        "http": {"http_method": some("GET", "POST", ""), "hostname": some("a", "b", None), "url": some("/x", "/y"), "http_user_agent": some("u", "v"), "status": some(200, "404", 401)},
        "dns": {"rrname": some("q1", "q2"), "rrtype": some("A", "TXT"), "grouped": some(None, {"A": [some("1.1.1.1", "2.2.2.2")], "CNAME": ["c", some("d", "e")]})},
        "tls": {"version": some("1.2", "1.3"), "sni": some("s", "t"), "subject": some("CN=a", None), "issuerdn": some("CN=i", "CN=j")},
        "ssh": {"client": {"software_version": some("c1", "c2"), "proto_version": "2"}, "server": {"software_version": some("o", "p")}},
        "fileinfo": {"size": 5},
    }[kind]
    line = {"event_type": kind, "timestamp": f"2024-01-01T00:{t // 60:02}:{t % 60:02}.000007+0000", "flow_id": rng.randrange(3), "src_ip": some("a", "b"), "src_port": 1, "dest_ip": "d", "dest_port": some(22, 80), "proto": "TCP", kind: body}
    if kind == "flow" and rng.random() < 0.5:
        line["app_proto"] = some("http", "failed", "")
    return (i, json.dumps(line))


def test_session_stream_equals_batch_in_all_columns(spark, tmp_path):
    rng = random.Random(12)
    rows = [event(rng, i, rng.choice([rng.randrange(1200), 300, 301])) for i in range(260)]
    end = [(10_000 + i, json.dumps({"event_type": "flow", "timestamp": f"2024-01-01T0{3 + i}:00:00+0000", "flow_id": 99, "flow": {"state": "new"}})) for i in range(2)]
    got = run(spark, tmp_path, [rows[:130], rows[130:], end[:1], end[1:]], "row_id long, value string", lambda s: windows.sessions(parse.decode(s), "row_id", 60, "2000 seconds"))
    want = batch.build(parse.decode(spark.createDataFrame(rows, "row_id long, value string")), "row_id", 60).drop("epoch")
    names = sorted(want.columns)
    told = lambda found: sorted(repr([(c, r[c]) for c in names]) for r in found if r["uid"] != "99")
    assert told(got) == told(want.collect()) and len(told(got)) > 20
    assert sorted(got[0].asDict()) == names
    assert max(len(r["http_methods"]) for r in got) > 1 and max(r["flow_event_count"] for r in got) > 1


def test_totals_are_observed_while_sessions_pass(spark):
    from pyspark.sql import Observation

    rows = [event(random.Random(3), i, i) for i in range(40)]
    built = batch.build(parse.decode(spark.createDataFrame(rows, "row_id long, value string")), "row_id", 60)
    seen = Observation("s")
    built.observe(seen, *batch._totals()).count()
    batch.observed(built).count()
    assert seen.get == batch.statistics(built).first().asDict()


def test_zero_byte_pairs_are_forgotten_in_stream_and_batch(spark, tmp_path):
    from tidewatch.operators import alerts
    from tidewatch.streaming import stateful

    rng = random.Random(9)
    rows = [(i, t * S, rng.choice(["a", None]), "d", 1, "TCP", 0, 0) for i, t in enumerate(rng.sample(range(1, 400), 60))]
    schema = "row_id long, t_us long, saddr string, daddr string, dport int, proto string, total_fwd_bytes long, total_bwd_bytes long"
    end = [(1000 + i, (10_000 + i) * S, "z", "d", 1, "TCP", 0, 0) for i in range(2)]
    got = run(spark, tmp_path, [rows[:30], rows[30:], end[:1], end[1:]], schema, lambda s: stateful.zero_byte_bursts(s, "2000 seconds", 12))
    want = alerts.zero_byte_bursts(spark.createDataFrame(rows, schema), forget_s=12)
    key = lambda r: (r["row_id"], r["zero_count"], round(r["zero_rate"], 6), r["zero_detected"])
    assert sorted(key(r) for r in got if r["row_id"] < 1000) == sorted(map(key, want.collect()))
    counts = {r["row_id"]: r["zero_count"] for r in want.collect()}
    for source in ("a", None):  # by hand
        last, n = None, 0
        for i, t, *_ in sorted((r for r in rows if r[2] == source), key=lambda r: r[1]):
            n = 1 if last is None or t - last > 12 * S else n + 1
            last = t
            assert counts[i] == n


SCHEMA = "row_id long, t_us long, saddr string, daddr string, dport int, proto string, state string, appproto string, is_complete boolean, total_fwd_bytes long, total_bwd_bytes long, total_fwd_packets long, total_bwd_packets long, http_event_count int, http_status_codes array<string>, dns_event_count int, dns_answers array<string>, tls_event_count int, ssh_event_count int"


def session(rng, i, t, source):
    kind = rng.choice(["http", "dns", "tls", "ssh"])
    return (
        i, t, source, rng.choice(["x", "y", "z", "", None, f"h{rng.randrange(40)}"]), rng.choice([0, 22, 80, rng.randrange(1, 60)]), rng.choice(["TCP", "UDP"]), rng.choice(["closed", "rejected", "rst", "new"]), rng.choice(["", "http", None]), rng.choice([True, False]),
        rng.randrange(10**9), rng.randrange(99), rng.randrange(10**6), 3, int(kind == "http"), [rng.choice(["200", "401", "403", "500"])] * 3, int(kind == "dns"), rng.choice([[], ["1"]]), int(kind == "tls"), int(kind == "ssh"),
    )


def test_behaviour_stream_equals_batch(spark, tmp_path):
    rng = random.Random(6)
    times = [rng.choice([rng.randrange(900), 300, 301, 2000 + rng.randrange(200)]) * S + rng.choice([0, 0, 1]) for _ in range(240)]
    rows = [session(rng, i, t + S, rng.choice("aab")) for i, t in enumerate(times)] + [(900, 9 * S, "only", None, 0, "TCP", "new", "", None, 1, 1, 1, 1, 0, None, 0, [], 0, 0)]
    end = [session(rng, 10_000 + i, 100_000 * S + i * S, "zz") for i in range(2)]
    got = run(spark, tmp_path, [rows[:100], rows[100:], end[:1], end[1:]], SCHEMA, lambda s: windows.analyze(s, 300, "20000 seconds"))
    want = behavior.analyze(spark.createDataFrame(rows, SCHEMA), 300)
    names = sorted(c for c in want.columns if c != "epoch")
    assert sorted(got[0].asDict()) == names
    value = lambda x: round(x, 9) if isinstance(x, float) else x
    told = lambda found: {r["row_id"]: [(c, value(r[c])) for c in names] for r in found if r["saddr"] != "zz"}
    assert told(got) == told(want.collect())
    assert want.agg(F.max("epoch")).first()[0] > 0 and want.filter("failures > 0").count() > 0
