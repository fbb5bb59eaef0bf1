import random

from pyspark.sql import functions as F
from test_stream_windows import SCHEMA as SESSIONS
from test_stream_windows import session

from tidewatch.operators import alerts, behavior, clean, scoring, whitelist

SCHEMA = "row_id long, saddr string, t_us long, daddr string, dport int, total_fwd_bytes long, total_fwd_packets long, auth_failures int, service string"


def naive(rows, us=300_000_000):
    out = {}
    for r in rows:
        seen = [x for x in rows if x[1] == r[1] and r[2] - us < x[2] <= r[2]]
        by = {}
        for x in seen:
            by[x[8]] = by.get(x[8], 0) + x[7]
        most = min(20, max(by.values()))
        out[r[0]] = (len({x[4] for x in seen if x[4]}), len({x[3] for x in seen if x[3]}), sum(x[5] for x in seen), sum(x[6] for x in seen), most if most > 3 else 0)
    return out


def test_window_figures_equal_rescans(spark):
    rng = random.Random(5)
    rows = [
        (i, f"s{rng.randrange(3)}", rng.choice([rng.randrange(2_000_000_000), 300_000_000 * rng.randrange(5), 7]), rng.choice(["a", "b", "c", "", None]), rng.choice([0, 1, 2, 3]), rng.randrange(100), rng.randrange(9), rng.choice([0, 0, 1, 3, 9]), rng.choice("xy"))
        for i in range(250)
    ]
    got = behavior.window_figures(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["row_id"]: (r["ports"], r["ips"], r["window_bytes"], r["window_packets"], r["failures"]) for r in got} == naive(rows)


def test_window_is_half_open_and_thresholds_strict(spark):
    at = lambda i, t, port, ip="d": (i, "s", t, ip, port, 0, 0, 0, "")
    rows = [at(i, 0, i + 1) for i in range(10)] + [at(10, 299_999_999, 50), at(11, 300_000_000, 51)]
    got = {r["row_id"]: r for r in behavior.scores(behavior.window_figures(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert got[9]["port_scan_score"] == 0.0  # ratio 10 is not above 10
    assert got[10]["ports"] == 11 and abs(got[10]["port_scan_score"] - 11 / 50) < 1e-12
    assert got[11]["ports"] == 2 and got[11]["port_scan_score"] == 0.0


def test_empty_window_keeps_the_last_score(spark):
    rows = [(i, "s", 0, "d", i + 1, 0, 0, 0, "") for i in range(12)] + [(12, "s", 400_000_000, "", 0, 0, 0, 0, "")]
    got = {r["row_id"]: r for r in behavior.scores(behavior.window_figures(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert got[12]["ips"] == 0 and got[12]["port_scan_score"] == 12 / 50


def test_cooldown_counts_from_the_last_alert_kept(spark):
    times = [0, 4, 9, 10, 15, 19, 20, 31]
    df = spark.createDataFrame([(i, t * 1_000_000, "a", "b", 1, "DoS", "x") for i, t in enumerate(times)], "row_id long, t_us long, src_ip string, dst_ip string, dst_port int, predicted_class string, last string")
    assert [r["t_us"] // 1_000_000 for r in alerts.cooldown(df).orderBy("t_us").collect()] == [0, 10, 20, 31]


def test_cooldown_with_null_and_repeated_ids(spark):
    rows = [(i, t * 1_000_000 if t is not None else None, src) for i, t, src in [(1, 0, "a"), (1, 5, "a"), (None, 10, "a"), (None, 12, "a"), (7, None, "a"), (8, 20, "a"), (9, 20, "a"), (1, 5, None), (2, 6, None)]]
    out = alerts.cooldown(spark.createDataFrame(rows, "row_id long, t_us long, src_ip string").repartition(3), 10, ["src_ip"]).collect()
    found = sorted((r["src_ip"] or "", -1 if r["t_us"] is None else r["t_us"] // 1_000_000, r["row_id"] or 0) for r in out)
    assert found == [("", 5, 1), ("a", -1, 7), ("a", 0, 1), ("a", 10, 0), ("a", 20, 8)]


def test_zero_byte_burst_needs_three_above_the_rate(spark):
    rows = [(0, "s", 0, 0), (1, "s", 1_000_000, 0), (2, "s", 2_000_000, 0), (3, "s", 2_500_000, 0), (4, "s", 2_600_000, 9)]
    df = spark.createDataFrame(rows, "row_id long, saddr string, t_us long, total_fwd_bytes long").withColumns({"total_bwd_bytes": F.lit(0), "daddr": F.lit("d"), "dport": F.lit(1), "proto": F.lit("TCP")})
    assert [(r["row_id"], r["zero_count"], r["zero_detected"]) for r in alerts.zero_byte_bursts(df).orderBy("row_id").collect()] == [(0, 1, False), (1, 2, False), (2, 3, True), (3, 4, True)]


def test_samples_are_exact_and_stable(spark):
    df = spark.range(5000).selectExpr("id", "case when id % 10 = 0 then 'DoS' else 'Benign' end as Label")
    one, two = (sorted(r["id"] for r in clean.balance(df.repartition(k), "DoS", 2.0).collect()) for k in (1, 3))
    assert one == two and len(one) == 1500
    train, test = clean.stratified_split(df)
    assert test.groupBy("Label").count().orderBy("Label").collect() == [("Benign", 900), ("DoS", 100)] and train.count() == 4000


def test_tie_goes_to_the_first_task_and_its_threshold(spark):
    columns = [f"{t}_{m}" for t in ("PortScan", "DoS") for m in ("dt", "rf", "xgb")]
    df = spark.createDataFrame([(0.5,) * 6, (0.2, 0.2, 0.2, 0.54, 0.54, 0.54), (0.1, None, 0.1, 0.9, 0.9, 0.9)], ", ".join(f"{c} double" for c in columns))
    r = scoring.decide(df).collect()
    assert [(x["predicted_class"], x["is_attack"]) for x in r] == [("PortScan", True), ("Benign", False), ("Unknown", False)]
    assert r[2]["confidence"] is None and abs(r[1]["confidence"] - 0.46) < 1e-9


def test_whitelist_rules(spark):
    rules = whitelist.whitelist(spark, whitelist.default_rules(["5.5.5.5"]))
    rows = [("8.8.8.8", 53, "UDP", True), ("8.8.8.8", 80, "TCP", False), ("104.31.255.255", 443, "TCP", True), ("104.32.0.0", 443, "TCP", False), ("5.5.5.5", 123, "UDP", True), ("5.5.5.5", 123, "ICMP", False), ("ff02::1", 1, "UDP", True), ("10.0.0.2", 9, "TCP", True), ("fe80::1", 1, "UDP", True), (None, 1, "UDP", False), ("224.0.0.9", 5, None, True)]
    df = spark.createDataFrame(rows, "daddr string, dport int, proto string, want boolean")
    assert all(r["whitelisted"] == r["want"] for r in whitelist.mark_whitelisted(df, rules).collect())
    assert whitelist.drop_whitelisted(df, rules).count() == sum(not r[3] for r in rows)
    assert whitelist.extended(rules, rules).count() == rules.count()


def test_blocks_shorten_where_rows_are_dense(spark, monkeypatch):
    """A block holds few rows however dense they lie, and the figures stay those of rescans."""
    rng = random.Random(9)
    rows = [(i, f"s{rng.randrange(2)}", rng.randrange(700_000_000), rng.choice("abc"), rng.choice([0, 1, 2, 3]), rng.randrange(100), rng.randrange(9), rng.choice([0, 1, 9]), "x") for i in range(200)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert behavior.Blocks.of(df) == behavior.Blocks(behavior.BLOCK_US, None)
    monkeypatch.setattr(behavior, "BLOCK_ROWS", 20)
    blocks = behavior.Blocks.of(df)
    most = df.groupBy("saddr", F.floor(F.col("t_us") / blocks.us)).count().agg(F.max("count")).first()[0]
    assert most <= 20 and blocks.us < behavior.BLOCK_US and blocks.tasks == 10
    got = behavior.scores(behavior.window_figures(df)).collect()
    assert {r["row_id"]: (r["ports"], r["ips"], r["window_bytes"], r["window_packets"], r["failures"]) for r in got} == naive(rows)


def recounted(rows, us=300_000_000):
    """Lifetime counters and window figures of sessions, source by source in plain Python."""
    names = [c.split()[0] for c in SESSIONS.split(", ")]
    rows, out = [dict(zip(names, r, strict=True)) for r in rows], {}
    for source in {r["saddr"] for r in rows}:
        own, last, epoch, life = sorted((r for r in rows if r["saddr"] == source), key=lambda r: (r["t_us"], r["row_id"])), None, 0, []
        for r in own:
            if last is not None and r["t_us"] - last > us:
                epoch, life = epoch + 1, []
            last = r["t_us"]
            life.append(r)
            seen, by = [x for x in own if r["t_us"] - us < x["t_us"] <= r["t_us"]], {}
            for x in seen:
                service = x["appproto"] or f"{x['proto']}-{x['dport']}"
                by[service] = by.get(service, 0) + sum(c in ("401", "403") for c in x["http_status_codes"] if x["http_event_count"]) + (x["ssh_event_count"] > 0 and x["state"] == "rejected")
            most = min(20, max(by.values()))
            ips, ports = (lambda found: len({x["daddr"] for x in found if x["daddr"]})), (lambda found: len({x["dport"] for x in found if x["dport"] > 0}))
            out[r["row_id"]] = {
                "epoch": epoch, "first_seen_us": life[0]["t_us"], "total_flows": len(life), "completed_flows": sum(x["is_complete"] for x in life), "bytes_received": sum(x["total_bwd_bytes"] for x in life),
                "unique_dst_ips": ips(life), "unique_dst_ports": ports(life), "tcp_flows": sum(x["proto"] == "TCP" for x in life), "ips": ips(seen), "ports": ports(seen),
                "window_bytes": sum(x["total_fwd_bytes"] for x in seen), "window_packets": sum(x["total_fwd_packets"] for x in seen), "failures": most if most > 3 else 0,
            }
    return out


def test_sessions_are_written_once_for_all_figures(spark, monkeypatch):
    """Counters and window figures come from one sweep, in short blocks and over silences."""
    rng = random.Random(12)
    times = [1_000_000 * rng.choice([rng.randrange(900), 300, 301, 600, 1200 + rng.randrange(9), 3000 + rng.randrange(900)]) + rng.choice([0, 0, 1]) for _ in range(260)]
    rows = [session(rng, i, t, rng.choice("aaab")) for i, t in enumerate(times)]
    written = []
    keep = behavior.cut
    monkeypatch.setattr(behavior, "cut", lambda df: written.append(df.columns) or keep(df))
    monkeypatch.setattr(behavior, "BLOCK_ROWS", 20)
    got = behavior.analyze(spark.createDataFrame(rows, SESSIONS)).collect()
    want = recounted(rows)
    assert {r["row_id"]: {n: r[n] for n in want[r["row_id"]]} for r in got} == want
    assert max(w["epoch"] for w in want.values()) > 0 and max(w["failures"] for w in want.values()) > 3
    assert sum("total_bwd_bytes" in columns for columns in written) == 1
