"""Stream and batch give the same, also for rows that arrive out of order."""

import json
import random

from pyspark.sql import functions as F

from tidewatch.operators import alerts
from tidewatch.streaming import live, stateful


def run(spark, tmp_path, batches, schema, build):
    """Each batch is one file; a last row far ahead moves the watermark past all others.
    (The first watermark is 1970, so times start after that.)"""
    source = tmp_path / "in"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{source}/{k:03}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(source))
    out = build(stream)
    query = out.writeStream.format("memory").queryName("t").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(300)
    assert query.exception() is None
    return spark.table("t").collect()


def test_cooldown_stream_equals_batch(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, t * 1_000_000, rng.choice("ab")) for i, t in enumerate(rng.sample(range(1, 100), 40))]
    schema = "row_id long, t_us long, src_ip string"
    end = [(1000 + i, 10_000_000_000 + i, "z") for i in range(2)]
    got = run(spark, tmp_path, [rows[:20], rows[20:], end[:1], end[1:]], schema, lambda s: stateful.cooldown(s, ["src_ip"], 10, "200 seconds"))
    batch = alerts.cooldown(spark.createDataFrame(rows, schema), 10, ["src_ip"])
    assert sorted(r["row_id"] for r in got if r["row_id"] < 1000) == sorted(r["row_id"] for r in batch.collect())


def test_zero_byte_stream_equals_batch(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, t * 100_000, rng.choice("ab"), "d", 1, "TCP", rng.choice([0, 0, 5]), 0) for i, t in enumerate(rng.sample(range(1, 100), 40))]
    schema = "row_id long, t_us long, saddr string, daddr string, dport int, proto string, total_fwd_bytes long, total_bwd_bytes long"
    end = [(1000 + i, 10_000_000_000 + i, "z", "d", 1, "TCP", 0, 0) for i in range(2)]
    got = run(spark, tmp_path, [rows[:20], rows[20:], end[:1], end[1:]], schema, lambda s: stateful.zero_byte_bursts(s, "200 seconds"))
    batch = alerts.zero_byte_bursts(spark.createDataFrame(rows, schema)).collect()
    key = lambda r: (r["row_id"], r["zero_count"], round(r["zero_rate"], 6), r["zero_detected"])
    assert sorted(key(r) for r in got if r["row_id"] < 1000) == sorted(map(key, batch))


def test_session_stream_ends_by_state_and_timeout(spark, tmp_path):
    s = 1_000_000
    rows = [(0, 5 * s, "f", "http", "", 0, 0), (1, s, "f", "dns", "", 0, 0), (2, 9 * s, "f", "flow", "closed", 7, 1), (3, 11 * s, "f", "http", "", 0, 0), (4, 80 * s, "f", "http", "", 0, 0), (5, 3 * s, "g", "flow", "new", 2, 2)]
    schema = "row_id long, t_us long, uid string, kind string, state string, sbytes long, dbytes long"
    end = [(1000 + i, 10_000_000_000 + i * s, "z", "flow", "new", 0, 0) for i in range(2)]
    got = run(spark, tmp_path, [rows[:3], rows[3:], end[:1], end[1:]], schema, lambda x: stateful.sessions(x, 60, "200 seconds"))
    found = sorted((r["epoch_start_us"] // s, r["last_us"] // s, r["events"], r["total_bytes"], r["closed"]) for r in got if r["epoch_start_us"] < 1_000_000_000)
    assert found == [(1, 9, 3, 8, True), (3, 3, 1, 4, False), (11, 11, 1, 0, False), (80, 80, 1, 0, False)]


def test_live_stream_equals_batch(spark, tmp_path):
    """Lines to alerts with the cooldown in between; times keep their microseconds."""
    flow = {"event_type": "flow", "dest_ip": "5.6.7.8", "dest_port": 80, "proto": "TCP", "flow": {"pkts_toserver": 500, "age": 1}}
    line = lambda t, src: (json.dumps(flow | {"timestamp": f"2024-01-01T00:{t // 60:02}:{t % 60:02}.000007+0000", "flow_id": t, "src_ip": src}),)
    score = lambda df: df.withColumns({"is_attack": F.col("total_packets") > 100, "predicted_class": F.lit("DoS"), "confidence": F.lit(0.9)})
    rows = [line(t, src) for t, src in [(0, "a"), (12, "a"), (3, "b"), (5, "a"), (19, "a"), (22, "a"), (4, "b")]]
    untimed = (json.dumps(flow | {"flow_id": 99, "src_ip": "c"}),)
    got = run(spark, tmp_path, [rows[:4], [*rows[4:], untimed], [line(3000, "z")], [line(3020, "z")]], "value string", lambda s: live.detect(s, score, (), 10, "200 seconds"))
    batch = live.detect(spark.createDataFrame([*rows, untimed], "value string"), score).collect()
    told = lambda found: sorted((r["uid"], r["src_ip"], str(r["ts"]), r["confidence"]) for r in found if r["src_ip"] != "z")
    assert told(got) == told(batch) and sorted(int(r["uid"]) for r in batch) == [0, 3, 12, 22, 99]
    assert {str(r["ts"])[-7:] for r in batch if r["ts"]} == {".000007"}
