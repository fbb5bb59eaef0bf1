"""Zero-byte bursts, cooldown, alert rows and their texts."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed import COOLDOWN_S, SIGNATURE_CLASS, ZERO_BYTE_COUNT, ZERO_BYTE_RATE
from ..functions.lineage import cut
from .behavior import idle_epochs, running
from .whitelist import loud_alerts

SECOND = 1_000_000
ALERT_KEY = ["src_ip", "dst_ip", "dst_port", "predicted_class"]


def zero_byte_bursts(sessions: DataFrame, least: int = ZERO_BYTE_COUNT, rate: float = ZERO_BYTE_RATE, forget_s: float | None = None) -> DataFrame:
    """Sessions without bytes, numbered per (source, destination:port:protocol).

    Adds dest_key, zero_count, zero_rate (per second since the first, at least 0.001 s)
    and zero_detected.  Needs t_us and row_id.  Counts are running sums in blocks of time.
    With ``forget_s`` a destination that is silent for longer is counted anew.
    """
    quiet = sessions.filter(F.coalesce("total_fwd_bytes", F.lit(0)) + F.coalesce("total_bwd_bytes", F.lit(0)) <= 0)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    keyed = quiet.withColumn("dest_key", F.concat_ws(":", text("daddr"), text("dport"), text("proto")))
    source = F.coalesce(F.concat(F.lit("="), F.col("saddr")), F.lit(""))
    keyed, keys = keyed.withColumn("_source", source), ["_source", "dest_key"]
    if forget_s is not None:
        keyed, keys = idle_epochs(keyed, keys, int(forget_s * SECOND), "_epoch"), [*keys, "_epoch"]
    counted = running(keyed, {"zero_count": F.lit(1).cast("long")}, keys, order=["t_us", "row_id"], least={"_first": F.col("t_us")})
    since = F.greatest((F.col("t_us") - F.col("_first")) / SECOND, F.lit(0.001))
    counted = counted.withColumn("zero_rate", F.col("zero_count") / since).drop("_source", "_first", "_epoch")
    return counted.withColumn("zero_detected", (F.col("zero_count") >= least) & (F.col("zero_rate") > rate))


def cooldown(alerts: DataFrame, seconds: float = COOLDOWN_S, key: list[str] | None = None, time: str = "t_us", blocks: int = 6) -> DataFrame:
    """Drop an alert less than ``seconds`` after the last one of its key that was kept.

    A key's time is cut into blocks of ``blocks`` cooldowns, and no task holds more than a
    block's alerts.  What a block does is a function of the time from which its alerts may
    pass: the last alert that it keeps, a few steps over the alerts of its first cooldown.
    These functions are put one after another for each key, which gives each block its time,
    and the blocks are then gone through by themselves.

    Of one instant the smallest row_id passes, null first; repeated row ids are different
    alerts.  An alert without a time passes and holds nothing back.
    """
    key = key or ALERT_KEY
    gap = int(seconds * SECOND)
    if gap <= 0:
        return alerts
    size = gap * max(1, blocks)
    names = [f"_k{i}" for i in range(len(key))]
    own = [F.col(k).alias(n) for k, n in zip(key, names, strict=True)]
    tie = F.col("row_id").cast("string") if "row_id" in alerts.columns and alerts.schema["row_id"].dataType.simpleString() not in ("bigint", "int") else F.col("row_id").cast("long") if "row_id" in alerts.columns else F.lit(0)
    row = F.struct(F.col(time).cast("long").alias("t"), tie.alias("tie"), F.struct(*[F.col(c) for c in alerts.columns]).alias("row"))
    timed = alerts.filter(F.col(time).isNotNull())
    groups = cut(timed.groupBy(*own, F.floor(F.col(time) / size).cast("long").alias("block")).agg(F.collect_list(row).alias("rows")))
    times = groups.select(*names, "block", F.col("rows.t").alias("times"))
    kinds = ", ".join(f"{n} {groups.schema[n].dataType.simpleString()}" for n in names)
    steps = times.mapInArrow(partial(_block_steps, gap, size), f"{kinds}, block long, starts array<long>, ends array<long>")
    chains = steps.groupBy(*names).agg(F.sort_array(F.collect_list(F.struct("block", "starts", "ends"))).alias("steps")).filter(F.size("steps") > 1)
    opened = chains.mapInArrow(partial(_opening_times, gap), f"{kinds}, opened array<struct<block:bigint,free:bigint>>").select(*[F.col(n).alias(f"of{n}") for n in names], F.explode("opened").alias("o"))
    same = reduce(lambda x, y: x & y, [F.col(n).eqNullSafe(F.col(f"of{n}")) for n in names])
    ready = groups.join(opened, same & (F.col("block") == F.col("o.block")), "left").select(groups["block"], "rows", F.col("o.free").alias("free"))
    return ready.mapInArrow(partial(_passing, gap, size), alerts.schema).unionByName(alerts.filter(F.col(time).isNull()))


def _in_order(batch: pa.RecordBatch, times: np.ndarray, lengths: np.ndarray, size: int, tie: pa.Array | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows of all blocks in order, their block's place, and their time on one scale for all blocks."""
    group = np.repeat(np.arange(len(lengths)), lengths)
    scale = times - np.repeat(batch.column("block").to_numpy(), lengths) * size + group * (2 * size)
    keys = [scale, group] if tie is None else [pc.rank(tie, null_placement="at_start", tiebreaker="first").to_numpy(), scale, group]
    order = np.lexsort(keys)
    return order, group[order], scale[order]


def _next_kept(scale: np.ndarray, group: np.ndarray, gap: int) -> np.ndarray:
    """The alert of the same block that is kept after each one, itself where there is none."""
    after = np.searchsorted(scale, scale + gap)
    there = np.minimum(after, len(scale) - 1)
    return np.where((after < len(scale)) & (group[there] == group), there, np.arange(len(scale)))


def _block_steps(gap: int, size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block as a function: free from a time up to starts[i] (and above the one before), it keeps ends[i] last."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column("times")
        times, lengths = column.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
        order, group, scale = _in_order(batch, times, lengths, size)
        last = _next_kept(scale, group, gap)
        for _ in range(max(1, (size // gap + 1).bit_length())):  # a pointer to the end, doubled each time
            last = last[last]
        late = scale - group * (2 * size) >= gap
        first_late = late & (np.concatenate([[True], ~late[:-1]]) | np.concatenate([[True], group[1:] != group[:-1]]))
        held = np.flatnonzero(~late | first_late)
        same = np.zeros(len(held), bool)  # of starts with one end the last says all
        same[:-1] = (group[held[1:]] == group[held[:-1]]) & (last[held[1:]] == last[held[:-1]])
        held = held[~same]
        at = np.concatenate([[0], np.cumsum(np.bincount(group[held], minlength=len(lengths)))]).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(at), pa.array(times[order[i]])) for i in (held, last[held])]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *lists], names=[*batch.schema.names[:-1], "starts", "ends"])


def _opening_times(gap: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From when on the alerts of each block of a key may pass, for blocks that others hold back."""
    for batch in batches:
        out = []
        for steps in batch.column("steps").to_pylist():
            free, opened = None, []
            for s in steps:
                if free is not None:
                    opened.append({"block": s["block"], "free": free})
                i = 0 if free is None else bisect_left(s["starts"], free)
                if i < len(s["starts"]):
                    free = s["ends"][i] + gap
            out.append(opened)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.list_(pa.struct([("block", pa.int64()), ("free", pa.int64())])))], names=[*batch.schema.names[:-1], "opened"])


def _passing(gap: int, size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The alerts that pass."""
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch.column("rows")
        lengths, flat = pc.list_value_length(rows).to_numpy(zero_copy_only=False).astype(np.int64), rows.flatten()
        order, group, scale = _in_order(batch, flat.field("t").to_numpy(zero_copy_only=False), lengths, size, flat.field("tie"))
        after = _next_kept(scale, group, gap)
        start = batch.column("block").to_numpy() * size
        free = np.where(pc.is_null(batch.column("free")).to_numpy(zero_copy_only=False), start, pc.fill_null(batch.column("free"), 0).to_numpy(zero_copy_only=False))
        number = np.arange(len(lengths))
        now = np.searchsorted(scale, np.clip(free - start, 0, 2 * size - 1) + number * (2 * size))
        now = now[now < np.cumsum(lengths)]
        passes = np.zeros(len(order), bool)
        while len(now):
            passes[now] = True
            now = after[now][after[now] != now]
        kept = flat.field("row").take(pa.array(order[passes]))
        yield pa.RecordBatch.from_arrays(kept.flatten(), names=[f.name for f in kept.type])


def signature_alerts(events: DataFrame, *keep: str, v2: bool = False) -> DataFrame:
    """Decoded signature events as alert rows; v2 gives them confidence 1 and keeps
    quiet categories."""
    rows = events.filter("e.event_type = 'alert'").select(
        *keep, F.try_to_timestamp("e.timestamp").alias("ts"), F.col("e.src_ip").alias("src_ip"), F.col("e.dest_ip").alias("dst_ip"),
        F.col("e.dest_port").try_cast("int").alias("dst_port"), F.col("e.proto").alias("proto"), F.lit(SIGNATURE_CLASS).alias("predicted_class"),
        F.lit(1.0 if v2 else None).cast("double").alias("confidence"), F.lit(True).alias("is_attack"), F.lit("suricata_signature").alias("detection_method"),
        F.coalesce("e.alert.signature", F.lit("Unknown")).alias("signature"), F.col("e.alert.category").alias("category"), F.coalesce(F.col("e.alert.severity").try_cast("int"), F.lit(3)).alias("severity"),
    )
    return rows if v2 else loud_alerts(rows)


def model_alerts(scored: DataFrame) -> DataFrame:
    """Flows scored as attacks as alert rows."""
    return scored.filter("is_attack").withColumnsRenamed({"saddr": "src_ip", "daddr": "dst_ip", "dport": "dst_port"}).withColumn("detection_method", F.lit("ml"))


def all_alerts(signatures: DataFrame, models: DataFrame) -> DataFrame:
    """K1, K2: both kinds in one table."""
    return signatures.unionByName(models, allowMissingColumns=True)


def log_rows(alerts: DataFrame) -> DataFrame:
    """K3: the five fields of the JSON log; confidence as text with three decimals."""
    return alerts.select("src_ip", F.col("dst_ip").alias("dest_ip"), F.col("dst_port").alias("dest_port"), F.format_string("%.3f", F.coalesce("confidence", F.lit(0.0))).alias("confidence"), F.col("predicted_class").alias("predicted_attack"))


def write_log(alerts: DataFrame, path: str) -> None:
    """K3: append JSON lines."""
    log_rows(alerts).write.mode("append").json(path)


RESULT_COLUMNS = [
    "timestamp", "src_ip", "dst_ip", "dst_port", "proto", "predicted_class", "confidence", "detection_method", "suricata_signature",
    "dt_vote", "rf_vote", "xgb_vote", "duration", "total_bytes", "total_packets",
]


def result_rows(alerts: DataFrame) -> DataFrame:
    """K4: the 15 columns of the CSV log, null where an alert has none; a signature alert
    names its signature and has no totals (zero)."""
    signature = F.col("detection_method") == "suricata_signature"
    if "signature" in alerts.columns:
        alerts = alerts.withColumn("suricata_signature", F.col("signature"))
    own = lambda c: F.col(c) if c in alerts.columns else F.lit(None).cast("string")
    total = lambda c: F.when(signature, F.coalesce(c, F.lit(0))).otherwise(F.col(c)) if c in alerts.columns else F.when(signature, F.lit(0))
    return alerts.select(*[(total(c) if c in ("duration", "total_bytes", "total_packets") else own(c)).alias(c) for c in RESULT_COLUMNS])


def write_results(alerts: DataFrame, path: str) -> None:
    """K4: append CSV parts, each with a header."""
    result_rows(alerts).write.mode("append").csv(path, header=True)


def numbered(alerts: DataFrame, time: str = "t_us", partitions: int | None = None) -> DataFrame:
    """K5: ``alert_no`` from 1 over all alerts by time, row_id among equal times (nulls first).

    Alerts are laid out by ranges of time; a range's numbers start after those of the ranges
    before it, whose counts are a row each.  No task has more than a range.
    """
    order = [time, "row_id"]
    n = partitions or max(1, int(alerts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = cut(alerts.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("_range").count().select("_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    no = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) + F.col("_start")
    return rows.join(F.broadcast(starts), "_range").withColumn("alert_no", no).drop("_range", "_start")


def numbered_text(alerts: DataFrame, time: str = "t_us", per_source: bool = True) -> DataFrame:
    """K5: alert_no by time within each source, or over all alerts (``numbered``), and one line of text."""
    no = F.row_number().over(Window.partitionBy("src_ip").orderBy(time, "row_id"))
    alerts = alerts.withColumn("alert_no", no) if per_source else numbered(alerts, time)
    text = lambda c, d="": F.coalesce(F.col(c).cast("string"), F.lit(d)) if c in alerts.columns else F.lit(d)
    where = F.format_string("%s -> %s:%s", text("src_ip", "?"), text("dst_ip", "?"), text("dst_port", "?"))
    signature = F.format_string("[%d] Suricata Alert | %s | severity=%s | category=%s | signature=%s", "alert_no", where, text("severity"), text("category"), text("signature"))
    model = F.format_string("[%d] %s | Class: %s  Conf: %.3f", "alert_no", where, text("predicted_class", "Unknown"), F.coalesce("confidence", F.lit(0.0)))
    return alerts.withColumn("text", F.when(F.col("detection_method") == "suricata_signature", signature).otherwise(model))


def finalized(sessions: DataFrame, scored: DataFrame, bursts: DataFrame) -> DataFrame:
    """K6, K7: sessions with their detection and hints; a hint never changes the class.

    ``scored`` and ``bursts`` have row_id.  A session without a score is Unknown, with the
    note that extraction failed; the burst note gives its rate.  Flow id, start, application
    protocol and duration are null where the sessions have no such column; zero_byte_info
    is null without a burst.  The probabilities by class and the votes are those of
    ``scored`` (see ``scoring.detector_result``), empty where it has none; ml_result is the
    model's answer as it was, null without one.
    """
    hints = bursts.filter("zero_detected").select("row_id", "zero_rate", "zero_count", "dest_key")
    kinds = {"proba_per_class": "map<string,double>", "model_votes": "map<string,string>"}
    told = [(F.col(c) if c in scored.columns else F.lit(None)).cast(k).alias(f"_{c}") for c, k in kinds.items()]
    joined = sessions.join(scored.select("row_id", "is_attack", "predicted_class", "confidence", *told), "row_id", "left").join(hints, "row_id", "left")
    missing = F.col("predicted_class").isNull()
    burst = F.format_string("zero-byte pattern detected (rate=%.1f/s)", "zero_rate")
    none = F.array().cast("array<string>")
    own = lambda c, kind: (F.col(c) if c in sessions.columns else F.lit(None)).cast(kind)
    info = F.struct(F.col("zero_count").alias("count"), F.col("zero_rate").alias("rate"), F.col("dest_key").alias("destination"))
    return joined.select(
        "row_id", own("uid", "string").alias("flow_id"), own("starttime", "timestamp").alias("timestamp"), own("appproto", "string").alias("app_proto"), own("duration", "double").alias("duration"), F.col("saddr").alias("src_ip"), F.col("daddr").alias("dst_ip"), F.col("dport").alias("dst_port"), "proto",
        (F.col("total_fwd_bytes") + F.col("total_bwd_bytes")).alias("total_bytes"), (F.col("total_fwd_packets") + F.col("total_bwd_packets")).alias("total_packets"),
        F.coalesce("is_attack", F.lit(False)).alias("is_attack"), F.coalesce("predicted_class", F.lit("Unknown")).alias("predicted_class"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        *[F.coalesce(f"_{c}", F.create_map().cast(k)).alias(c) for c, k in kinds.items()],
        F.when(~missing, F.struct("is_attack", "predicted_class", "confidence")).alias("ml_result"),
        F.coalesce(F.col("zero_rate").isNotNull() & ~missing, F.lit(False)).alias("zero_byte"),
        F.when(F.col("zero_rate").isNotNull() & ~missing, info).alias("zero_byte_info"),
        F.when(missing, F.array(F.lit("feature extraction failed"))).when(F.col("zero_rate").isNotNull(), F.array(burst)).otherwise(none).alias("notes"),
    )


# The parts of an alert's long text.
TITLE, RULE = "\u26a0\ufe0f ANOMALY DETECTED \u26a0\ufe0f", "-" * 40


def message(alerts: DataFrame, details: str = "details", time: str = "ts") -> DataFrame:
    """The long text of an alert; of ``details`` (array of feature, value, z_score)
    the first three are told.  ``time`` is when the alert was raised; without it the text
    says Unknown."""
    shown = F.transform(F.slice(F.coalesce(F.col(details), F.array().cast("array<struct<feature:string,value:double,z_score:double>>")), 1, 3), lambda d: F.format_string("- %s: %s (z-score: %.2f)", d["feature"], d["value"], d["z_score"]))
    line = lambda name, c: F.concat(F.lit(f"{name}: "), F.coalesce(F.col(c).cast("string"), F.lit("Unknown")))
    app = F.when(F.coalesce("app_proto", F.lit("")) != "", F.concat(F.lit("App Protocol: "), "app_proto"))
    found = F.when(F.size(shown) > 0, F.concat(F.lit("\nStatistical Anomalies:\n"), F.array_join(shown, "\n")))
    when = F.coalesce(F.date_format(time, "yyyy-MM-dd HH:mm:ss") if time in alerts.columns else F.lit(None).cast("string"), F.lit("Unknown"))
    return alerts.withColumn("message", F.concat_ws(
        "\n", F.lit(f"{TITLE}\n"), F.concat(F.lit("Time: "), when), F.lit(RULE), F.lit("CONNECTION DETAILS:"), line("Source IP", "src_ip"), line("Source Port", "src_port"), line("Destination IP", "dst_ip"),
        line("Destination Port", "dst_port"), line("Protocol", "proto"), app, F.format_string("\nAnomaly Score: %.4f", F.coalesce("combined_score", F.lit(0.0))), found, F.concat(F.lit("\nAlert generated at "), when),
    ))
