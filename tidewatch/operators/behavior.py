"""Behaviour of sources over sliding windows.

A window holds the last 300 s, (t - 300 s, t].  Frames that gather values cost as much as
the window for each row; here every row also leaves the window as a row of its own, so
all window figures, distinct counts included, are running sums:

* sums: a row adds its value at t and takes it back at t + 300 s;
* distinct values: a value is new at t if it was not seen in the 300 s before, and is gone
  300 s after an occurrence that no other follows in time.

Running sums are cut into blocks of time, so one busy source is spread over many tasks:
sums within a block, plus the totals of the source's earlier blocks.  The rows are counted
first: where they lie denser, blocks are shorter and tasks more, so that a task's memory
does not grow with the rows.  Where values enter
and leave is found from cells of the window's length: occurrences in one cell are never
further apart, so a cell's first and last time say all, and a hot pair of source and
value is summed up before it meets in a task.

Lifetime counters and window figures share one pass over the sorted rows: a source's
epoch ends by a silence longer than the window, so at its start both are zero.  Steps
(rows that leave, values and failures that come and go) travel without the session's
columns.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed import BEHAVIOR_WINDOW_S, MAX_SOURCES
from ..functions.lineage import cut

SECOND = 1_000_000
#: Greatest length of a block of running sums.
BLOCK_US = 3600 * SECOND
#: Lengths of blocks in seconds, and the rows of a key that one should hold at most.
LENGTHS = (3600, 1200, 600, 300, 120, 60, 30, 10, 5, 2, 1)
BLOCK_ROWS = 50_000
#: The brute force score grows with failures up to 20 and starts above 3.
LEVELS = range(4, 21)


@dataclass(frozen=True)
class Blocks:
    """Length of the blocks, and the number of tasks they are dealt to (None: the session's)."""

    us: int = BLOCK_US
    tasks: int | None = None

    @classmethod
    def of(cls, rows: DataFrame, keys: Sequence[str] = ("saddr",)) -> Blocks:
        """The longest blocks without more than BLOCK_ROWS of ``rows`` (a written table) in one, else those of a second."""
        cells = rows.groupBy(*keys, F.floor(F.col("t_us") / SECOND).alias("_cell")).agg(F.count("*").alias("_n"))
        each = cells.select(*keys, "_n", F.explode(F.array(*[F.struct(F.lit(s).alias("s"), F.floor(F.col("_cell") / s).alias("b")) for s in LENGTHS])).alias("_l"))
        found = each.groupBy(*keys, "_l").agg(F.sum("_n").alias("_n")).groupBy("_l.s").agg(F.max("_n").alias("most"), F.sum("_n").alias("n")).collect()
        fit = [r["s"] for r in found if r["most"] <= BLOCK_ROWS]
        wanted = -(-max((r["n"] for r in found), default=0) // BLOCK_ROWS)
        own = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return cls(max(fit, default=LENGTHS[-1]) * SECOND, wanted if wanted > own else None)

    def dealt(self, rows: DataFrame, *keys: str) -> DataFrame:
        return rows.repartition(self.tasks, *keys) if self.tasks else rows.repartition(*keys)


def running(
    rows: DataFrame, sums: Mapping[str, Column], keys: Sequence[str] = ("saddr",), blocks: Blocks = Blocks(), order: Sequence[str] = (), least: Mapping[str, Column] | None = None, instants: Mapping[str, Column] | None = None
) -> DataFrame:
    """Running sums per key (not null) up to and with each instant ``t_us``, or each row of ``order``.

    ``least`` are running minima; ``instants`` are sums up to and with the instant where
    ``sums`` go by ``order`` (which begins with ``t_us``).  Blocks make the sort and the scan
    of a key divisible; a key's block totals are few (its time span over the block length),
    and their sums go back by an equi-join.  Terms are worked out after the sort, so that
    only ``rows`` are moved.  ``rows`` is read twice.
    """
    keys, least, instants = list(keys), least or {}, instants or {}
    added = {**sums, **instants}
    terms = {f"_{n}": F.coalesce(c, F.lit(0)) for n, c in added.items()} | {f"_{n}": c for n, c in least.items()}
    rows = rows.withColumn("_block", F.floor(F.col("t_us") / blocks.us))
    within = Window.partitionBy(*keys, "_block")
    upto = within.orderBy("t_us").rangeBetween(Window.unboundedPreceding, 0)
    inside = within.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0) if order else upto
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.withColumns(terms).groupBy(*keys, "_block").agg(*[F.sum(f"_{n}").alias(f"_{n}") for n in added], *[F.min(f"_{n}").alias(f"_{n}") for n in least])
    starts = totals.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_block").alias("_kb"), *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_start_{n}") for n in added], *[F.min(f"_{n}").over(before).alias(f"_start_{n}") for n in least]
    )
    local = blocks.dealt(rows, *keys, "_block").sortWithinPartitions(*keys, "_block", *(order or ["t_us"])).withColumns(terms)
    local = local.withColumns({f"_{n}": F.sum(f"_{n}").over(inside if n in sums else upto) for n in added} | {f"_{n}": F.min(f"_{n}").over(inside) for n in least})
    same = F.col("_block") == F.col("_kb")
    for i, k in enumerate(keys):
        same &= F.col(k) == F.col(f"_k{i}")
    joined = local.join(starts, same)
    out = {n: F.col(f"_{n}") + F.col(f"_start_{n}") for n in added} | {n: F.least(f"_{n}", f"_start_{n}") for n in least}
    return joined.withColumns(out).drop("_kb", *[f"_k{i}" for i in range(len(keys))], *[f"{p}{n}" for p in ("_", "_start_") for n in (*added, *least)])


def cells(rows: DataFrame, keys: Sequence[str], us: int) -> DataFrame:
    """keys, cell, first and last: the first and last time of each key in each cell of ``us``."""
    return rows.groupBy(*keys, F.floor(F.col("t_us") / us).alias("cell")).agg(F.min("t_us").alias("first"), F.max("t_us").alias("last"))


def auth_failures(sessions: DataFrame) -> DataFrame:
    """Application failures of each session, and the service they count for."""
    codes = F.coalesce("http_status_codes", F.array().cast("array<string>"))
    http, refused = F.col("http_event_count") > 0, F.col("state").isin("rejected", "failed")
    size = lambda test: F.size(F.filter(codes, test))
    return sessions.withColumns({
        "http_errors": F.when(http, size(lambda x: x.like("4%") | x.like("5%"))).otherwise(0),
        "dns_failures": F.when((F.col("dns_event_count") > 0) & (F.size("dns_answers") == 0), 1).otherwise(0),
        "tls_failures": F.when((F.col("tls_event_count") > 0) & refused, 1).otherwise(0),
        "auth_failures": F.when(http, size(lambda x: x.isin("401", "403", "407"))).otherwise(0) + F.when((F.col("ssh_event_count") > 0) & refused, 1).otherwise(0),
        "service": F.when(F.coalesce("appproto", F.lit("")) != "", F.col("appproto")).otherwise(F.concat_ws("-", "proto", "dport")),
    })


def _value_steps(rows: DataFrame, value: Column, keys: Sequence[str], us: int, window: str, life: str | None) -> DataFrame:
    """keys, t_us and ``window``: +1 where a value enters the window, -1 where it leaves.

    With ``life`` also row_id and ``life``: 1 where a value comes for the first time.
    A cell lies in one epoch, so the same cells serve both.
    """
    known = rows.withColumn("_v", value).filter("_v is not null")
    at = [F.min(F.struct("t_us", "row_id")).alias("at")] if life else []
    found = known.groupBy(*keys, "_v", F.floor(F.col("t_us") / us).alias("cell")).agg(F.min("t_us").alias("first"), F.max("t_us").alias("last"), *at)
    w = Window.partitionBy(*keys, "_v").orderBy("cell")
    of_life = lambda row, new: [row.cast(rows.schema["row_id"].dataType).alias("row_id"), new.cast("int").alias(life)] if life else []
    step = lambda test, t, now, *more: F.when(test, F.struct(t.alias("t_us"), now.cast("int").alias(window), *of_life(*(more or (F.lit(None), F.lit(None))))))
    enters, leaves = F.coalesce(F.col("first") - F.lag("last").over(w) >= us, F.lit(True)), F.coalesce(F.lead("first").over(w) - F.col("last") >= us, F.lit(True))
    found = found.withColumns({"enters": enters, "leaves": leaves} | ({"new": F.lag("cell").over(w).isNull()} if life else {}))
    steps = [step(F.col("enters"), F.col("first"), F.lit(1)), step(F.col("leaves"), F.col("last") + us, F.lit(-1))]
    if life:
        steps.append(step(F.col("new"), F.col("at.t_us"), F.lit(None), F.col("at.row_id"), F.lit(1)))
    return found.select(*keys, F.explode(F.array(*steps)).alias("s")).filter("s is not null").select(*keys, "s.*")


def idle_epochs(rows: DataFrame, keys: Sequence[str], us: int, name: str = "epoch") -> DataFrame:
    """``name``: how many times the key was silent for more than ``us`` before the row.

    A longer gap lies between two cells of that length, so a key's cells decide.  They are
    written, so that a small table of them is known to be small and ``rows`` are not moved.
    """
    w = Window.partitionBy(*keys).orderBy("cell")
    idle = F.coalesce(F.col("first") - F.lag("last").over(w) > us, F.lit(False)).cast("int")
    of = [F.col(k).alias(f"_of{i}") for i, k in enumerate(keys)]
    numbered = cut(cells(rows, keys, us).withColumn("_idle", idle).select(*of, "cell", F.sum("_idle").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias(name)))
    same = F.floor(F.col("t_us") / us) == F.col("cell")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_of{i}"))
    return rows.join(numbered, same).drop("cell", *[f"_of{i}" for i in range(len(keys))])


def source_epochs(sessions: DataFrame, window_s: int = BEHAVIOR_WINDOW_S) -> DataFrame:
    """``epoch`` of a source: lifetime counters start anew after more than the window
    without sessions.  (An exact idle gap; there is no periodic sweep.)"""
    return idle_epochs(sessions, ["saddr"], window_s * SECOND)


def _failure_steps(rows: DataFrame, keys: Sequence[str], us: int, blocks: Blocks) -> DataFrame:
    """keys, t_us and _f: by how much the most failures of one service (4 to 20, else 0) change.

    Each service's failures in the window reach and leave levels; the services at each level
    are counted at every instant that has such a step.
    """
    blocks = Blocks(blocks.us)
    failed = rows.filter("auth_failures > 0").select(*keys, F.coalesce("service", F.lit("")).alias("service"), "t_us", F.col("auth_failures").alias("n"))
    changes = failed.unionAll(failed.withColumns({"t_us": F.col("t_us") + us, "n": -F.col("n")}))
    instants = cut(changes.groupBy(*keys, "service", "t_us").agg(F.sum("n").alias("n")).filter("n != 0"))
    cap = lambda c: F.least(F.greatest(c, F.lit(LEVELS[0] - 1)), F.lit(LEVELS[-1]))
    crossed = running(instants, {"now": F.col("n")}, [*keys, "service"], blocks).select(*keys, "t_us", cap(F.col("now")).alias("to"), cap(F.col("now") - F.col("n")).alias("from")).filter("`to` != `from`")
    step = lambda k: F.when((F.col("to") >= k) & (F.col("from") < k), 1).when((F.col("to") < k) & (F.col("from") >= k), -1).otherwise(0)
    steps = cut(crossed.groupBy(*keys, "t_us").agg(*[F.sum(step(k)).alias(f"step{k}") for k in LEVELS]))
    found = running(steps, {f"level{k}": F.col(f"step{k}") for k in LEVELS}, keys, blocks)
    most = lambda at: F.greatest(*[F.when(at(k) > 0, k).otherwise(0) for k in LEVELS])
    change = most(lambda k: F.col(f"level{k}")) - most(lambda k: F.col(f"level{k}") - F.col(f"step{k}"))
    return found.select(*keys, "t_us", change.alias("_f")).filter("_f != 0")


def _figures(base: DataFrame, keys: Sequence[str], us: int, window: bool, life: bool, failures: bool = True) -> DataFrame:
    """``base`` (a written table) with window figures, lifetime counters or both, in one pass; ``_block`` beside them.

    With epochs among the ``keys``, ``us`` has to be the silence that ends one.  The steps are written once.
    """
    keys = list(keys)
    blocks = Blocks.of(base)
    values = [("_i", "_li", F.when(F.col("daddr") != "", F.col("daddr"))), ("_o", "_lo", F.when(F.col("dport") > 0, F.col("dport")))]
    steps = [_value_steps(base, value, keys, us, now, first if life else None) for now, first, value in values]
    if window and failures:
        steps.append(_failure_steps(base, keys, us, blocks))
    union = steps[0]
    for s in steps[1:]:
        union = union.unionByName(s, allowMissingColumns=True)
    union = cut(union if window else union.filter("_li = 1 or _lo = 1"))
    session = [c for c in base.columns if c not in (*keys, "t_us", "row_id")]
    own = base.select(*keys, "t_us", "row_id", F.lit(True).alias("_own"), F.struct(*session).alias("_s"))
    rows = own.unionByName(union.withColumn("_own", F.lit(False)), allowMissingColumns=True)
    if window:
        left = base.select(*keys, (F.col("t_us") + us).alias("t_us"), F.lit(False).alias("_own"), F.col("total_fwd_bytes").alias("_b"), F.col("total_fwd_packets").alias("_p"))
        rows = rows.unionByName(left, allowMissingColumns=True)
    of = lambda c: F.col("_s").getField(c) if c in session else F.col(c)
    signed = lambda c, gone: F.coalesce(of(c), -F.col(gone))
    instants = {"window_bytes": signed("total_fwd_bytes", "_b"), "window_packets": signed("total_fwd_packets", "_p"), "ips": F.col("_i"), "ports": F.col("_o")} if window else {}
    if window and failures:
        instants["failures"] = F.col("_f")
    sums, least = (_lifetime_sums(of), {"first_seen_us": F.when(F.col("_own"), F.col("t_us"))}) if life else ({}, {})
    found = running(rows, sums, keys, blocks, ["t_us", "row_id", "_own"] if life else (), least, instants).filter("_own")
    added = [*sums, *least, *instants]
    out = found.select(*[of(c).alias(c) if c in session else c for c in base.columns], *added, "_block")
    return out.withColumn("failures", F.col("failures").cast("int") if failures else F.lit(0)) if window else out


def _lifetime_sums(of: Callable[[str], Column]) -> dict[str, Column]:
    """Terms of the lifetime counters; ``of`` gives a session's column, null in rows that are steps."""
    count = lambda test: test.cast("long")
    return {
        "total_flows": F.when(F.col("_own"), F.lit(1).cast("long")), "completed_flows": count(of("is_complete")), "active_flows": count(~of("is_complete")),
        "bytes_sent": of("total_fwd_bytes"), "bytes_received": of("total_bwd_bytes"), "packets_sent": of("total_fwd_packets"), "packets_received": of("total_bwd_packets"),
        "unique_dst_ips": F.col("_li"), "unique_dst_ports": F.col("_lo"),
        "all_http": of("http_event_count"), "all_http_errors": of("http_errors"), "all_dns": of("dns_event_count"), "all_dns_failures": of("dns_failures"),
        "all_tls": of("tls_event_count"), "all_tls_failures": of("tls_failures"), "all_ssh": of("ssh_event_count"), "all_auth_failures": of("auth_failures"),
        "rejected_flows": count(of("state") == "rejected"), "reset_flows": count(of("state") == "rst"), "tcp_flows": count(of("proto") == "TCP"), "udp_flows": count(of("proto") == "UDP"),
    }


def window_figures(sessions: DataFrame, window_s: int = BEHAVIOR_WINDOW_S, failures: bool = True) -> DataFrame:
    """Figures of the window that ends with each session.

    Needs row_id, saddr, t_us, daddr, dport, total_fwd_bytes, total_fwd_packets and, for
    ``failures``, auth_failures and service; rows without a source go.  Adds ports, ips,
    window_bytes, window_packets and failures (most failures of one service, from 4 to 20,
    else 0).  Sessions of one instant see each other.  The sessions are written once, as
    they are read for each figure.
    """
    base = cut(sessions.filter("saddr is not null and saddr != ''"))
    return _figures(base, ["saddr"], window_s * SECOND, True, False, failures).drop("_block")


def _kept(figures: DataFrame, names: Sequence[str]) -> DataFrame:
    """``names`` with nulls replaced by the source's last value before (of its epoch, where there
    is one), within and across blocks; 0 at first.

    Figures that still have their ``_block`` lie by it and in order, and go on from there;
    the blocks' last values are then worked out apart, from the columns that they need.
    """
    rows = figures
    if "_block" not in figures.columns:
        rows = cut(figures)
        blocks = Blocks.of(rows)
        rows = rows.withColumn("_block", F.floor(F.col("t_us") / blocks.us))
    at = F.struct("t_us", "row_id")
    keys = ["saddr", *[c for c in ("epoch",) if c in figures.columns]]
    inside = Window.partitionBy(*keys, "_block").orderBy("t_us", "row_id").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*keys, "_block").agg(*[F.max_by(n, F.when(F.col(n).isNotNull(), at)).alias(n) for n in names])
    starts = totals.select(*keys, "_block", *[F.last(n, ignorenulls=True).over(before).alias(f"_start{n}") for n in names])
    dealt = rows if rows is figures else blocks.dealt(rows, *keys, "_block")
    local = dealt.withColumns({n: F.last(n, ignorenulls=True).over(inside) for n in names}).join(starts, [*keys, "_block"], "left")
    return local.withColumns({n: F.coalesce(n, f"_start{n}", F.lit(0.0)) for n in names}).drop("_block", *[f"_start{n}" for n in names])


def scores(figures: DataFrame, window_s: int = BEHAVIOR_WINDOW_S) -> DataFrame:
    """W3-W8.  A window without addresses or ports keeps the score of the source's last one."""
    ratio = lambda a, b, least, most: F.when(F.col(b) > 0, F.when(F.col(a) / F.nullif(F.col(b), F.lit(0)) > least, F.least(F.lit(1.0), F.col(a) / F.nullif(F.col(b), F.lit(0)) / most)).otherwise(0.0))
    scans = figures.withColumns({"port_scan_score": ratio("ports", "ips", 10, 50), "host_scan_score": ratio("ips", "ports", 5, 20)})
    return overall(_kept(scans, ["port_scan_score", "host_scan_score"]), window_s)


def overall(scans: DataFrame, window_s: int = BEHAVIOR_WINDOW_S) -> DataFrame:
    """W5-W8 from the scan scores and the window's figures."""
    rate = lambda c, least, most: F.when(F.col(c) / window_s > least, F.least(F.lit(1.0), F.col(c) / window_s / most)).otherwise(0.0)
    return (
        scans.withColumns({
            "scan_score": F.greatest("port_scan_score", "host_scan_score"),
            "brute_force_score": F.when(F.col("failures") > 3, F.least(F.lit(1.0), F.col("failures") / 20)).otherwise(0.0),
            "volume_score": F.greatest(rate("window_bytes", 1e6, 1e7), rate("window_packets", 1e3, 1e4)),
        })
        .withColumn("overall_score", F.greatest("scan_score", "brute_force_score", "volume_score"))
    )


def lifetime(sessions: DataFrame) -> DataFrame:
    """Running counters of a source since its epoch began (needs ``epoch``).

    The first session of each address and port, one row each after partial sums, carries
    the step of the distinct counts.
    """
    return _figures(cut(sessions), ["saddr", "epoch"], BEHAVIOR_WINDOW_S * SECOND, False, True).drop("_block")


def counters_by(sessions: DataFrame, column: str) -> DataFrame:
    """Sessions of each source by protocol, application protocol or state."""
    return sessions.filter(F.coalesce(F.col(column), F.lit("")) != "").groupBy("saddr", column).agg(F.count("*").alias("n"))


def features(scored: DataFrame, window_s: int = BEHAVIOR_WINDOW_S) -> DataFrame:
    """19 features from lifetime counters, window figures and scores."""
    s = F.greatest(F.least((F.col("t_us") - F.col("first_seen_us")) / SECOND, F.lit(float(window_s))), F.lit(0.001))
    one = lambda c: F.greatest(F.col(c), F.lit(1))
    return scored.withColumns({
        "flow_rate": F.col("total_flows") / s, "complete_flow_ratio": F.col("completed_flows") / one("total_flows"),
        "dst_ips_per_second": F.col("ips") / s, "dst_ports_per_second": F.col("ports") / s,
        "bytes_sent_per_second": F.col("window_bytes") / s, "packets_sent_per_second": F.col("window_packets") / s,
        "http_error_ratio": F.col("all_http_errors") / one("all_http"), "dns_failure_ratio": F.col("all_dns_failures") / one("all_dns"), "tls_failure_ratio": F.col("all_tls_failures") / one("all_tls"),
        "auth_failures_per_second": F.col("all_auth_failures") / s, "rejected_ratio": F.col("rejected_flows") / one("total_flows"), "reset_ratio": F.col("reset_flows") / one("total_flows"),
    })


def analyze(sessions: DataFrame, window_s: int = BEHAVIOR_WINDOW_S) -> DataFrame:
    """W1-W9, W11 for sessions with row_id and t_us (event time in microseconds)."""
    return analyze_counted(auth_failures(sessions), window_s)


def analyze_counted(sessions: DataFrame, window_s: int = BEHAVIOR_WINDOW_S) -> DataFrame:
    """``analyze`` for sessions whose failures are counted; the sessions are written once."""
    ready = source_epochs(cut(sessions.filter("saddr is not null and saddr != ''")), window_s)
    return features(scores(_figures(ready, ["saddr", "epoch"], window_s * SECOND, True, True), window_s).drop("_block"), window_s)


def anomalous(scored: DataFrame, least: float = 0.5) -> DataFrame:
    """W10."""
    return scored.filter(F.col("overall_score") > least)


def latest(scored: DataFrame) -> DataFrame:
    """The last row of each source."""
    return scored.groupBy("saddr").agg(F.max_by(F.struct("*"), F.struct("t_us", "row_id")).alias("r")).select("r.*")


def newest_sources(scored: DataFrame, most: int = MAX_SOURCES) -> DataFrame:
    """The sources seen last."""
    return latest(scored).orderBy(F.desc("t_us"), "saddr").limit(most)


def top_sources(scored: DataFrame, n: int = 10) -> DataFrame:
    """T1."""
    return latest(scored).select("saddr", "overall_score").orderBy(F.desc("overall_score"), "saddr").limit(n)


def scan_activity(scored: DataFrame, least: float = 0.7) -> DataFrame:
    """Port scans first, then host scans, by score."""
    kind = F.when(F.col("port_scan_score") > least, "port_scan").when(F.col("host_scan_score") > least, "host_scan")
    rows = latest(scored).withColumn("scan_type", kind).filter("scan_type is not null")
    return rows.select("saddr", F.when(F.col("scan_type") == "port_scan", F.col("port_scan_score")).otherwise(F.col("host_scan_score")).alias("score"), "scan_type").orderBy(F.desc("score"), "saddr")


def brute_force_activity(scored: DataFrame, least: float = 0.7) -> DataFrame:
    """T3."""
    return latest(scored).filter(F.col("brute_force_score") > least).select("saddr", "brute_force_score").orderBy(F.desc("brute_force_score"), "saddr")


def statistics(scored: DataFrame) -> DataFrame:
    """T4."""
    return latest(scored).agg(F.count("*").alias("tracked_ips"), F.count_if(F.col("overall_score") > 0.5).alias("anomalous_ips"))


def of_source(scored: DataFrame, address: str) -> DataFrame:
    """T5."""
    return latest(scored.filter(F.col("saddr") == address))


def coarse(events: DataFrame, window: str = "300 seconds", slide: str = "60 seconds") -> DataFrame:
    """Approximate scores in sliding windows, for streams (needs ``ts``; set a watermark)."""
    w = events.groupBy(F.window("ts", window, slide).alias("w"), "saddr").agg(
        F.approx_count_distinct("dport").alias("ports"), F.approx_count_distinct("daddr").alias("ips"), F.sum("total_fwd_bytes").alias("window_bytes"), F.sum("total_fwd_packets").alias("window_packets")
    )
    ratio = lambda a, b, least, most: F.when(F.try_divide(F.col(a), F.col(b)) > least, F.least(F.lit(1.0), F.try_divide(F.col(a), F.col(b)) / most)).otherwise(0.0)
    return w.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "saddr", ratio("ports", "ips", 10, 50).alias("port_scan_score"), ratio("ips", "ports", 5, 20).alias("host_scan_score"), "window_bytes", "window_packets")
