"""Live detection: lines -> flows -> features -> scores -> alerts -> log."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.fixed import COOLDOWN_S
from ..operators import alerts, features, parse
from ..operators.whitelist import drop_sources
from . import stateful

Score = Callable[[DataFrame], DataFrame]


def detect(lines: DataFrame, score: Score, local: Iterable[str] = (), seconds: float = COOLDOWN_S, delay: str = "30 seconds") -> DataFrame:
    """Alert rows of a batch or a stream of lines, less those held back by the cooldown.

    Signature events go past the local-source filter; flows of local sources are left out.
    ``score`` adds is_attack, predicted_class and confidence to the serving features; it
    has no state, so there is no shuffle before the cooldown.  That is by event time
    (``delay`` is the watermark's in a stream); 0 seconds let every alert pass.
    """
    events = parse.decode(lines)
    flows = drop_sources(parse.flows(events), local)
    models = alerts.model_alerts(score(features.serve_v3(flows)))
    found = alerts.all_alerts(alerts.signature_alerts(events), models)
    if seconds <= 0:
        return found
    # Lines have no number: alerts of one key and instant are told apart by what they say.
    timed = found.withColumns({"t_us": F.unix_micros("ts"), "row_id": F.xxhash64("detection_method", "signature", "confidence")})
    quiet = stateful.cooldown(timed, alerts.ALERT_KEY, seconds, delay) if lines.isStreaming else alerts.cooldown(timed, seconds)
    return quiet.drop("t_us", "row_id")


def write_json(found: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """The JSON log as a file sink; the checkpoint makes restarts exact."""
    return alerts.log_rows(found).writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()


def replacing(path: str, form: str = "json") -> Callable[[DataFrame, int], None]:
    """A writer for ``write_batches`` that replaces the folder of its batch id, so that a batch
    run again after a failure leaves one copy.  Readers see the id as the column ``batch``."""

    def write(rows: DataFrame, number: int) -> None:
        rows.write.format(form).mode("overwrite").save(f"{path.rstrip('/')}/batch={number}")

    return write


def count_late(query: StreamingQuery) -> int:
    """Rows that came after the watermark had passed them and were left out, in all
    progress reports that the query still holds."""
    return sum(int(s.get("numRowsDroppedByWatermark", 0)) for p in query.recentProgress for s in p["stateOperators"])


def split_late(time: str, delay_s: float, state: str, ready: Callable[[DataFrame, int], None], late: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A writer for ``write_batches`` that gives rows more than ``delay_s`` behind the latest
    time of earlier batches to ``late``, all others to ``ready``.

    The latest time of each batch is written below ``state``, so a batch that is run again
    is split as before.  Rows without a time are not late.
    """

    def write(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        newest = rows.agg(F.lit(number).cast("long").alias("number"), F.max(time).alias("newest"))
        newest.write.mode("overwrite").parquet(f"{state.rstrip('/')}/batch={number}")
        seen = spark.read.schema("number long, newest timestamp").parquet(f"{state.rstrip('/')}/batch=*").filter(F.col("number") < number)
        limit = seen.agg(F.max("newest").alias("m")).select((F.col("m") - F.make_dt_interval(secs=F.lit(delay_s))).alias("m")).first()["m"]
        behind = F.coalesce(F.col(time) < F.lit(limit), F.lit(False)) if limit is not None else F.lit(False)
        ready(rows.filter(~behind), number)
        late(rows.filter(behind), number)

    return write


def write_batches(found: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """``write(batch, id)`` for each batch; idempotent if it replaces what the id wrote."""
    return found.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()
