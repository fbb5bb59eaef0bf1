"""Operator 6 - quality rules judged by host.

Every document gets rule figures from one pass over its text.  Failures of each rule are
summed by host, host rates are shrunk towards the rule's mean with a beta prior fitted to
the hosts themselves, and the verdict is joined back to the host's documents.  A host fails
when its rate of any rule is surely (by its posterior) above a limit that the mean of all
documents gives.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spark_util import cut
from .text_arrays import SPACE, doc_of, slices, span_hashes, text_bytes, window_hashes, windows_inside, words

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A host fails when its posterior mean, less so many deviations, is above the limit: so many
#: times the mean rate of all documents, or half way between that and 1, whichever is less.
DEVIATIONS, TIMES_MEAN = 2.0, 2.0
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
FIGURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
COUNTED = [*FIGURES, "n_lines"]
#: Rules as SQL over the figures (n_lines: lines with a word); the first two are the base.
RULES = {
    "few_words": f"n_words < {MIN_WORDS}",
    "repeats": f"100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words",
    "symbols": "10 * n_symbols > n_words",
    "short_words": "word_chars < 2 * n_words",
    "dup_lines": "10 * n_dup_lines > 3 * n_lines",
}


def repeated_window_words(at: np.ndarray, codes: np.ndarray, size: int = 3) -> np.ndarray:
    """Words of each document within a window of ``size`` words found twice or more in it."""
    n = len(codes)
    windows = window_hashes(codes, size)
    inside = np.flatnonzero(windows_inside(at, size, n)) if n >= size else np.zeros(0, np.int64)
    doc = doc_of(at)
    order = inside[np.lexsort((windows[inside], doc[inside]))] if len(inside) else inside
    same = (doc[order[1:]] == doc[order[:-1]]) & (windows[order[1:]] == windows[order[:-1]])
    again = np.zeros(len(order), bool)
    again[1:] |= same
    again[:-1] |= same
    covered = np.zeros(n, bool)
    for k in range(size):
        covered[order[again] + k] = True
    return np.bincount(doc[covered], minlength=len(at) - 1)


def repeated_lines(data: np.ndarray, at: np.ndarray) -> tuple[list[int], list[int]]:
    """Lines with a word that equal an earlier line of the document, and all lines with a word."""
    raw, out, total = data.tobytes(), [], []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        lines = [x for x in raw[a:b].split(b"\n") if x and not x.isspace()]
        out.append(len(lines) - len(set(lines)))
        total.append(len(lines))
    return out, total


def figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        data, at = text_bytes(batch.column("text"))
        start, end, word_at = words(data, at)
        # Prefix sums over bytes: code points (not continuation bytes) outside white space.
        count = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[at])
        dup_lines, lines = repeated_lines(data, at)
        columns = {
            "n_words": np.diff(word_at),
            "word_chars": count(~SPACE[data] & ((data & 0xC0) != 0x80)),
            "n_symbols": count(SYMBOLS[data]),
            "n_dup_lines": dup_lines,
            "n_repeat_words": repeated_window_words(word_at, span_hashes(data, start, end)),
            "n_lines": lines,
        }
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("host"), *[pa.array(columns[c], pa.int64()) for c in COUNTED]], names=["id", "host", *COUNTED]
        )


def document_figures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """id, host, the figures and base_failed for every row; a null text has no words."""
    read = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.col(host_col).cast("string").alias("host"))
    out = read.mapInArrow(figures, "id long, host string, " + ", ".join(f"{c} long" for c in COUNTED))
    return out.withColumn("base_failed", F.expr(RULES["few_words"]) | F.expr(RULES["repeats"]))


def prior(docs: float, squares: float, hosts: float, failed: float, ratios: float) -> tuple[float, float]:
    """Mean m and weight of the beta prior of a rule's host rates, by moments.

    From the sums over hosts of documents n, n * n, 1, failures f, and f * f / n.  The
    scatter of the host rates around m, weighted by n, is that of binomial draws, for which
    m(1-m) a host is taken off, plus that of the true rates: its variance v gives the
    weight m(1-m)/v - 1, kept between 1 and 1000, and 1000 where draws explain all.
    """
    if not docs:
        return 0.0, 1000.0
    mean = failed / docs
    own = mean * (1 - mean)
    extra, share = ratios - docs * mean * mean - (hosts - 1) * own, docs - squares / docs - (hosts - 1)
    if share <= 0 or extra <= 1e-9 * docs:
        return mean, 1000.0
    return mean, min(1000.0, max(1.0, own * share / extra - 1))


def host_verdicts(figures: DataFrame, deviations: float = DEVIATIONS, times_mean: float = TIMES_MEAN) -> DataFrame:
    """host, docs, for each rule failed_<rule>, rate_<rule> (posterior mean), surely_<rule>
    (rate less ``deviations`` of the posterior) and limit_<rule>, and host_ok (no rule is
    surely above its limit); null hosts get none.  See ``prior``."""
    failures = [F.sum(F.expr(rule).cast("long")).alias(f"failed_{name}") for name, rule in RULES.items()]
    hosts = cut(figures.filter("host is not null").groupBy("host").agg(F.count("*").alias("docs"), *failures))
    docs = F.col("docs").cast("double")
    sums = hosts.agg(
        F.sum(docs).alias("docs"), F.sum(docs * docs).alias("squares"), F.count("*").alias("hosts"),
        *[F.sum(f"failed_{name}").alias(f"failed_{name}") for name in RULES],
        *[F.sum(F.col(f"failed_{name}") * F.col(f"failed_{name}") / docs).alias(f"ratios_{name}") for name in RULES],
    ).first()
    ok = F.lit(True)
    for name in RULES:
        mean, weight = prior(sums["docs"] or 0.0, sums["squares"] or 0.0, sums["hosts"], sums[f"failed_{name}"] or 0, sums[f"ratios_{name}"] or 0.0)
        rate = (F.col(f"failed_{name}") + mean * weight) / (F.col("docs") + weight)
        surely = rate - deviations * F.sqrt(rate * (1 - rate) / (F.col("docs") + weight + 1))
        limit = min(times_mean * mean, (1 + mean) / 2)
        hosts = hosts.withColumns({f"rate_{name}": rate, f"surely_{name}": surely, f"limit_{name}": F.lit(limit)})
        ok = ok & (F.col(f"surely_{name}") <= limit)
    return hosts.withColumn("host_ok", ok)


def host_quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", deviations: float = DEVIATIONS, times_mean: float = TIMES_MEAN) -> DataFrame:
    """Figures, base_failed, the host's rate of each rule and kept for every row of ``docs``.

    kept is false for a document that fails the base rules and for every document of a
    failing host.  Documents without a host are judged by the base rules alone; a null text
    has no words and fails; rows that repeat count and are judged each.  Counts
    by host combine in map tasks, and the join with one row per host is left to
    adaptive execution: broadcast if small, else by key with hot hosts split.
    """
    base = cut(document_figures(docs, id_col, text_col, host_col))
    rates = [f"rate_{name}" for name in RULES]
    verdicts = host_verdicts(base, deviations, times_mean).select(F.col("host").alias("h"), *rates, "host_ok")
    return base.join(verdicts, F.col("host") == F.col("h"), "left").select(
        "id", "host", *FIGURES, "base_failed", *rates, (~F.col("base_failed") & F.coalesce("host_ok", F.lit(True))).alias("kept")
    )
