"""Queries of cleaning, sampling and training features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fixed import FEATURES_V2, FEATURES_V3
from ..operators import clean, features, scoring
from .events import rounded
from .fixtures import LABELLED_SQL, labelled, table


def train_v3(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features.train_v3(labelled(spark, sf_dir))
    return rounded(f, **{c: c for c in FEATURES_V3})


TRAIN_V3 = f"""WITH {LABELLED_SQL}, x AS (SELECT *, CAST(duration AS DOUBLE) AS d, CAST(total_fwd_packets AS DOUBLE) AS f, CAST(total_bwd_packets AS DOUBLE) AS b FROM labelled),
y AS (SELECT *, f + b AS n, log10(greatest(d, 1.0)) AS l, d / 1e6 AS s FROM x)
SELECT CAST(dest_port AS DOUBLE) AS dest_port, d AS duration, f AS total_fwd_packets, b AS total_bwd_packets, n AS total_packets, round(n / (CASE WHEN d = 0 THEN 1 ELSE d END / 1e6), 6) AS flow_packets_per_sec,
  round(d / 1000.0, 6) AS duration_ms, round(f / (b + 1), 6) AS fwd_bwd_ratio, round(b / CASE WHEN f = 0 THEN 1 ELSE f END, 6) AS pkt_ratio, CAST(b > 0 AS DOUBLE) AS has_response, flow_iat_mean,
  CAST(d > 1e6 AS DOUBLE) AS is_long_connection, round(l, 6) AS log_duration, round(n / CASE WHEN l = 0 THEN 1 ELSE l END, 6) AS pkts_per_duration, round(s, 6) AS acc_age,
  CAST(greatest(ceil(s / 30.0), 1) AS DOUBLE) AS n_flushes, round(log10(greatest(s, 1e-6) + 1), 6) AS log_acc_age FROM y"""


def train_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [c for c in FEATURES_V2 if c not in ("flow_packets_per_sec", "down_up_ratio")]
    return rounded(features.train_v2(labelled(spark, sf_dir)), **{c: c for c in names})


TRAIN_V2 = f"""WITH {LABELLED_SQL}, x AS (SELECT *, CAST(total_fwd_bytes AS DOUBLE) / CASE WHEN total_fwd_packets = 0 THEN 1 ELSE total_fwd_packets END AS fp,
  CAST(total_bwd_bytes AS DOUBLE) / CASE WHEN total_bwd_packets = 0 THEN 1 ELSE total_bwd_packets END AS bp, CAST(total_fwd_packets + total_bwd_packets AS DOUBLE) AS n FROM labelled)
SELECT CAST(dest_port AS DOUBLE) AS dest_port, CAST(duration AS DOUBLE) AS duration, CAST(total_fwd_packets AS DOUBLE) AS total_fwd_packets, CAST(total_bwd_packets AS DOUBLE) AS total_bwd_packets, n AS total_packets,
  round(CAST(total_fwd_packets AS DOUBLE) / (total_bwd_packets + 1), 6) AS fwd_bwd_ratio, round(duration / 1000.0, 6) AS duration_ms, round(fp, 6) AS fwd_bytes_per_pkt, round(bp, 6) AS bwd_bytes_per_pkt,
  round(fp / (bp + 1), 6) AS bytes_ratio, round(fp / (bp + 1), 6) AS pkt_size_ratio, round((total_fwd_bytes + total_bwd_bytes) / CASE WHEN n = 0 THEN 1 ELSE n END, 6) AS flow_bytes_per_pkt FROM x"""

CLEAN_COLUMNS = ["dest_port", "duration", "total_fwd_packets", "total_bwd_packets", "flow_iat_mean"]


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes, infinities and NaN nulled, medians filled in, rows distinct."""
    raw = labelled(spark, sf_dir).select(*CLEAN_COLUMNS, "Label")
    odd = F.when(F.col("flow_iat_mean") == 5, float("inf")).when(F.col("flow_iat_mean") == 6, float("nan")).otherwise(F.col("flow_iat_mean"))
    out = clean.clean(raw.withColumn("flow_iat_mean", odd), ["flow_iat_mean"])
    return out.select(*CLEAN_COLUMNS, "Label")


CLEANED = f"""WITH {LABELLED_SQL}, a AS (SELECT dest_port, duration, total_fwd_packets, total_bwd_packets, CASE WHEN flow_iat_mean IN (5, 6) THEN NULL ELSE flow_iat_mean END AS flow_iat_mean, "Label" FROM classed WHERE "Label" IS NOT NULL)
SELECT DISTINCT dest_port, duration, total_fwd_packets, total_bwd_packets, coalesce(flow_iat_mean, (SELECT median(flow_iat_mean) FROM a)) AS flow_iat_mean, "Label" FROM a"""


def class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = clean.class_distribution(clean.normalise_labels(labelled(spark, sf_dir)))
    return rounded(out, "Label", "n", percent="percent")


CLASS_COUNTS = f"""WITH {LABELLED_SQL} SELECT "Label", count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS percent FROM classed WHERE "Label" IS NOT NULL GROUP BY 1"""


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "DoS").when(F.col("event_type") == "signup", "PortScan").otherwise("Benign")
    return table(spark, sf_dir, "events").select("event_id", kind.alias("Label"))


_KEY = "(event_id * 2654435761) % 2147483647"
_EVENTS = f"""e AS (SELECT event_id, CASE event_type WHEN 'error' THEN 'DoS' WHEN 'signup' THEN 'PortScan' ELSE 'Benign' END AS "Label", {_KEY} AS k FROM events)"""


def balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4 with an arithmetic order, so that SQL picks the same rows."""
    return clean.balance(_events(spark, sf_dir), "DoS", 0.5, F.expr(_KEY).cast("long"))


BALANCED = f"""WITH {_EVENTS}, b AS (SELECT *, row_number() OVER (PARTITION BY "Label" ORDER BY k) AS r FROM e)
SELECT event_id, "Label" FROM b WHERE "Label" = 'DoS' OR ("Label" = 'Benign' AND r <= CAST(floor(0.5 * (SELECT count(*) FROM e WHERE "Label" = 'DoS')) AS BIGINT))"""


def split(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = clean.stratified_split(_events(spark, sf_dir), key=F.expr(_KEY).cast("long"))
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


SPLIT = f"""WITH {_EVENTS}, b AS (SELECT *, row_number() OVER (PARTITION BY "Label" ORDER BY k) AS r, count(*) OVER (PARTITION BY "Label") AS n FROM e)
SELECT event_id, "Label", CASE WHEN r <= CAST(floor(n * 0.2 + 0.5) AS BIGINT) THEN 'test' ELSE 'train' END AS part FROM b"""


def binary_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = clean.binary_task(clean.normalise_labels(labelled(spark, sf_dir)), "DoS")
    return out.groupBy("Label", "target").agg(F.count("*").alias("n"))


BINARY_ROWS = f"""WITH {LABELLED_SQL} SELECT "Label", CAST("Label" = 'DoS' AS INTEGER) AS target, count(*) AS n FROM classed WHERE "Label" IN ('Benign', 'DoS') GROUP BY 1, 2"""


def scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1: population deviation; a constant column scales by 1."""
    rows = labelled(spark, sf_dir).withColumn("constant", F.lit(3.0))
    names = ["duration", "total_fwd_packets", "constant"]
    return rounded(scoring.scaled(rows, scoring.scaler(rows, names)), "dest_port", digits=4, duration="duration", total_fwd_packets="total_fwd_packets", constant="constant")


SCALED = f"""WITH {LABELLED_SQL}, m AS (SELECT avg(duration) AS a, stddev_pop(duration) AS b, avg(total_fwd_packets) AS c, stddev_pop(total_fwd_packets) AS d FROM labelled)
SELECT dest_port, round((duration - a) / b, 4) AS duration, round((total_fwd_packets - c) / d, 4) AS total_fwd_packets, 0.0::DOUBLE AS constant FROM labelled, m"""


def weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scoring.class_weights(clean.binary_task(clean.normalise_labels(labelled(spark, sf_dir)), "PortScan"))
    return rows.groupBy("target").agg(F.count("*").alias("n"), F.round(F.max("weight"), 6).alias("weight"))


WEIGHTED = f"""WITH {LABELLED_SQL} SELECT CAST("Label" = 'PortScan' AS INTEGER) AS target, count(*) AS n, round(sum(count(*)) OVER () / (2.0 * count(*)), 6) AS weight
  FROM classed WHERE "Label" IN ('Benign', 'PortScan') GROUP BY 1"""

QUERIES = {
    "features_train_v3": (train_v3, TRAIN_V3), "features_train_v2": (train_v2, TRAIN_V2), "cleaned_rows": (cleaned, CLEANED), "class_distribution": (class_counts, CLASS_COUNTS), "balanced_classes": (balanced, BALANCED),
    "stratified_split": (split, SPLIT), "binary_task": (binary_rows, BINARY_ROWS), "scaled_features": (scaled, SCALED), "class_weights": (weighted, WEIGHTED),
}
