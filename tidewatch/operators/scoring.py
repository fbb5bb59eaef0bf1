"""Scaling, ensemble decision, thresholds and reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed import DEFAULT_THRESHOLD, TASKS, TUNED_THRESHOLDS, WEIGHTS

#: 0.30 to 0.90 by 0.05.
THRESHOLDS = [round(0.05 * k, 2) for k in range(6, 19)]


def scaler(df: DataFrame, features: Sequence[str]) -> dict[str, tuple[float, float]]:
    """M1: mean and population deviation of each feature from one pass; constants scale by 1."""
    row = df.agg(*[f(F.col(c).cast("double")).alias(f"{n}_{c}") for c in features for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return {c: (row[f"m_{c}"] or 0.0, row[f"s_{c}"] or 1.0) for c in features}


def scaled(df: DataFrame, fitted: Mapping[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(c).cast("double") - m) / s for c, (m, s) in fitted.items()})


def class_weights(df: DataFrame, target: str = "target") -> DataFrame:
    """M5: ``weight`` n / (2 n_c) of each row's class."""
    counts = {r[target]: r["count"] for r in df.groupBy(target).count().collect()}
    n = sum(counts.values())
    pairs = [F.lit(x) for t, c in counts.items() if t is not None for x in (t, n / (2.0 * c))]
    return df.withColumn("weight", F.element_at(F.create_map(*pairs), F.col(target)) if pairs else F.lit(1.0))


def ensemble(dt: Column, rf: Column, xgb: Column) -> Column:
    """M12."""
    return WEIGHTS["dt"] * dt + WEIGHTS["rf"] * rf + WEIGHTS["xgb"] * xgb


def decide(df: DataFrame, thresholds: Mapping[str, float] = TUNED_THRESHOLDS, default: float = DEFAULT_THRESHOLD, tasks: Sequence[str] = TASKS, v2: bool = False) -> DataFrame:
    """One-vs-rest decision from columns ``{task}_{dt|rf|xgb}``.

    Only the best task's threshold counts; of equal scores the first task is best.  v2
    takes 0.5 for all.  A null probability makes the row Unknown, with null confidence
    (v2: 0).  Adds ``{task}_score``, best_label, is_attack, predicted_class, confidence,
    model_conf, and votes at 0.5 (Benign throughout where v2 finds no attack).
    """
    df = df.withColumns({f"{t}_score": ensemble(*[F.col(f"{t}_{m}") for m in WEIGHTS]) for t in tasks})
    known = F.lit(True)
    for t in tasks:
        known = known & F.col(f"{t}_score").isNotNull()
    top = F.greatest(*[F.col(f"{t}_score") for t in tasks]) if len(tasks) > 1 else F.col(f"{tasks[0]}_score")
    best, limit = F.lit(None).cast("string"), F.lit(default)
    for t in reversed(tasks):
        best = F.when(F.col(f"{t}_score") == top, F.lit(t)).otherwise(best)
    if not v2 and thresholds:
        limit = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in thresholds.items() for x in kv]), F.col("best_label")), F.lit(default))
    df = df.withColumns({"_known": known, "_top": top, "best_label": F.when(known, best)})
    df = df.withColumn("is_attack", F.coalesce(F.col("_known") & (F.col("_top") >= limit), F.lit(False)))
    chosen = lambda m: F.coalesce(*[F.when(F.col("best_label") == t, F.col(f"{t}_{m}")) for t in tasks])
    df = df.withColumns({f"_{m}": chosen(m) for m in WEIGHTS})
    vote = lambda m: F.when((F.col(f"_{m}") >= 0.5) & (F.col("is_attack") if v2 else F.lit(True)), F.col("best_label")).otherwise("Benign")
    return df.withColumns({
        "predicted_class": F.when(~F.col("_known"), "Unknown").when(F.col("is_attack"), F.col("best_label")).otherwise("Benign"),
        "confidence": F.when(F.col("_known"), F.when(F.col("is_attack"), F.col("_top")).otherwise(1.0 - F.col("_top"))).otherwise(F.lit(0.0 if v2 else None).cast("double")),
        "model_conf": F.when(F.col("_known"), F.struct(*[F.col(f"_{m}").alias(m) for m in WEIGHTS])),
        **{f"{m}_vote": F.when(F.col("_known"), vote(m)) for m in WEIGHTS},
    }).drop("_known", "_top", *[f"_{m}" for m in WEIGHTS])


def detector_result(decided: DataFrame, tasks: Sequence[str] = TASKS) -> DataFrame:
    """The fixed result shape; statistical and behavioural parts are placeholders."""
    best = F.greatest(*[F.col(f"{t}_score") for t in tasks])
    return decided.withColumns({
        "proba_per_class": F.create_map(*[x for t in tasks for x in (F.lit(t), F.col(f"{t}_score"))], F.lit("Benign"), 1.0 - best),
        "model_votes": F.create_map(*[x for m in WEIGHTS for x in (F.lit(m), F.col(f"{m}_vote"))]),
        "stat_result": F.struct(F.lit(False).alias("enabled")), "behavioral_result": F.struct(F.lit(False).alias("enabled")),
    })


def confusion(df: DataFrame, predicted: Column, target: Column) -> DataFrame:
    """Tn, fp, fn, tp."""
    cell = lambda t, p: F.count_if((target == t) & (predicted == p))
    return df.agg(cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(1, 1).alias("tp"))


def _ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def report(df: DataFrame, predicted: str, target: str) -> DataFrame:
    """M9: precision, recall, f1, support per class (0, 1), accuracy, macro and weighted means."""
    c = confusion(df, F.col(predicted), F.col(target))
    line = lambda name, hit, false, missed: F.struct(F.lit(name).alias("class"), _ratio(hit, hit + false).alias("precision"), _ratio(hit, hit + missed).alias("recall"), (hit + missed).alias("support"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    rows = c.select(F.explode(F.array(line("0", tn, fn, fp), line("1", tp, fp, fn))).alias("r"), ((tp + tn).cast("double")).alias("right")).select("r.*", "right")
    rows = rows.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    n = F.sum("support")
    mean = lambda x: (F.sum(x) / 2).alias(x)
    weighted = lambda x: _ratio(F.sum(F.col(x) * F.col("support")), n).alias(x)
    names = ["precision", "recall", "f1"]
    accuracy = _ratio(F.max("right"), n)
    out = rows.select("class", *names, "support")
    out = out.unionByName(rows.agg(F.lit("accuracy").alias("class"), *[accuracy.alias(x) for x in names], n.alias("support")))
    out = out.unionByName(rows.agg(F.lit("macro avg").alias("class"), *[mean(x) for x in names], n.alias("support")))
    return out.unionByName(rows.agg(F.lit("weighted avg").alias("class"), *[weighted(x) for x in names], n.alias("support")))


def threshold_table(df: DataFrame, score: str, target: str, thresholds: Sequence[float] = tuple(THRESHOLDS)) -> DataFrame:
    """f1 at each threshold.

    A row counts for the highest threshold it reaches, once; running sums over the few
    thresholds give the counts, so rows are not multiplied by the thresholds.
    """
    ladder = F.array(*[F.lit(float(t)) for t in thresholds])
    reached = F.size(F.filter(ladder, lambda t: F.col(score) >= t))
    counts = df.groupBy(reached.alias("level")).agg(F.count_if(F.col(target) == 1).alias("p"), F.count_if(F.col(target) == 0).alias("q"))
    spark = df.sparkSession
    steps = spark.createDataFrame([(i + 1, float(t)) for i, t in enumerate(thresholds)] + [(0, None)], "level int, threshold double")
    above = Window.orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy()
    table = steps.join(counts, "level", "left").fillna(0, ["p", "q"])
    table = table.withColumns({"tp": F.sum("p").over(above), "fp": F.sum("q").over(above), "positives": F.sum("p").over(everything)})
    return table.filter("threshold is not null").select("threshold", "tp", "fp", (F.col("positives") - F.col("tp")).alias("fn"), _ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("positives") - F.col("tp")).alias("f1"))


def best_threshold(table: DataFrame, default: float = DEFAULT_THRESHOLD) -> DataFrame:
    """The lowest threshold with the highest f1; ``default`` where every f1 is 0."""
    best = F.max_by("threshold", F.struct("f1", -F.col("threshold")))
    return table.agg(F.when(F.max("f1") > 0, best).otherwise(F.lit(default)).alias("threshold"), F.max("f1").alias("f1"))


def cv_gap(metrics: DataFrame, least: float = 0.01) -> DataFrame:
    """|cv - test| of each model, flagged above ``least``."""
    gap = F.abs(F.col("cv_f1") - F.col("test_f1"))
    return metrics.withColumns({"gap": gap, "overfit": gap > least})
