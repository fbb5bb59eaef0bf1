"""The pipeline's stages, one after another, on the smallest tables."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

import brute  # noqa: E402

import corpus_pipeline
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = corpus_pipeline.documents(spark, SF)
    seen = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF).cache()
        assert out.columns == corpus_pipeline.COLUMNS, name
        rows = {r["doc_id"]: r["text"] for r in out.collect()}
        assert rows.keys() <= seen.keys() and len(rows) > 0.4 * len(seen)
        if name == "quality_classifier":
            bad = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 0").collect()}
            good = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1 and toxic = 0").collect()}
            assert len(good & rows.keys()) >= 0.95 * len(good & seen.keys()) and len(bad & rows.keys()) < 0.5 * len(bad & seen.keys())
        if name == "ngram_join":
            want = brute.components(sorted(seen.items()), 5, 80)
            assert rows.keys() == {i for i, (_, c) in want.items() if c == i}
        if name == "suffix_dedup":
            assert not any(n for _, n, *_ in (brute.suffixes(sorted(rows.items()))[i] for i in rows))
        docs, seen = out, rows
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r["doc_id"] for r in last.select("doc_id").distinct().collect()} == seen.keys()


def test_near_copies_without_ids_or_with_one_id(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(None, text), (3, text), (3, text + " end"), (8, text), (None, "other words"), (None, "other words"), (5, "alone"), (6, ""), (7, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = [(r["doc_id"], r["text"]) for r in corpus_pipeline.one_of_each_group(spark, docs, SF).collect()]
    assert sorted(i or 0 for i, _ in out) == [0, 3, 5, 6, 7] and (None, "other words") in out


def test_rows_are_kept_by_their_own_verdict(spark, monkeypatch):
    rows = [(None, "bad"), (1, "bad"), (1, "good"), (None, "good")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    real = corpus_pipeline.quality_classifier.classify
    monkeypatch.setattr(corpus_pipeline.quality_classifier, "classify", lambda *a, **k: real(*a, **k).withColumn("kept", F.col("n_symbols") != 3))
    out = corpus_pipeline.good_documents(spark, docs, SF).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in out) == [(0, "good"), (1, "good")]
