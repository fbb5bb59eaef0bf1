"""The registered queries of the numbered operators: each applies one to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, language_id, lexical_search, line_dedup, ngram_join, oracle, packing, quality_classifier, quality_rules, sharding, substring_dedup, suffix_dedup, vector_codes

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = sharding.byte_prefix_shards(documents(spark, sf_dir), n_shards=24)
    return shards.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ngram_join.ngram_components(documents(spark, sf_dir), size=3, percent=90)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History: the lower half of the id range, as if it had been taken in before."""
    docs = documents(spark, sf_dir)
    bounds = docs.agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).first()
    old = F.coalesce(F.col("doc_id") <= ((bounds["a"] or 0) + (bounds["b"] or 0)) // 2, F.lit(False))
    out = exact_dedup.exact_dedup(docs.filter(old), docs.filter(~old))
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.substring_dedup(documents(spark, sf_dir))
    return out.select(F.col("id").alias("doc_id"), F.col("n_elements").alias("n_words"), "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack_documents(documents(spark, sf_dir), VOCABULARY, size=1024)
    return out.select(F.col("id").alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.host_quality_rules(documents(spark, sf_dir))
    return out.select(F.col("id").alias("doc_id"), *quality_rules.FIGURES, "base_failed", "kept")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.suffix_dedup(documents(spark, sf_dir))
    return out.select(F.col("id").alias("doc_id"), F.col("n_elements").alias("n_bytes"), "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(documents(spark, sf_dir))
    return out.select(F.col("id").alias("doc_id"), "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_classifier.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select(F.col("id").alias("doc_id"), "n_symbols", "perplexity", "shrunk", "upper", "lower", "evidence", "evidence_limit", "kept")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(documents(spark, sf_dir), VOCABULARY).withColumnRenamed("id", "doc_id")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.ranked_search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), k=50)


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = vector_codes.product_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return out.select(F.col("id").alias("vec_id"), "code", "error", "label_error", "codebooks_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_sharding, op2_ngram_join, op3_exact_dedup, op4_substring_dedup, op5_packing, op6_quality_rules, op7_suffix_dedup, op8_line_dedup, op9_quality_classifier, op10_bpe, op11_lexical_search, op12_language_id, op13_vector_codes)}


def oracle_sql() -> dict[str, str]:
    """The others are tested against plain Python (``tests/llm``)."""
    return {"op1_sharding": oracle.OP1, "op3_exact_dedup": oracle.OP3, "op4_substring_dedup": oracle.OP4, "op6_quality_rules": oracle.OP6, "op11_lexical_search": oracle.OP11, "op12_language_id": oracle.OP12, "op13_vector_codes": oracle.OP13}
