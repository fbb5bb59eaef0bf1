"""Corpus pipeline: quality classifier, line dedup, near-duplicate groups, suffix-array
dedup and packing, each over all that the stage before kept.

Part of the text operators: without ``tidewatch.llm`` this module cannot be imported.
Each stage takes (spark, docs, sf_dir) and returns the columns of documents, the last the
packed pieces.  ``n_chars`` is renewed where the text changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.lineage import cut as written
from tidewatch.llm import line_dedup, ngram_join, packing, quality_classifier, suffix_dedup
from tidewatch.llm.queries import VOCABULARY, documents
from tidewatch.llm.spark_util import cut
from tidewatch.shipping import ship

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones, keeps: each row by its own verdict."""
    verdicts = quality_classifier.classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), carry=tuple(COLUMNS))
    return verdicts.filter("kept").select(*[F.col(f"_{c}").alias(c) for c in COLUMNS])


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without multi-line chunks that occurred before; emptied documents go."""
    out = line_dedup.line_dedup(docs, carry=("lang", "source", "n_chars"))
    return (
        out.filter((F.col("n_removed") == 0) | (F.length("kept_text") > 0))
        .select(F.col("id").alias("doc_id"), F.col("kept_text").alias("text"), "lang", "source", F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))
        .select(COLUMNS)
    )


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked at five-word similarity 0.8 or more the row with the smallest id.

    Null ids come last; rows with the same id and group are ordered by a hash of their
    values.  Of equal rows one stays.  Documents without words have no links and all stay.
    """
    read = cut(docs.withColumn("row_id", F.monotonically_increasing_id()))
    groups = ngram_join.ngram_components(read, size=5, percent=80, id_col="row_id").select(F.col("id").alias("row_id"), F.col("component_id").alias("group"))
    firsts = groups.join(read.select("row_id", "doc_id", F.xxhash64(*COLUMNS).alias("key")), "row_id")
    firsts = firsts.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key", "row_id")).alias("first"))
    return read.join(firsts.select("first.row_id"), "row_id", "left_semi").select(COLUMNS)


def without_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without 200-byte strings that also start earlier; emptied documents go."""
    out = suffix_dedup.suffix_dedup(docs, keep_first=True, carry=("lang", "source", "n_chars"))
    whole = F.make_valid_utf8(F.col("kept").cast("string"))  # a cut may split a character
    return (
        out.filter((F.col("n_removed") == 0) | (F.octet_length("kept") > 0))
        .select(F.col("id").alias("doc_id"), whole.alias("text"), "lang", "source", F.when(F.col("n_removed") > 0, F.length(whole).cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))
        .select(COLUMNS)
    )


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens."""
    out = packing.pack_documents(docs, VOCABULARY, size=1024)
    return out.select(F.col("id").alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality_classifier", good_documents),
    ("line_dedup", without_repeated_lines),
    ("ngram_join", one_of_each_group),
    ("suffix_dedup", without_repeated_strings),
    ("packing", packed),
]

#: The stages train models, hash and encode: SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written, and read by the next one."""
    ship(spark)
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
