"""Corpus preparation: documents pass five stages, each the whole of what its predecessor kept.

1. language ID: documents without a recognisable language go.
2. quality rules: documents that fail the base rules or the compression bands go.
3. n-gram Jaccard join: of each class of near duplicates the document with the smallest id stays.
4. secret scans: secrets in the texts are replaced by their kind in brackets; n_chars follows.
5. packing: the result, pieces of documents in token sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import compression, curve_packing, hyperdim, ngram_join, secret_scan
from tidemark.sources.scratch import scratch_folder

# Least cosine with some language by length of the text (characters from, cosine); documents below it go. Between the scores
# of held-out prose and those of random letters and base64 of the same length; see the README.
LEAST_LANGUAGE_SCORES = [(0, 0.08), (50, 0.18), (200, 0.2), (1000, 0.25), (3000, 0.3)]
TOKENIZER = "byte_bpe_50k.json"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = hyperdim.language_id(docs)
    least = F.lit(0.0)
    for length, score in LEAST_LANGUAGE_SCORES:
        least = F.when(F.length("text") >= length, F.lit(score)).otherwise(least)
    fine = (F.col("lang_pred") != hyperdim.UND) & (F.col("score") >= least)
    return found.where(fine).select(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return compression.quality(docs).where("kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without an id can't be told apart, so they stay."""
    found = ngram_join.near_duplicates(docs)
    first = found.where(F.col("doc_id") == F.col("class_id")).select("doc_id", F.col("digest").alias("_digest")).distinct()
    marked = docs.withColumn("_digest", F.xxhash64("text"))
    kept = marked.join(first, ["doc_id", "_digest"], "left_semi").dropDuplicates(["doc_id", "_digest"])
    return kept.select(*docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return curve_packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("language ID", language_id),
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secret_scans),
    ("packing", packing),
]
# Learned prototypes, tokens and bands of hashes are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage; each stage is written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_folder(spark, "pipeline")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
