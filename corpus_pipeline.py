"""A training corpus in five stages, each one written as Parquet and read again as the next one's documents.

Each stage keeps the columns of ``documents``; where it changes a text, ``n_chars`` follows. The last one adds the token ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldweave.llm import byte_bpe, decontaminate, jaccard_join, line_dedup, quality
from fieldweave.llm.common import scratch_folder, table
from fieldweave.llm.learning import id_remainder

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def recounted(docs: DataFrame, before: DataFrame) -> DataFrame:
    """``docs`` in the columns of ``before``, with ``n_chars``, where there is one, counted anew."""
    if "n_chars" not in before.columns:
        return docs.select(*before.columns)
    return docs.withColumn("n_chars", F.length("text").cast(before.schema["n_chars"].dataType)).select(*before.columns)


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text the quality model accepts (score 0.5 or more), learnt from the labels of ``sf_dir``."""
    model = quality.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), id_remainder("doc_id", 3) != 1)
    return quality.keep_good(docs, model)


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without lines that an earlier place has, from 32 characters on up to two edits; documents that lose their last line go."""
    left = line_dedup.dedup_lines(docs, edits=2, least=32, least_equal=1)
    return recounted(left.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines"))), docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies (five words, similarity 0.8)."""
    return jaccard_join.one_of_each(docs, words=5, percent=80).select(*docs.columns)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without passages of ten words or more that a benchmark item has; documents that are mostly such passages go."""
    return recounted(decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), window=10, max_coverage=0.5), docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document: doc_id, number of ids, digest of the ids and of the text they decode to."""
    both = byte_bpe.decode(byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality", good_documents),
    ("line_dedup", fresh_lines),
    ("jaccard_join", one_of_each_group),
    ("decontaminate", clean_of_benchmark),
    ("byte_bpe", token_ids),
]
#: Trained models, edit distance joins and connected links are not SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        folder = scratch_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
