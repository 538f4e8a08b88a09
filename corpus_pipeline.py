"""Corpus pipeline: each stage calls one text operator and works on all that the stage before it kept.

Stages take (spark, docs, sf_dir) and return a DataFrame; run() writes each result as Parquet into the shared
checkpoint folder and reads it again as the next stage's docs. All but the last return the columns of documents; the
last returns (doc_id, n_tokens, ids).

Defined results: documents without any word are judged for quality and contamination like others and stay in the
stages that look for duplicates; ids may be null or clash, each row is judged by its own text; of repeated rows (one id,
one text) one stays; empty tables give empty results; the benchmark and labels are read from sf_dir; further columns of
any name pass through each stage but the last.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, decontaminate, jaccard, quality, substrings
from tidemark.llm.queries import BATCH_ROWS, vocabulary
from tidemark.llm.store import checkpoint_folder, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents that the quality classifier rejects (a score below 0.3); null and empty texts are scored too."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates (five words, a similarity of 0.8 or more): the one of the
    smallest id, null ids last. Texts without words are in no group and stay."""
    return jaccard.survivors(docs)


def repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts each byte of a 200-byte string that occurs twice or more, every occurrence, as the operator defines it;
    documents of which nothing is left go, other texts stay as they are."""
    return substrings.cut_texts(docs)


def benchmark_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with hit words that make up at least one in twenty of their words; without words none is hit."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of each row; null and empty texts have none."""
    return bpe.encode(docs, vocabulary())


STAGES = [
    ("quality_filter", quality_filter),
    ("near_duplicates", near_duplicates),
    ("repeated_substrings", repeated_substrings),
    ("benchmark_filter", benchmark_filter),
    ("encoded", encoded),
]

#: The stages learn, cluster and tokenize: SQL can't express them; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
