"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, conversations, decontaminate, jaccard, language, licenses, mixing, passages, quality, rules, spelling, substrings, urls
from .store import table

#: Rows of an Arrow batch: long texts would make the default batch too large for a small worker.
BATCH_ROWS = "2000"


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return table(spark, sf_dir, "documents")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(documents(spark, sf_dir), vocabulary(), ids=False, digests=True)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.without_repeats(documents(spark, sf_dir))


def op4_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.near_duplicate_passages(documents(spark, sf_dir))


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return urls.judge(table(spark, sf_dir, "pages"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(documents(spark, sf_dir))


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(documents(spark, sf_dir), n=4, percent=85).withColumnRenamed("n_grams", "n_shingles")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir)).drop("spans")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(documents(spark, sf_dir))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return decontaminate.decisions(found).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), decontaminate.items_digest(F.col("items")).alias("items_sha256"), "contaminated"
    )


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return conversations.damaged_report(table(spark, sf_dir, "conversations"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(documents(spark, sf_dir))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(documents(spark, sf_dir))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_bpe, op2_quality, op3_substrings, op4_passages, op5_urls, op6_language, op7_jaccard, op8_licenses, op9_quality_rules, op10_decontaminate, op11_conversations, op12_spelling, op13_mixing, pipeline)}


def oracle_sql() -> dict[str, str]:
    from .oracles import ORACLES

    return ORACLES
