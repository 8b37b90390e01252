"""Queries of the training-data operators, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, fingerprints, language_id, line_dedup, merge_replay, near_dedup, packing, simple8b, suffix_dedup, token_counts

Query = Callable[[SparkSession, str], DataFrame]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simple8b.encode_documents(documents(spark, sf_dir))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.links(documents(spark, sf_dir))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_spans(documents(spark, sf_dir)).drop("h")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.groups(documents(spark, sf_dir))
    keep = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("h") == F.col("keep_h"))
    return found.select("doc_id", F.col("keep_id").alias("group_id"), keep.alias("keep"), "group_size")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(documents(spark, sf_dir))


def op6_merge_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_replay.encode_documents(documents(spark, sf_dir))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(documents(spark, sf_dir))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.section_tokens(documents(spark, sf_dir))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return language_id.identify(docs, language_id.fit(docs))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_simple8b,
        op2_fingerprints,
        op3_suffix_dedup,
        op4_near_dedup,
        op5_line_dedup,
        op6_merge_replay,
        op7_exact_dedup,
        op8_best_fit_packing,
        op9_token_counts,
        op10_language_id,
    )
}

ORACLE: dict[str, str] = {
    "op7_exact_dedup": """
        SELECT doc_id, text, lang, source, n_chars FROM (
            SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id NULLS LAST, lang NULLS FIRST, source NULLS FIRST, n_chars NULLS FIRST) AS rn
            FROM documents)
        WHERE rn = 1 OR text IS NULL""",
}
