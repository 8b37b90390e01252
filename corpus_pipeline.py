"""The corpus pipeline: language ID, exact dedup, near dedup, repeated passages, packing.

Every stage takes documents with nulls in any column, empty and very long texts, repeated rows, ties, ids of any type with an order
and further columns of any name, which it keeps; of no documents it makes none.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kinweave.llm import exact_dedup, language_id, near_dedup, packing, suffix_dedup
from kinweave.llm.common import delete, shared_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents that no language's profile accepts go, null and empty texts and those without letters among them.

    Repeated rows are judged each; texts are read whole. With no labelled row there is no profile, and all go.
    """
    return language_id.accept(docs, language_id.fit(docs))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup: of equal texts the one with the smallest doc_id stays, a null doc_id being the largest and the other columns
    breaking ties. Null texts equal nothing and stay."""
    return exact_dedup.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near dedup: of each group of near copies the document with the smallest doc_id stays, a null doc_id being the largest
    and the text's hash deciding between equals; a repeated row stays once. Texts without words have no near copies and stay."""
    return near_dedup.near_dedup(docs)


def delete_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Suffix-array dedup: passages of 50 words or more that occur before are deleted, in order of doc_id; the documents stay with what
    is left of them, and one of which nothing is left goes. Null, empty and short texts stay as they are."""
    return suffix_dedup.suffix_dedup(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing into sequences of 2048 tokens: one row for each piece of a document. Null and empty texts have no piece; a very
    long text has many."""
    return packing.best_fit_packing(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language", keep_languages),
    ("exact", drop_copies),
    ("near", drop_near_copies),
    ("repeats", delete_repeats),
    ("packing", pack),
]

#: None: packing, near dedup and rank-order profiles can't be put in SQL; tests hold run() against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written to the shared folder and read again. A stage's table goes once the next one's is
    written, the last one's when the driver ends."""
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{i}-{name}")
            docs = spark.read.parquet(f"{folder}/{i}-{name}")
            if i:
                delete(spark, f"{folder}/{i - 1}-{STAGES[i - 1][0]}")
    atexit.register(delete, spark, folder)
    return docs
