"""All queries outside the training-data operators, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import audit_queries, linkage_queries, text_queries

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = linkage_queries.QUERIES | text_queries.QUERIES | audit_queries.QUERIES
ORACLE: dict[str, str] = linkage_queries.ORACLE | text_queries.ORACLE | audit_queries.ORACLE
FLAGSHIP: Query = linkage_queries.entity_resolution
