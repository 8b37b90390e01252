"""Exact dedup: two-pass Bloom filtering.

Pass one shuffles only the hash of each text and builds a filter of the hashes that occur at least twice (see ``KeyFilter``). Pass
two splits the rows: a row whose hash isn't in the filter has no copy and passes straight through; the others shuffle by text and
one of each group stays. The filter has ``limit`` bytes at most; beyond 12 bits for each repeated text it gets fuller and more rows
shuffle than need to, with the same plan and result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from .common import FILTER_LIMIT, KeyFilter, col, fresh, text_hash


def _orderable(kind: DataType) -> bool:
    if isinstance(kind, StructType):
        return all(_orderable(f.dataType) for f in kind.fields)
    if isinstance(kind, ArrayType):
        return _orderable(kind.elementType)
    return not isinstance(kind, MapType) and kind.typeName() not in ("variant", "interval", "calendarinterval", "geometry", "geography")


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", limit: int = FILTER_LIMIT) -> DataFrame:
    """One row for each distinct text, with all its columns.

    Of equal texts the row with the smallest doc_id stays (a null doc_id is the largest; the other columns break ties; of rows
    that are the same throughout, one stays). Texts are compared whole and byte for byte. A null text equals no other: all
    such rows stay. The empty text is a text like any other. An empty table gives an empty table.
    """
    h, flag, row, order = fresh(docs, "h", "flag", "row", "order")
    hashed = docs.withColumn(h, F.when(col(text).isNotNull(), F.xxhash64(col(text))))
    seen = KeyFilter(docs.select(F.when(col(text).isNotNull(), F.xxhash64(col(text))).alias("k")), repeated=True, limit=limit)
    ties = [col(f.name) for f in docs.schema.fields if _orderable(f.dataType) and f.name not in (text, doc_id)]
    key = [col(doc_id).isNull(), col(doc_id), *ties]

    def first(rows: DataFrame) -> DataFrame:
        others = [c for c in docs.columns if c != text]
        best = rows.groupBy(h, col(text)).agg(F.min_by(F.struct(*[col(c) for c in others]), F.struct(*key)).alias(row))
        return best.select(*[col(text) if c == text else F.col(row)[c].alias(c) for c in docs.columns])

    marked = hashed.withColumn(flag, seen.holds(F.col(h)))
    return marked.where(~F.col(flag)).drop(h, flag).unionByName(first(marked.where(F.col(flag))))


__all__ = ["exact_dedup", "text_hash"]
