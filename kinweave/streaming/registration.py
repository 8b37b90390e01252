"""Documents that arrive one after another: each registered once, whatever the number of deliveries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.names import hash_id
from ..sources.tables import append_new


def arriving(rows: DataFrame, text: str = "text", at: str = "ts", late: str = "1 hour") -> DataFrame:
    """rows with doc_id (the hash of the text), less repeats within ``late`` of each other."""
    keyed = rows.withColumn("doc_id", hash_id(F.col(text)))
    return keyed.withWatermark(at, late).dropDuplicatesWithinWatermark(["doc_id"])


def register(rows: DataFrame, table: str, checkpoint: str, run_id: str) -> StreamingQuery:
    """Append what the table lacks, batch by batch; a batch that is delivered again adds nothing."""

    def upsert(batch: DataFrame, number: int) -> None:
        append_new(batch.withColumn("run_id", F.lit(run_id)), table, ["run_id", "doc_id"])

    return rows.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, at: str = "ts", kind: str = "event_type", width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events by window and type, for batch and stream alike; as a stream, those later than ``late`` are left out."""
    return events.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), kind).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("begins"), kind, "n", F.round("total", 4).alias("total"))
