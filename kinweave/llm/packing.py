"""Best-fit packing with certified repacking.

Documents become pieces of at most ``CAPACITY`` tokens (a longer document fills whole sequences and leaves a rest) and pieces
become sequences of at most ``CAPACITY``. Partitions pack their own pieces by best-fit decreasing. Each then computes a lower
bound on its number of sequences from dual-feasible functions; where the bound is met, the partition is certified to be packed
with the fewest sequences possible and is done. Partitions with a gap keep their full sequences and exchange the documents of
the others: these are dealt out anew to half as many partitions and packed again, and the round stands if the number of
sequences falls. After ``ROUNDS`` rounds, or when all partitions are certified, what is left is as it is; ``certify`` tells how
far that is from the bound over all.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import DEFAULT_VOCABULARY, encoder
from .common import bytes_of, col, cut, pieces, ranks, released, small_batches, text_hash

#: Tokens of a sequence, pieces of a partition about, and exchange rounds at most.
CAPACITY, PARTITION_PIECES, ROUNDS = 2048, 200_000, 3


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item: items by decreasing size, each to the fullest bin that it fits in, the first opened of equals."""
    order = np.argsort(-sizes, kind="stable")
    out = np.empty(len(sizes), np.int64)
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]  # by free room: bins, last opened first
    free: list[int] = []  # rooms that have bins, sorted
    n = 0
    for i, size in zip(order.tolist(), sizes[order].tolist()):
        at = bisect_left(free, size)
        if at == len(free):
            bin_, room = n, capacity
            n += 1
        else:
            room = free[at]
            bin_ = rooms[room].pop()
            if not rooms[room]:
                del free[at]
        out[i] = bin_
        room -= size
        if room:
            if not rooms[room]:
                insort(free, room)
            rooms[room].append(bin_)
    return out


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Bins that any packing of items of these sizes needs (see ``lower_bound_of_histogram``)."""
    return lower_bound_of_histogram(np.bincount(sizes, minlength=capacity + 1), capacity)


def lower_bound_of_histogram(count: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs, by dual-feasible functions; count has the number of items of each size from 0 to capacity.

    f maps sizes to [0, 1] so that items that fit together sum to 1 at most; then the sum of f over all items, rounded up, is a
    bound. Used are the identity, Fekete and Schepers' u(k) (x if (k + 1) x is whole, else floor((k + 1) x) / k) for k to 20,
    and U(e) (1 above 1 - e, x from e to 1 - e, 0 below), for every e among the sizes up to a half. Whole numbers throughout: sums
    stay below 2**63 up to 10**11 items or so of 2048 tokens, above which Python's own take over.
    """
    count = count.astype(np.int64 if int(count.sum()) * 21 * capacity < 1 << 62 else object)
    x = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((count * x).sum()) // capacity)
    for k in range(1, 21):
        whole = (k + 1) * x % capacity == 0
        # both branches over the common denominator k * capacity
        value = np.where(whole, k * x, (k + 1) * x // capacity * capacity)
        best = max(best, -(-int((count * value).sum()) // (k * capacity)))
    above = np.concatenate([np.cumsum(count[::-1])[::-1], [0]])  # items of size >= i
    mass = np.concatenate([[0], np.cumsum(count * x)])
    e = np.arange(1, capacity // 2 + 1)
    bounds = above[capacity - e + 1] * capacity + mass[capacity - e + 1] - mass[e]
    return max([best, *(-(-int(v) // capacity) for v in bounds)])


def token_pieces(docs: DataFrame, text: str, doc_id: str, capacity: int, vocabulary: str) -> DataFrame:
    """doc_id, h, piece, start, size: the pieces of each row; a map without shuffle."""
    kind = docs.schema[doc_id].dataType.simpleString()

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        for batch in batches:
            for part in pieces(batch, "t"):
                _, offs = encode(*bytes_of(part.column(2)))
                n = np.diff(offs)
                counts = -(-n // capacity)
                row = np.repeat(np.arange(len(n)), counts)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(take), part.column(1).take(take), pa.array(piece.astype(np.int32)), pa.array(piece * capacity), pa.array(np.minimum(n[row] - piece * capacity, capacity).astype(np.int32))],
                    ["doc_id", "h", "piece", "start", "size"],
                )

    return docs.select(col(doc_id).alias("d"), text_hash(text).alias("h"), col(text).alias("t")).mapInArrow(run, f"doc_id {kind}, h bigint, piece int, start bigint, size int")


def _pack(rows: DataFrame, capacity: int) -> DataFrame:
    """Pack every part (column part) for itself; adds bin, bins and bound."""

    def run(key, table):
        sizes = table.column("size").to_numpy().astype(np.int64)
        by = np.lexsort((table.column("piece").to_numpy(), table.column("h").to_numpy(), ranks(table.column("doc_id")), -sizes))
        table, sizes = table.take(pa.array(by)), sizes[by]
        own = best_fit_decreasing(sizes, capacity)
        n = int(own.max()) + 1
        room = capacity - np.bincount(own, weights=sizes).astype(np.int64)
        for name, values in (("bin", own), ("bins", np.full(len(own), n)), ("bound", np.full(len(own), lower_bound(sizes, capacity))), ("room", room[own])):
            table = table.append_column(name, pa.array(values, pa.int64()))
        return table

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields) + ", bin bigint, bins bigint, bound bigint, room bigint"
    return rows.groupBy("part").applyInArrow(run, schema)


def _totals(packed: DataFrame) -> tuple[int, int, int]:
    """Parts with a gap, bins of all parts, bins of parts with a gap."""
    r = packed.groupBy("part").agg(F.first("bins").alias("n"), F.first("bound").alias("b")).agg(F.count_if(F.col("n") > F.col("b")).alias("g"), F.sum("n").alias("n"), F.sum(F.when(F.col("n") > F.col("b"), F.col("n"))).alias("m")).first()
    return r.g or 0, r.n or 0, r.m or 0


def best_fit_packing(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY, partition_pieces: int = PARTITION_PIECES, rounds: int = ROUNDS, vocabulary: str = DEFAULT_VOCABULARY
) -> DataFrame:
    """sequence, position, doc_id, piece, start, size, used, bins, bound, certified for each piece of each row.

    sequence names the sequence (part and number), position the piece's first token in it, start its first token in the
    document, used the sequence's tokens; bins and bound are those of its part, certified tells that they are equal. No sequence
    exceeds ``capacity``, all tokens of all rows are packed once, and pieces that fill a sequence stand alone. Null and empty
    texts have no tokens and no piece; an empty table gives no rows. Repeated rows and null doc_ids (of any type; null is no other
    id) are packed like others, very long texts as many pieces. Ties go by size, doc_id (null last), hash of the text and piece, so
    the result doesn't depend on the order of the rows.
    """
    small_batches(docs.sparkSession)
    found = cut(token_pieces(docs, text, doc_id, capacity, vocabulary))
    n = found.where(F.col("size") < capacity).count()
    parts = max(1, -(-n // partition_pieces))
    # Full pieces need no packing; they make parts of their own, certified as they stand.
    full = found.where(F.col("size") == capacity).withColumn("part", F.concat(F.lit("f"), F.pmod(F.xxhash64("doc_id", "h"), F.lit(parts)).cast("string")))
    # A repeated row's pieces are sequences of their own.
    again = F.row_number().over(Window.partitionBy("doc_id", "h", "piece").orderBy("size"))
    own = F.when(F.col("again") == 1, F.xxhash64("doc_id", "h", "piece")).otherwise(F.xxhash64("doc_id", "h", "piece", "again"))
    full = full.withColumn("again", again).select(*full.columns, own.alias("bin"), F.lit(1).cast("bigint").alias("bins"), F.lit(1).cast("bigint").alias("bound"), F.lit(0).cast("bigint").alias("room"))
    rest = found.where(F.col("size") < capacity).withColumn("part", F.concat(F.lit("p"), F.pmod(F.xxhash64("doc_id", "h", "piece"), F.lit(parts)).cast("string")))
    now = cut(_pack(rest, capacity))
    done = []
    gaps, _, open_bins = _totals(now)
    stood = 0
    for r in range(rounds):
        if gaps < 1:
            break
        gap = now.where("bins > bound")
        # Sequences that are full stay; the documents of the others are dealt out again, to half as many parts each round.
        settled, loose = gap.where("room = 0"), gap.where("room > 0").select(*rest.columns)
        fewer = max(1, -(-gaps // 2 ** (r + 1 - stood)))
        dealt = loose.withColumn("part", F.concat(F.lit(f"r{r}-"), F.pmod(F.xxhash64("doc_id", "h", "piece", F.lit(r)), F.lit(fewer)).cast("string")))
        again = cut(_pack(dealt, capacity))
        new_gaps, new_bins, new_open = _totals(again)
        if settled.select("part", "bin").distinct().count() + new_bins >= open_bins:
            continue
        settled = settled.withColumn("bins", F.lit(1).cast("bigint")).withColumn("bound", F.lit(1).cast("bigint"))
        done += [now.where("bins = bound"), settled]
        now, gaps, open_bins, stood = again, new_gaps, new_open, r + 1
    out = now
    for d in [*done, full.select(*now.columns)]:
        out = out.unionByName(d)
    w = Window.partitionBy("part", "bin")
    first = w.orderBy(F.desc("size"), F.col("doc_id").asc_nulls_last(), "h", "piece").rowsBetween(Window.unboundedPreceding, -1)
    return out.select(
        F.concat_ws("/", "part", F.col("bin").cast("string")).alias("sequence"), F.coalesce(F.sum("size").over(first), F.lit(0)).cast("bigint").alias("position"),
        "doc_id", "piece", "start", F.col("size").cast("bigint").alias("size"), F.sum("size").over(w).cast("bigint").alias("used"), "bins", "bound", (F.col("bins") == F.col("bound")).alias("certified"),
    )


def certify(docs: DataFrame, packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """sequences, bound: how many sequences ``packed`` has, and the least that any packing of the same pieces needs.

    The bound is that of the histogram of all sizes, which has ``capacity`` entries for any corpus.
    """
    spark: SparkSession = packed.sparkSession
    sizes = {r["size"]: r.n for r in packed.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}
    flat = np.zeros(capacity + 1, np.int64)
    for s, n in sizes.items():
        flat[s] = n
    bound = lower_bound_of_histogram(flat, capacity)
    n = packed.select("sequence").distinct().count()
    return spark.createDataFrame([(n, bound)], "sequences bigint, bound bigint")


__all__ = ["best_fit_packing", "best_fit_decreasing", "certify", "lower_bound"]
