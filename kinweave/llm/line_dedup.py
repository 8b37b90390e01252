"""Line dedup by pairwise alignment.

A line is rare if at least two and at most ``RARE`` different documents have it, however many there are in all. Documents that share a rare line, or
``RUN`` lines in a row however frequent, overlap: each later document is aligned with the earlier ones by patience diff: equal ends
are matched, then lines that occur once in either, in the longest order that both have, then the gaps likewise. A run of matched
lines that are adjacent in both is a common block; if it has a rare line or ``RUN`` lines that aren't blank, it is deleted from the
later document. The result is that of all pairs. First a document is aligned with the first holder of each of its keys (``keys``);
then those of whose shared lines some are left are aligned with all other holders of the keys of these lines, for only they can
delete them. Of equal lists of lines the first stands for all, and its copies are deleted by it.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, col, cut, fresh, join_keys, pieces, released, small_batches, split, text_hash
from .kernels import BYTE_HASH, SPACE, Two, span_hash

#: Different documents that have a rare line at most.
RARE = 20
#: So many lines in a row, blank ones not counted, are an overlap even if none of them is rare.
RUN = 3
_MASK = (1 << 63) - 1


def line_hashes(buf: np.ndarray, offs: np.ndarray) -> Two:
    """Hashes of the lines of all texts without white space at their ends (a blank line has 0), and the texts' offsets in them."""
    starts_at = np.zeros(len(buf) + 1, bool)
    starts_at[1:] = buf == 10
    starts_at[offs] = True
    starts = np.flatnonzero(starts_at)
    ends = np.append(starts[1:], len(buf))
    keep = starts < np.append(offs, len(buf))[np.searchsorted(offs, starts, "right")]
    # a text that ends with a line feed has an empty line after it, which no byte belongs to: left out
    starts, ends = starts[keep], ends[keep]
    inner = np.flatnonzero(~SPACE[buf])
    if not len(inner):
        return np.zeros(len(starts), np.uint64), np.searchsorted(starts, offs)
    a, b = np.searchsorted(inner, starts), np.searchsorted(inner, ends) - 1
    filled = b >= a
    s, e = np.where(filled, inner[np.minimum(a, len(inner) - 1)], 0), np.where(filled, inner[b] + 1, 0)
    h = span_hash(BYTE_HASH[buf], s, e)
    h[h == 0] = 1
    h[~filled] = 0
    return h, np.searchsorted(starts, offs)


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Matched places (in a, in b) of two lists, in order."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a: dict[int, int] = {}
        for i in range(a0, a1):
            in_a[a[i]] = -1 if a[i] in in_a else i
        in_b: dict[int, int] = {}
        for j in range(b0, b1):
            in_b[b[j]] = -1 if b[j] in in_b else j
        once = [(i, in_b[x]) for x, i in in_a.items() if x and i >= 0 and in_b.get(x, -1) >= 0]
        if not once:
            continue
        # the longest increasing subsequence of places in b, by patience sorting
        tails: list[int] = []
        last: list[int] = []
        before = [-1] * len(once)
        for k, (_, j) in enumerate(once):
            at = bisect_left(tails, j)
            if at == len(tails):
                tails.append(j)
                last.append(k)
            else:
                tails[at], last[at] = j, k
            before[k] = last[at - 1] if at else -1
        chain, k = [], last[-1]
        while k >= 0:
            chain.append(once[k])
            k = before[k]
        chain.reverse()
        out.extend(chain)
        edges = [(a0 - 1, b0 - 1), *chain, (a1, b1)]
        todo.extend((i + 1, i2, j + 1, j2) for (i, j), (i2, j2) in zip(edges, edges[1:]) if i + 1 < i2 and j + 1 < j2)
    return sorted(out)


def blocks(matched: list[tuple[int, int]], b: list[int], rare: set[int]) -> set[int]:
    """Lines of b in common blocks that have a rare line or ``RUN`` lines that aren't blank."""
    gone: set[int] = set()
    at = 0
    while at < len(matched):
        end = at + 1
        while end < len(matched) and matched[end][0] == matched[end - 1][0] + 1 and matched[end][1] == matched[end - 1][1] + 1:
            end += 1
        if any(b[j] in rare for _, j in matched[at:end]) or sum(b[j] != 0 for _, j in matched[at:end]) >= RUN:
            gone.update(j for _, j in matched[at:end])
        at = end
    return gone


def keys(lines: list[int], rare: set[int], common: set[int]) -> Iterator[tuple[int, int, int]]:
    """Keys of the lines that other documents have too: hash, and the lines from and to which can't be deleted without it.

    A block that deletes a line holds all lines between it and the nearest rare line on one side, or is a run without rare lines.
    So an earlier document that can delete a line has one of the line's keys: the line if it is rare, else the lines up to the
    next rare one before or after it, or ``RUN`` lines in a row.
    """
    n, at = len(lines), 0
    while at < n:
        end = at
        while end < n and (not lines[end] or lines[end] in rare or lines[end] in common):
            end += 1
        for salt, places in ((1, range(at, end)), (2, range(end - 1, at - 1, -1))):
            h = None
            for i in places:
                if lines[i] in rare:
                    h = hash((salt, lines[i]))
                    if salt == 1:
                        yield hash((0, lines[i])) & _MASK, i, i + 1
                elif h is not None:
                    h = hash((h, lines[i]))
                    yield h & _MASK, i, i + 1
        full = [i for i in range(at, end) if lines[i]]
        for k in range(len(full) - RUN + 1):
            before = full[k - 1] + 1 if k else at
            after = full[k + RUN] if k + RUN < len(full) else end
            yield hash((3, *lines[full[k] : full[k + RUN - 1] + 1])) & _MASK, before, after
        at = end + 1


def deletions(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, h, lines (the numbers of the deleted lines, from 0), from_ids (the documents they were aligned with).

    Only documents that lose lines are listed. A document comes before another if its doc_id is smaller (a null one is the
    largest, the hash h of the text decides between equals); rows with equal doc_id and text are one document. Lines are
    compared without white space at their ends; blank lines align but aren't rare. Null and empty texts have no lines, an empty table
    gives no rows, and very long texts are compared whole like others.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(col(doc_id).alias("d"), text_hash(text).alias("h"), col(text).alias("t"))

    @released
    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "t"):
                h, until = line_hashes(*bytes_of(part.column(2)))
                lists = pa.ListArray.from_arrays(pa.array(until.astype(np.int32)), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists], ["d", "h", "lines"])

    lists = rows.mapInArrow(hashes, f"d {kind}, h bigint, lines array<bigint>").where(F.size("lines") > 0)
    lists = cut(lists.select(F.struct(F.col("d").isNull().alias("no"), F.col("d").alias("id"), "h").alias("key"), "lines", F.xxhash64("lines").alias("list")))
    struct = lists.schema["key"].dataType.simpleString()
    firsts = cut(lists.groupBy("list").agg(F.min("key").alias("key"), F.first("lines").alias("lines")))
    lines = firsts.select("key", F.explode(F.array_distinct("lines")).alias("line")).where("line <> 0")
    known = lines.groupBy("line").agg(F.count(F.lit(1)).alias("df")).where("df > 1").select("line", (F.col("df") <= RARE).alias("is_rare"))
    marks = lines.join(known, "line").groupBy("key").agg(F.collect_set(F.when(F.col("is_rare"), F.col("line"))).alias("rare"), F.collect_set(F.when(~F.col("is_rare"), F.col("line"))).alias("common"))
    shared = cut(firsts.join(marks, "key").select("key", "lines", "rare", "common"))
    # Copies of a list: all lines are one block, which the first deletes.
    none = F.array().cast("array<bigint>")
    copies = lists.join(firsts.select("list", F.col("key").alias("first")), "list").where("first < key").dropDuplicates(["key"])
    copies = copies.join(shared.select(F.col("key").alias("first"), "common"), "first", "left")
    overlaps = (F.size(F.array_except("lines", F.coalesce("common", none))) > F.when(F.array_contains("lines", 0), 1).otherwise(0)) | (F.size(F.filter("lines", lambda x: x != 0)) >= RUN)
    copies = copies.where(overlaps).select("key", "first", F.sequence(F.lit(0), F.size("lines") - 1).alias("lines"))

    @released
    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The keys of the lines that aren't gone."""
        for batch in batches:
            where, out = [], []
            for i, (b, rare, common, gone) in enumerate(zip(*(c.to_pylist() for c in batch.columns[1:5]))):
                gone_ = set(gone)
                found = {h for h, s, e in keys(b, set(rare), set(common)) if not gone_ or any(j not in gone_ for j in range(s, e))}
                where.extend([i] * len(found))
                out.extend(found)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(where, pa.int64())), pa.array(out, pa.int64())], ["key", "k"])

    @released
    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b: list[int] = []
        rare_: set[int] = set()
        gone_: set[int] = set()
        for batch in batches:
            second, where, out = batch.column(3).to_pylist(), [], []
            for i in range(batch.num_rows):
                if not second[i]:
                    b, rare_, gone_ = batch.column(4)[i].as_py(), set(batch.column(5)[i].as_py()), set(batch.column(6)[i].as_py())
                elif len(gone_) < len(b) and (found := blocks(patience(batch.column(4)[i].as_py(), b), b, rare_) - gone_):
                    gone_ |= found
                    where.append(i)
                    out.append(sorted(found))
            take = pa.array(where, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(1).take(take), batch.column(2).take(take), pa.array(out, pa.list_(pa.int32()))], ["key", "first", "lines"])

    def aligned(pairs: DataFrame, docs_: DataFrame) -> DataFrame:
        # A document's own row comes before its partners' rows, so that a task holds one document and one partner at a time.
        own = docs_.join(pairs.select("key").distinct(), "key", "left_semi").select("key", F.col("key").alias("first"), F.lit(False).alias("second"), "lines", "rare", "gone")
        partners = pairs.join(shared.select(F.col("key").alias("first"), "lines"), "first").select("key", "first", F.lit(True).alias("second"), "lines", none.alias("rare"), F.array().cast("array<int>").alias("gone"))
        jobs = own.unionByName(partners).select(F.xxhash64("key").alias("g"), "*").repartition("g").sortWithinPartitions("g", "key", "second", "first")
        return cut(jobs.mapInArrow(align, f"key {struct}, first {struct}, lines array<int>"))

    start = shared.withColumn("gone", F.array().cast("array<int>"))
    held = cut(start.mapInArrow(keyed, f"key {struct}, k bigint"))
    heads = held.groupBy("k").agg(F.min("key").alias("first"))
    pairs = cut(held.join(heads, "k").where("first < key").select("key", "first").distinct())
    one = aligned(pairs, start)
    flat = F.array_sort(F.array_distinct(F.flatten(F.collect_list("lines"))))
    after = cut(shared.join(one.groupBy("key").agg(flat.alias("gone")), "key", "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<int>"))))
    after = after.where(F.size("gone") < F.size("lines"))
    rest = after.mapInArrow(keyed, f"key {struct}, k bigint").join(held.select("k", F.col("key").alias("first")), "k").where("first < key").select("key", "first").distinct()
    two = aligned(cut(rest.join(pairs, ["key", "first"], "left_anti")), after)
    gone = one.unionByName(two).unionByName(copies).groupBy("key").agg(flat.alias("lines"), F.array_sort(F.collect_set("first.id")).alias("from_ids"))
    return gone.select(F.col("key.id").alias("doc_id"), F.col("key.h").alias("h"), "lines", "from_ids")


def delete_lines(text: str, gone: list[int]) -> str:
    lines, drop = text.split("\n"), set(gone)
    return "\n".join(x for i, x in enumerate(lines) if i not in drop)


def line_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", n_chars: str = "n_chars") -> DataFrame:
    """docs without the lines of ``deletions``, with all columns; n_chars, if there, is counted again for changed texts.

    A document of which nothing but white space is left goes (so does a later copy). Documents without overlap stay untouched,
    null and empty texts among them. An empty table gives an empty table.
    """
    gone = cut(deletions(docs, text, doc_id))
    h, gd, gh, g = fresh(docs, "h", "gd", "gh", "g")
    gone = gone.select(F.col("doc_id").alias(gd), F.col("h").alias(gh), F.col("lines").alias(g))
    near, far = split(docs.withColumn(h, text_hash(text)), h, gone.select(gh))
    joined = join_keys(near, gone, [(h, gh), (doc_id, gd)], "left").drop(h, gd, gh)

    def shorten(texts: pd.Series, lines: pd.Series) -> pd.Series:
        return pd.Series([delete_lines(t, x) for t, x in zip(texts, lines)])

    changed = joined.where(F.col(g).isNotNull()).withColumn(text, F.pandas_udf(shorten, "string")(col(text), F.col(g))).where(col(text).rlike(r"\S")).drop(g)
    if n_chars in docs.columns:
        changed = changed.withColumn(n_chars, F.length(col(text)).cast(docs.schema[n_chars].dataType))
    out = joined.where(F.col(g).isNull()).drop(g)
    out = out.unionByName(changed)
    return far.drop(h).unionByName(out)
