"""Near dedup: improved consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard similarity.

A document is a set of word shingles, each weighing its count times ln(1 + N / df). N and df are taken over all documents; a df
below ``LEAST_SHARE`` of N counts as that share, so that weights don't depend on the size of the corpus. df is held in two rows of
2**DF_BITS hashed counters (count-mean-min): of each the mean of the other counters is taken off, and the lesser of both counts.
What is left of the collisions is their deviation from the mean, which falls below the least share as the corpus grows. So the table
that is broadcast has the same size for any corpus. Each of ``BANDS * ROWS`` samples is Ioffe's (2010): for a
shingle of weight w, with r and c from Gamma(2, 1) and b uniform, t = floor(ln w / r + b), and the shingle with the least
ln c - r (t - b + 1) is drawn together with its t. Two documents draw the same with the probability of their weighted Jaccard
similarity. The variates of a shingle come from three tables that are looked up by three parts of its hash.

Buckets of equal bands are resolved without forming all their pairs: every member is verified against the bucket's first
document; verified pairs make components; then members of a bucket that lie in different components are verified where their
weights allow the threshold. In a bucket of more than ``SMALL`` members only those are that share one of their heaviest shingles
(prefix filtering: a document's shingles in order of falling idf, until what follows weighs too little for the threshold), which no
pair at the threshold can lack. So two documents of a bucket are left apart only if they fail the threshold or their components are
joined otherwise: the groups are those of all verified pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from .common import bytes_of, col, cut, fresh, join_keys, pieces, released, small_batches, split, text_hash, without
from .kernels import PUNCT, U, Three, Two, mix, spans, word_hashes

#: Words of a shingle, and the weighted Jaccard similarity from which two documents are near copies.
SHINGLE, THRESHOLD = 2, 0.55
#: With 20 bands of 3 rows, a pair at the threshold shares a band with probability 0.97, at 0.7 with 0.9998.
BANDS, ROWS = 20, 3
#: Counters of a row of document frequencies, as a power of two, and the share of the documents that the rarest shingles count as.
DF_BITS, DF_ROWS, LEAST_SHARE = 19, 2, 1 / 2048
#: Members up to which a bucket's pairs are formed as they are, and partners that are verified in one task at most.
SMALL, PARTNERS = 32, 2000
_SLAB = 2048

_rng = np.random.default_rng(77)
_D = BANDS * ROWS
_TABLE = 4096
_R = _rng.gamma(2.0, 1.0, (_TABLE, _D)).astype(np.float32).clip(1e-4)
_INV = (1 / _R).astype(np.float32)
_LNC = np.log(_rng.gamma(2.0, 1.0, (_TABLE, _D))).astype(np.float32)
_B = _rng.random((_TABLE, _D), np.float32)
_SALT = _rng.integers(1, 1 << 63, _D, dtype=np.uint64) * U(2) + U(1)


def shingles(texts: pa.Array, size: int = SHINGLE) -> Three:
    """Distinct shingles (44 bits) of each text in order, their counts, and the n + 1 offsets of the texts.

    Words are lower-cased runs of letters and digits (and of anything outside ASCII). A text with fewer words than ``size`` has
    one shingle of all its words, one without words has none.
    """
    buf, offs = bytes_of(pc.utf8_lower(texts))
    starts, ends, words = spans(buf, offs, PUNCT)
    h = word_hashes(buf, starts, ends)
    n = np.diff(words)
    if not len(h):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(n) + 1, np.int64)
    doc = np.repeat(np.arange(len(n)), n)
    grams = h.copy()
    for j in range(1, size):
        grams[: len(h) - j] = grams[: len(h) - j] * U(0x9E3779B97F4A7C15) + h[j:]
    left = words[1:][doc] - np.arange(len(h))
    for i in np.flatnonzero((n > 0) & (n < size)):
        value = h[words[i]]
        for j in range(1, n[i]):
            value = value * U(0x9E3779B97F4A7C15) + h[words[i] + j]
        grams[words[i]], left[words[i]] = value, size
    on = left >= size
    key = (doc[on].astype(np.uint64) << U(44)) | (mix(grams[on]) >> U(20))
    key.sort()
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    key, count = key[edge], np.diff(np.append(edge, len(key)))
    until = np.searchsorted(key, np.arange(len(n) + 1).astype(np.uint64) << U(44))
    return key & U((1 << 44) - 1), count, until


def slots(ids: np.ndarray) -> np.ndarray:
    """The counter of each shingle in each row."""
    mask = U((1 << DF_BITS) - 1)
    return np.stack([((ids >> U(22 * row)) & mask).astype(np.int64) + (row << DF_BITS) for row in range(DF_ROWS)])


def document_frequencies(docs: DataFrame, text: str, size: int = SHINGLE) -> tuple[np.ndarray, int]:
    """Hashed counters of the documents of all shingles, and the number of documents that have a shingle.

    Partitions count for themselves and send their counters in blocks, which are added up by block.
    """
    width, block = DF_ROWS << DF_BITS, 1 << 16

    @released
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(width, np.int64), 0
        for batch in batches:
            for part in pieces(batch, "t"):
                ids, _, until = shingles(part.column(0), size)
                total += np.bincount(slots(ids).ravel(), minlength=width)
                n += int((np.diff(until) > 0).sum())
        blocks = total.reshape(-1, block)
        used = np.flatnonzero(blocks.any(axis=1))
        yield pa.RecordBatch.from_pydict(
            {"block": pa.array([*used.tolist(), -1], pa.int32()), "counts": pa.array([*(blocks[i].astype("<i8").tobytes() for i in used), np.array([n], "<i8").tobytes()], pa.binary())}
        )

    def add(key, table):
        total = sum(np.frombuffer(c, "<i8") for c in table.column("counts").to_pylist())
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    schema = "block int, counts binary"
    rows = docs.select(col(text).alias("t")).mapInArrow(count, schema).groupBy("block").applyInArrow(add, schema).collect()
    df, n = np.zeros(width, np.int64), 0
    for r in rows:
        got = np.frombuffer(r.counts, "<i8")
        if r.block < 0:
            n = int(got[0])
        else:
            df[r.block * block : (r.block + 1) * block] = got
    return df, n


def inverse_frequencies(df: np.ndarray, n: int) -> np.ndarray:
    """The weight that each counter gives a shingle; the greater of a shingle's rows is its idf."""
    rows = df.reshape(DF_ROWS, -1).astype(np.float64)
    own = rows - (rows.sum(axis=1, keepdims=True) - rows) / (rows.shape[1] - 1)
    return np.log1p(max(n, 1) / np.maximum(own, max(1.0, n * LEAST_SHARE))).astype(np.float32).ravel()


def weights(ids: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return counts * idf[slots(ids)].max(axis=0).astype(np.float64)


def samples(ids: np.ndarray, w: np.ndarray) -> Two:
    """The D shingles drawn from one document, and their t."""
    lw = np.log(w).astype(np.float32)[:, None]
    best = np.full(_D, np.inf, np.float32)
    drawn, level = np.zeros(_D, np.uint64), np.zeros(_D, np.int64)
    i1, i2, i3 = ((ids >> U(s)).astype(np.int64) & (_TABLE - 1) for s in (0, 12, 24))
    for at in range(0, len(ids), _SLAB):
        to = at + _SLAB
        r, b = _R[i1[at:to]], _B[i3[at:to]]
        t = _INV[i1[at:to]]
        t *= lw[at:to]
        t += b
        np.floor(t, out=t)
        a = t - b
        a += 1
        a *= r
        np.subtract(_LNC[i2[at:to]], a, out=a)
        least = a.min(axis=0)
        rows, cols = np.nonzero(a == least)
        row = np.zeros(_D, np.int64)
        row[cols[::-1]] = rows[::-1]
        better = least < best
        best[better] = least[better]
        pick = row[better]
        drawn[better], level[better] = ids[at:to][pick], t[pick, np.flatnonzero(better)].astype(np.int64)
    return drawn, level


def bands(drawn: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Band hashes of documents, from their samples (documents x D)."""
    s = mix((drawn + U(1)) * U(0x9E3779B97F4A7C15) ^ (level.astype(np.uint64) * _SALT[None, :]))
    s = (s * _SALT[None, :]).reshape(len(s), BANDS, ROWS)
    return mix(s.sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)[None, :])


def signatures(docs: DataFrame, idf, text: str, doc_id: str) -> DataFrame:
    """doc_id, h, weight, bands of the documents that have shingles. idf: the broadcast weights of the counters."""
    kind = docs.schema[doc_id].dataType.simpleString()

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "t"):
                ids, counts, until = shingles(part.column(2))
                if not len(ids):
                    continue
                w = weights(ids, counts, idf.value)
                on = np.flatnonzero(np.diff(until))
                got = [samples(ids[until[i] : until[i + 1]], w[until[i] : until[i + 1]]) for i in on]
                found = bands(np.stack([g[0] for g in got]), np.stack([g[1] for g in got])).view(np.int64)
                keep = pa.array(on)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(found.ravel()), BANDS).cast(pa.list_(pa.int64()))
                total = np.add.reduceat(w, until[:-1][on])
                yield pa.RecordBatch.from_arrays([part.column(0).take(keep), part.column(1).take(keep), pa.array(total), lists], ["doc_id", "h", "weight", "bands"])

    return docs.select(col(doc_id).alias("d"), text_hash(text).alias("h"), col(text).alias("t")).mapInArrow(run, f"doc_id {kind}, h bigint, weight double, bands array<bigint>")


def similarity(a: Two, b: Two) -> float:
    """Weighted Jaccard similarity of two sorted sets with weights."""
    if len(a[0]) > len(b[0]):
        a, b = b, a
    if not len(a[0]):
        return 0.0
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    both = b[0][at] == a[0]
    least = np.minimum(a[1][both], b[1][at[both]]).sum()
    return float(least / (a[1].sum() + b[1].sum() - least))


def verify(pairs: DataFrame, docs: DataFrame, idf, text: str, doc_id: str) -> DataFrame:
    """a, b, similarity of pairs (columns a and b, keys as structs). The first's text comes before those of its partners, once for
    each ``PARTNERS`` of them, so that no task has all partners of a document with many."""
    ends = cut(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct())
    rows = texts_of(ends, docs, text, doc_id)
    counts = pairs.groupBy("a").agg(F.floor((F.count(F.lit(1)) - 1) / PARTNERS).cast("int").alias("more"))
    salted = pairs.join(counts, "a").select("a", F.col("b").alias("key"), F.pmod(F.xxhash64("b"), F.col("more") + 1).cast("int").alias("salt"))
    firsts = counts.select("a", F.col("a").alias("key"), F.explode(F.sequence(F.lit(0), "more")).alias("salt"))
    many = salted.unionByName(firsts).join(rows, "key").select(F.xxhash64("a", "salt").alias("g"), "a", "key", (F.col("a") != F.col("key")).alias("second"), "t")
    key = key_type(docs, doc_id)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current = None
        for batch in batches:
            for part in pieces(batch, "t"):
                ids, counts, until = shingles(part.column(4))
                w = weights(ids, counts, idf.value)
                second = part.column(3).to_pylist()
                where, out = [], []
                for i in range(part.num_rows):
                    own = ids[until[i] : until[i + 1]], w[until[i] : until[i + 1]]
                    if not second[i]:
                        current = own[0].copy(), own[1].copy()
                    else:
                        where.append(i)
                        out.append(similarity(current, own))
                take = pa.array(where, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(1).take(take), part.column(2).take(take), pa.array(out, pa.float64())], ["a", "b", "similarity"])

    many = many.repartition(F.col("g")).sortWithinPartitions("g", "a", "second")
    return many.mapInArrow(run, f"a {key}, b {key}, similarity double")


def key_type(docs: DataFrame, doc_id: str) -> str:
    return "struct<no:boolean,id:" + docs.schema[doc_id].dataType.simpleString() + ",h:bigint>"


def texts_of(ends: DataFrame, docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """key, t: the texts of some documents, each once."""
    rows = docs.select(col(doc_id).alias("d"), text_hash(text).alias("h"), col(text).alias("t"))
    rows, _ = split(rows, "h", ends.select("key.h"))
    rows = rows.join(ends, (F.col("h") == F.col("key.h")) & F.col("d").eqNullSafe(F.col("key.id")), "left_semi")
    return rows.groupBy("d", "h").agg(F.first("t").alias("t")).select(F.struct(F.col("d").isNull().alias("no"), F.col("d").alias("id"), "h").alias("key"), "t")


def prefixes(ends: DataFrame, docs: DataFrame, idf, text: str, doc_id: str, threshold: float) -> DataFrame:
    """key, shingle, short: the shingles by which a document can meet another.

    The shingles stand in order of falling idf, equal ones by hash, the same for all documents. Documents at the threshold share
    at least ``threshold`` of the heavier one's weight, and 2 * threshold / (1 + threshold) of the lighter one's; so their first
    common shingle lies before less than that is left. ``short`` tells that it will do where the document is the lighter one.
    """

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "t"):
                ids, counts, until = shingles(part.column(1))
                rare = idf.value[slots(ids)].max(axis=0)
                w = counts * rare.astype(np.float64)
                doc = np.repeat(np.arange(part.num_rows), np.diff(until))
                by = np.lexsort((ids, -rare, doc))
                ids, w, doc = ids[by], w[by], doc[by]
                total = np.bincount(doc, w, part.num_rows)
                before = np.cumsum(w) - w
                left = total[doc] - (before - before[until[doc]]) if len(w) else w
                slack = 1e-6 * total[doc]
                keep = np.flatnonzero(left >= threshold * total[doc] - slack)
                short = (left >= 2 * threshold / (1 + threshold) * total[doc] - slack)[keep]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(doc[keep])), pa.array(ids[keep].view(np.int64)), pa.array(short)], ["key", "shingle", "short"])

    return texts_of(ends, docs, text, doc_id).mapInArrow(run, f"key {key_type(docs, doc_id)}, shingle bigint, short boolean")


def groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = THRESHOLD, small: int = SMALL) -> DataFrame:
    """doc_id, h, keep_id, keep_h, group_size, copies for each document that has near copies.

    A group is a component of the pairs with a similarity of at least ``threshold``; its document with the smallest doc_id stays
    (a null doc_id is the largest). h is the hash of the text (see common); copies is the number of rows of this doc_id and text,
    and a document that is only repeated is a group of its own. Texts are compared whole, the candidates come from all documents,
    and no list of candidates is capped; ``small`` changes how pairs are found, not which. Documents without a word (null, empty,
    punctuation only) have no near copies. Of an empty table there are no groups.
    """
    spark = docs.sparkSession
    small_batches(spark)
    idf = spark.sparkContext.broadcast(inverse_frequencies(*document_frequencies(docs, text)))
    signed = signatures(docs, idf, text, doc_id)
    members = signed.select(F.posexplode("bands").alias("band_no", "band"), F.struct(F.col("doc_id").isNull().alias("no"), F.col("doc_id").alias("id"), "h").alias("key"), "weight")
    bucket = Window.partitionBy("band")
    members = cut(members.withColumn("first", F.min("key").over(bucket)).withColumn("n", F.count(F.lit(1)).over(bucket)).where("n > 1").drop("n"))
    repeats = members.where("band_no = 0").groupBy("key").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    star = cut(members.where("key <> first").select(F.col("first").alias("a"), F.col("key").alias("b")).distinct())
    checked = cut(verify(star, docs, idf, text, doc_id))
    good = checked.where(F.col("similarity") >= threshold).select("a", "b")
    first = cut(connected_components(good, "a", "b"))
    # What the first documents of the buckets didn't join: pairs across components.
    placed = members.join(first.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    mixed = placed.withColumn("apart", F.min("component").over(bucket) != F.max("component").over(bucket)).where("apart and key <> first").select("band", "key", "weight", "component").distinct()
    mixed = cut(mixed.withColumn("n", F.count(F.lit(1)).over(bucket)).where("n > 1"))
    size = f"least(x.weight, y.weight) >= {threshold} * greatest(x.weight, y.weight) * 0.999999"
    few = mixed.where(F.col("n") <= small)
    rest = few.alias("x").join(few.alias("y"), F.expr(f"x.band = y.band and x.key < y.key and x.component <> y.component and {size}")).select(F.col("x.key").alias("a"), F.col("y.key").alias("b"))
    many = mixed.where(F.col("n") > small)
    if not many.isEmpty():
        met = cut(many.join(prefixes(many.select("key").distinct(), docs, idf, text, doc_id, threshold), "key"))
        lighter = "(x.weight < y.weight or x.weight = y.weight and x.key < y.key)"
        found = met.where("short").alias("x").join(met.alias("y"), F.expr(f"x.band = y.band and x.shingle = y.shingle and x.component <> y.component and {lighter} and {size}"))
        rest = rest.unionByName(found.select(F.least("x.key", "y.key").alias("a"), F.greatest("x.key", "y.key").alias("b")))
    rest = cut(rest.distinct())
    more = verify(rest, docs, idf, text, doc_id).where(F.col("similarity") >= threshold).select("a", "b")
    final = connected_components(first.select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(more), "a", "b")
    sizes = final.groupBy("component").agg(F.count(F.lit(1)).alias("group_size"))
    out = final.join(sizes, "component").join(repeats.withColumnRenamed("key", "node"), "node", "full_outer")
    keep = F.coalesce("component", "node")
    return cut(
        out.select(
            F.col("node.id").alias("doc_id"), F.col("node.h").alias("h"), keep["id"].alias("keep_id"), keep["h"].alias("keep_h"),
            F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"), F.coalesce("copies", F.lit(1)).cast("bigint").alias("copies"),
        )
    )


def near_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """docs less all but one document of each group of ``groups``; of rows with equal doc_id and text one stays.

    Documents that have no near copy stay as they are, those without text or words included. All columns are kept. An empty table
    gives an empty table.
    """
    found = groups(docs, text, doc_id, threshold)
    gone = found.where("not (doc_id <=> keep_id) or h <> keep_h")
    left = without(docs, gone, text, doc_id)
    again = found.where("copies > 1 and doc_id <=> keep_id and h = keep_h").select(F.col("doc_id").alias("again_id"), F.col("h").alias("again_h"))
    if again.isEmpty():
        return left
    (h,) = fresh(left, "h")
    a, b = fresh(left.withColumn(h, F.lit(0)), "again_id", "again_h")
    again = again.toDF(a, b)
    left = left.withColumn(h, text_hash(text))
    once = join_keys(left, again, [(h, b), (doc_id, a)], "left_anti")
    more = join_keys(left, again, [(h, b), (doc_id, a)], "left_semi").dropDuplicates([h, doc_id])
    return once.unionByName(more).drop(h)
