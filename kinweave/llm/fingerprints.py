"""Document fingerprints: content-defined chunks and containment.

A text's bytes are cut where a gear hash has zeros in given bits: ``STRICT`` bits before a chunk has reached ``NORMAL`` bytes, the
fewer ``LOOSE`` bits after (normalised chunking, Xia et al. 2016), none before ``LEAST`` and at ``MOST`` at last. The bits lie so low
that only the last ``WINDOW`` bytes move them: an insertion moves the chunks after it and changes only those that it touches. Chunks
are about 25 bytes, so that near copies with scattered edits have most of them in common.
A fingerprint is the set of the chunks' 64-bit digests, each weighing the chunk's bytes. The containment of a in b is the weight
of a's chunks that b has too, over the weight of a's chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_BYTES, CHUNK_BYTES, FILTER_LIMIT, KeyFilter, bytes_of, col, discard, pieces, released, small_batches, text_hash, written
from .kernels import BYTE_HASH, U, Four, Two, mix, ranges, span_hash

LEAST, NORMAL, MOST = 8, 24, 96
GEAR = mix(np.arange(1, 257, dtype=np.uint64))
_SPREAD = 0x9D3F_5B71_A6E8_C24D  # bits in odd order, so that the masks don't look at neighbours only
#: Bytes that the bits of the masks depend on.
WINDOW = 8
STRICT = np.uint8(0b11111 << WINDOW - 5)
LOOSE = np.uint8(0b111 << WINDOW - 3)
_LOW = GEAR.astype(np.uint8)
#: Documents of a group whose pairs are weighed together, about.
BLOCK = 16_384
#: Containment from which a pair is reported.
THRESHOLD = 0.5
#: Documents that are only looked at for each one that looks up, from which on a place takes no more of them than it needs; such places at
#: most (the largest; to others whole documents are sent).
CROWD, CROWDED = 8, 1 << 20


def gear(buf: np.ndarray) -> np.ndarray:
    """The lowest ``WINDOW`` bits of the gear hash after each byte: the sum of gear[b[i - j]] << j, by doubling the window."""
    h, width = _LOW[buf], 1
    while width < WINDOW:
        if len(h) > width:
            later = h[width:] + (h[:-width] << np.uint8(width))
            h = np.concatenate([h[:width], later])
        width *= 2
    return h


def _next(flags: np.ndarray) -> memoryview:
    """For each place the first end from there on, or a place beyond all; flags tell after which bytes there is an end."""
    n = len(flags)
    ends = np.append(np.flatnonzero(flags) + 1, 1 << 30).astype(np.int32)
    below = np.zeros(n + MOST, np.int32)  # ends below each place
    np.cumsum(flags[: n - 1], out=below[2 : n + 1], dtype=np.int32)
    below[n + 1 :] = len(ends) - 1
    return memoryview(ends[below])


def chunk_ends(buf: np.ndarray, offs: np.ndarray) -> Two:
    """Ends of the chunks of all texts, and the n + 1 offsets of the texts in them."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    h = gear(buf)
    strict, loose = _next((h & STRICT) == 0), _next((h & LOOSE) == 0)
    ends: list[int] = []
    until = [0]
    bounds = offs.tolist()
    for at, stop in zip(bounds[:-1], bounds[1:]):
        while stop - at > LEAST:
            end = strict[at + LEAST]
            if end >= at + NORMAL:
                end = loose[at + NORMAL]
                if end > at + MOST:
                    end = at + MOST
            at = end if end < stop else stop
            ends.append(at)
        if at < stop:
            ends.append(stop)
        until.append(len(ends))
    return np.array(ends, np.int64), np.array(until, np.int64)


def chunks(texts: pa.Array) -> Four:
    """Distinct chunk digests of each text in order, the bytes that each weighs, the n + 1 offsets of the texts, and their bytes."""
    buf, offs = bytes_of(texts)
    ends, until = chunk_ends(buf, offs)
    starts = np.concatenate([[0], ends[:-1]])[: len(ends)]
    h = span_hash(BYTE_HASH[buf], starts, ends) if len(ends) else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(len(texts)), np.diff(until))
    order = np.lexsort((h.view(np.int64), doc))
    h, doc, size = h[order].view(np.int64), doc[order], (ends - starts)[order]
    head = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])) if len(h) else np.zeros(0, np.int64)
    weight = np.add.reduceat(size, head) if len(head) else size
    return h[head], weight, np.searchsorted(doc[head], np.arange(len(texts) + 1)), np.diff(offs)


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, h, digests, sizes, n_bytes of each row; a map without shuffle.

    digests are the distinct chunk digests in order, sizes the bytes that each weighs (those of all its occurrences), n_bytes
    their sum. A null text has null digests, sizes and n_bytes; an empty one has empty ones. h is the hash of the text. Texts are
    cut whole, however long; an empty table gives no rows.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "t"):
                t = part.column(2)
                digest, weight, until, n = chunks(t)
                gone = np.asarray(t.is_null())
                lists = pa.array(until.astype(np.int32), mask=np.append(gone, False))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.ListArray.from_arrays(lists, pa.array(digest)), pa.ListArray.from_arrays(lists, pa.array(weight.astype(np.int32))), pa.array(n, pa.int64(), mask=gone)],
                    ["doc_id", "h", "digests", "sizes", "n_bytes"],
                )

    small_batches(docs.sparkSession)
    return docs.select(col(doc_id).alias("d"), text_hash(text).alias("h"), col(text).alias("t")).mapInArrow(run, f"doc_id {kind}, h bigint, digests array<bigint>, sizes array<int>, n_bytes bigint")


def _level(k: np.ndarray, filters: list[KeyFilter]) -> np.ndarray:
    """In how many of the filters each key is, from the first on."""
    out = np.zeros(len(k), np.int8)
    on = np.arange(len(k))
    for found in filters:
        on = on[found.contains(k[on])]
        out[on] += 1
    return out


def _tally(rows: DataFrame, buckets: int) -> DataFrame:
    """k, df of the keys that occur in two documents at least. rows: bucket, once (packed keys), k and n of those met more often."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list] = {}
        for batch in batches:
            for bucket, once, k, n in zip(*(c.to_pylist() for c in batch.columns)):
                parts.setdefault(bucket, []).append((once, k, n))
        for bucket, found in parts.items():
            ones = _unpack(b"".join(f[0] for f in found))
            again = _unpack(b"".join(f[1] for f in found))
            times = np.frombuffer(b"".join(f[2] for f in found), np.uint32)
            k, count = np.unique(ones, return_counts=True)
            k, back = np.unique(np.concatenate([k, again]), return_inverse=True)
            df = np.bincount(back, np.concatenate([count, times])).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(k[df > 1]), pa.array(df[df > 1])], ["k", "df"])

    return rows.repartition(buckets, "bucket").mapInArrow(run, "k bigint, df bigint")


def _pack(k: np.ndarray) -> np.ndarray:
    """Keys of 48 bits as six bytes each."""
    return k.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :6]


def _unpack(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<i8").ravel()


def key48(digest: np.ndarray) -> np.ndarray:
    return (digest.view(np.uint64) >> U(16)).astype(np.int64)


def containments(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = THRESHOLD, limit: int = FILTER_LIMIT, block: int = BLOCK) -> DataFrame:
    """doc_id, in_doc_id, shared_bytes, n_bytes, containment: a document, one that contains it to at least ``threshold``.

    Pairs are all pairs of different classes (see ``links``), by their representatives, and every other member of a class with its
    representative, at containment 1, either way. A group of n near copies makes n squared pairs: ``links`` gives their numbers.
    """
    members, classes, same, found = _search(docs, text, doc_id, threshold, limit, block, True)
    for side in "ab":
        found = found.join(classes.select(F.col("set").alias(side), F.col("rep").alias(f"key_{side}")), side).drop(side).withColumnRenamed(f"key_{side}", side)
    twins = same.select(F.col("key").alias("a"), F.col("rep").alias("b"), F.col("n_bytes").alias("shared_bytes"), "n_bytes")
    twins = twins.unionByName(twins.select(F.col("b").alias("a"), F.col("a").alias("b"), "shared_bytes", "n_bytes"))
    return found.unionByName(twins).select(F.col("a.id").alias("doc_id"), F.col("b.id").alias("in_doc_id"), "shared_bytes", "n_bytes", (F.col("shared_bytes") / F.col("n_bytes")).alias("containment"))


def links(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = THRESHOLD, limit: int = FILTER_LIMIT, block: int = BLOCK) -> DataFrame:
    """doc_id, class_id, class_size, n_containing, n_contained, best_id, containment: one row for each document with chunks.

    Documents with equal chunk sets and weights are a class; its smallest doc_id stands for it (a null one is the largest, the hash of
    the text decides between equals). n_containing and n_contained are the numbers of other classes that contain the document to at
    least ``threshold``, and that it contains so; best_id is the representative of the class that contains it most (the first by
    hash of equals), null where none does, and containment how far. All members of a class have the same numbers. Null and empty texts
    have no chunks; rows that repeat doc_id and text count once; an empty table gives no rows. Texts are compared whole.

    No list is capped: a document is looked up by its rarest chunks only, as many as weigh more than the share it may lack, which
    no pair at the threshold can miss. How rare a chunk is, filters of ``limit`` bytes at most tell; the result doesn't depend on
    them, nor on ``block``, of about how many documents the chunks meet at a time. Where ``CROWD`` times as many are looked at as look up,
    the former send only chunks that the latter have (a filter of ``limit`` bytes tells; a fuller one sends more). Chunks are counted, and compared within a block, by 48
    bits of their digests. The digests are computed anew for each use: they are about as large as the texts.
    """
    members, classes, _, found = _search(docs, text, doc_id, threshold, limit, block, False)
    numbers = found.groupBy("set").agg(F.sum("n_containing").alias("n_containing"), F.sum("n_contained").alias("n_contained"), F.max_by("best", F.struct(F.col("best.shared"), -F.col("best.b"))).alias("best"))
    named = numbers.join(classes.select(F.col("set").alias("b"), F.col("rep").alias("best_rep")), F.col("best.b") == F.col("b"), "left").drop("b")
    rows = members.join(classes, "set").join(named, "set", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return rows.select(F.col("key.id").alias("doc_id"), F.col("rep.id").alias("class_id"), "class_size", zero("n_containing"), zero("n_contained"), F.col("best_rep.id").alias("best_id"), (F.col("best.shared") / F.col("n_bytes")).alias("containment"))


def _search(docs: DataFrame, text: str, doc_id: str, threshold: float, limit: int, block: int, as_pairs: bool) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Members (set, key, n_bytes), classes (set, rep, class_size), members that aren't representatives, and what the blocks find."""
    spark = docs.sparkSession
    small_batches(spark)
    id_type = docs.schema[doc_id].dataType.simpleString()
    key_type = f"struct<no:boolean,id:{id_type},h:bigint>"
    rows = docs.where(F.length(col(text)) > 0).select(F.struct(col(doc_id).isNull().alias("no"), col(doc_id).alias("id"), text_hash(text).alias("h")).alias("key"), col(text).alias("t"))
    rows = rows.withColumn("kh", F.xxhash64("key.no", "key.id", "key.h"))

    @released
    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "t"):
                digest, weight, until, n = chunks(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(_sets(digest, weight, until)), pa.array(n, pa.int64())], ["key", "set", "n_bytes"])

    members = written(rows.select("key", "t").mapInArrow(classify, f"key {key_type}, set bigint, n_bytes bigint").distinct())
    classes = members.groupBy("set").agg(F.min("key").alias("rep"), F.count(F.lit(1)).alias("class_size"))
    same = written(members.join(classes, "set").where("key <> rep"))
    # Only representatives are counted and looked up: a filter holds the other members, a second one those that it holds wrongly.
    hashed = F.xxhash64("key.no", "key.id", "key.h")
    others = KeyFilter(same.select(hashed.alias("kh")), limit=limit)
    alone = members.join(same.select("key"), "key", "left_anti").select(hashed.alias("kh"))
    kept = KeyFilter(alone.where(others.holds(F.col("kh"))), limit=limit)

    def representatives(batches: Iterator[pa.RecordBatch], size: int = CHUNK_BYTES) -> Iterator[tuple]:
        """Chunks of the representatives: set, bytes, and digests, weights and offsets."""
        for batch in batches:
            kh = batch.column(1).to_numpy()
            batch = batch.filter(pa.array(~others.contains(kh) | kept.contains(kh)))
            for part in pieces(batch, "t", size):
                digest, weight, until, n = chunks(part.column(0))
                yield _sets(digest, weight, until), n, digest, weight, until

    total = members.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions", "8")), total // (256 << 20))

    @released
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, digest, _, _ in representatives(batches, BATCH_BYTES):
            k, times = np.unique(key48(digest), return_counts=True)
            bucket = (mix(k.view(np.uint64)) % U(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            k, times, bucket = k[by], times[by], bucket[by]
            out: dict[str, list] = {"bucket": [], "once": [], "k": [], "n": []}
            edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(k) else np.zeros(0, np.int64)
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
                one = times[a:b] == 1
                out["bucket"].append(int(bucket[a]))
                out["once"].append(_pack(k[a:b][one]).tobytes())
                out["k"].append(_pack(k[a:b][~one]).tobytes())
                out["n"].append(times[a:b][~one].astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_pydict(out, pa.schema([("bucket", pa.int32()), ("once", pa.binary()), ("k", pa.binary()), ("n", pa.binary())]))

    source = rows.select("t", "kh")
    common = written(_tally(source.mapInArrow(count, "bucket int, once binary, k binary, n binary"), buckets))
    sizes = {r.level: r.n for r in common.groupBy(F.floor(F.log2("df") / 3).cast("int").alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()}
    steps = [(max(2, 8**level), sum(n for x, n in sizes.items() if x >= level)) for level in range(max(sizes, default=-1) + 1)]
    filters = [KeyFilter(common.where(F.col("df") >= least).select("k"), limit=limit, count=n) for least, n in steps]
    discard(common)

    def asked_by(set_, n, digest, weight, until) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each chunk's key and document, and whether it is looked up: all but a document's most frequent chunks that together weigh
        less than the threshold."""
        k = key48(digest)
        level = _level(k, filters)
        doc = np.repeat(np.arange(len(n)), np.diff(until))
        by = np.lexsort((k, -level, doc))
        upto = np.concatenate([[0], np.cumsum(weight[by])])
        on = np.zeros(len(k), bool)
        on[by] = upto[1:] - upto[until[doc]] >= np.ceil(threshold * n)[doc]
        return k, doc, on & (level > 0)

    @released
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in representatives(batches):
            k, _, on = asked_by(*found)
            yield pa.RecordBatch.from_arrays([pa.array(k[on])], ["k"])

    asked = KeyFilter(source.mapInArrow(ask, "k bigint"), limit=limit, count=total // 100)

    @released
    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in representatives(batches):
            k, doc, on = asked_by(*found)
            held = np.flatnonzero(asked.contains(k))
            yield pa.RecordBatch.from_arrays([pa.array(k[held]), pa.array(found[0][doc[held]]), pa.array(on[held])], ["k", "set", "asks"])

    # A chunk's documents meet where the first of them says.
    held = written(source.mapInArrow(answer, "k bigint, set bigint, asks boolean"))
    labels = held.groupBy("k").agg(F.min("set").alias("label"), F.max("set").alias("last"), F.bool_or("asks").alias("any")).where("any and label <> last").select("k", "label")
    placed = held.join(labels, "k").groupBy("set").agg(F.sort_array(F.collect_set(F.struct("label", "k", "asks"))).alias("places"))
    placed = written(placed)
    discard(held)
    first = filters[0] if filters else None

    def lists(batches: Iterator[pa.RecordBatch], wanted: KeyFilter) -> Iterator[pa.RecordBatch]:
        for set_, n_bytes, digest, weight, until in representatives(batches):
            on = np.flatnonzero(wanted.contains(set_))
            flat = ranges(until[on], np.diff(until)[on])
            doc = np.repeat(np.arange(len(on)), np.diff(until)[on])
            common = first.contains(key48(digest[flat]))  # others can't be shared
            flat, doc = flat[common], doc[common]
            w, at = weight[flat], np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(on)))])
            large = np.flatnonzero(w > 254)
            more = np.searchsorted(doc[large], np.arange(len(on) + 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(set_[on]), pa.array(n_bytes[on], pa.int64()), _blobs(_pack(key48(digest[flat])).ravel(), at * 6), _blobs(np.minimum(w, 255).astype(np.uint8), at), _blobs(w[large].astype("<i8").view(np.uint8), more * 8)], ["set", "n_bytes", "k", "w", "more"]
            )

    if first is None:
        return members, classes, same, spark.createDataFrame([], PAIRS if as_pairs else NUMBERS)
    def chunked(sets: DataFrame) -> DataFrame:
        wanted = KeyFilter(sets, limit=limit)
        run = released(lambda batches: lists(batches, wanted))
        return source.mapInArrow(run, "set bigint, n_bytes bigint, k binary, w binary, more binary").dropDuplicates(["set"])

    # Places of far more documents than look up there. A document that doesn't look up needs only those chunks there that one that does
    # has, and none where they are fewer than any such one must share.
    asking = F.array_distinct(F.transform(F.filter("places", lambda p: p.asks), lambda p: p.label))
    visits = placed.select("set", F.explode(F.transform(F.array_distinct("places.label"), lambda x: F.struct(x.alias("label"), F.array_contains(asking, x).alias("asks")))).alias("v")).select("set", "v.*")
    places = visits.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("n_asking"))
    full = places.where(F.col("n") - F.col("n_asking") >= CROWD * F.col("n_asking")).orderBy(F.col("n_asking") - F.col("n"), "label").limit(CROWDED)
    crowds = np.sort(full.select("label").toArrow().column(0).to_numpy())
    at_crowds = spark.sparkContext.broadcast(crowds)

    @released
    def crowded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_among(batch.column(1).to_numpy(), at_crowds.value)))

    @released
    def needs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each document that looks up at such a place, its chunks and how many of them a document must share."""
        for batch in batches:
            count, _, weight = _weights(batch)
            until = np.concatenate([[0], np.cumsum(count)])
            least = [_least(weight[lo:hi], threshold * n) for lo, hi, n in zip(until[:-1].tolist(), until[1:].tolist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(3), pa.array(least, pa.int32())], ["label", "k", "least"])

    @released
    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = np.repeat(batch.column(0).to_numpy(), pc.binary_length(batch.column(1)).to_numpy() // 6)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(_at(label, _unpack(b"".join(batch.column(1).to_pylist())))))], ["h"])

    askers = visits.where("asks").select("set", "label").mapInArrow(crowded, "set bigint, label bigint")
    needed = written(chunked(askers.select("set")).join(askers, "set").select("set", "label", "n_bytes", "k", "w", "more").mapInArrow(needs, "label bigint, k binary, least int"))
    n_needed = needed.agg(F.sum(F.length("k"))).first()[0] or 0
    useful = KeyFilter(needed.select("label", "k").mapInArrow(pairs, "h bigint"), limit=limit, count=n_needed // 6)
    lows = needed.groupBy("label").agg(F.min("least").alias("least")).toArrow().sort_by("label")
    assert np.array_equal(lows.column(0).to_numpy(), crowds)
    leasts = spark.sparkContext.broadcast(lows.column(1).to_numpy())
    discard(needed)

    @released
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each place of a document: its chunks, those that it looks up there, and those that it looks up at earlier places.
        Weights go only where it looks up."""
        for batch in batches:
            until = batch.column(5).offsets.to_numpy() - batch.column(5).offsets[0].as_py()
            places = batch.column(5).flatten()
            label, k, asks = (places.field(x).to_numpy(zero_copy_only=False) for x in range(3))
            row = np.repeat(np.arange(batch.num_rows), np.diff(until))
            edge = np.flatnonzero(np.concatenate([[True], (label[1:] != label[:-1]) | (row[1:] != row[:-1]), [True]])) if len(row) else np.zeros(1, np.int64)
            start, stop = edge[:-1], edge[1:]
            packed, own = _pack(k[asks]), np.concatenate([[0], np.cumsum(asks)])
            raw, begin = packed.ravel(), own[until[row[start]]]
            here, before = own[stop] - own[start], own[start] - begin
            label, row = label[start], row[start]
            n_chunks = pc.binary_length(batch.column(2)).to_numpy().astype(np.int64) // 6
            flat = _unpack(b"".join(batch.column(2).to_pylist()))[ranges((np.cumsum(n_chunks) - n_chunks)[row], n_chunks[row])]
            thin = (here == 0) & _among(label, at_crowds.value)
            place = np.repeat(np.arange(len(label)), n_chunks[row])
            asked_about = ~thin[place]
            asked_about[~asked_about] = useful.contains(_at(label[place[~asked_about]], flat[~asked_about]))
            flat, count = flat[asked_about], np.bincount(place[asked_about], minlength=len(label))
            keep = ~thin
            keep[thin] = count[thin] >= leasts.value[np.searchsorted(at_crowds.value, label[thin])]
            flat, on = flat[np.repeat(keep, count)], np.flatnonzero(keep)
            take, looks = pa.array(row[on]), pa.array(here[on] > 0)
            of = lambda lo, n: _blobs(raw[ranges(lo * 6, n * 6)], np.concatenate([[0], np.cumsum(n * 6)]))
            kept_k = _blobs(_pack(flat).ravel(), np.concatenate([[0], np.cumsum(count[on] * 6)]))
            heavy = [pc.if_else(looks, batch.column(c).take(take), b"") for c in (3, 4)]
            yield pa.RecordBatch.from_arrays([pa.array(label[on]), *[batch.column(c).take(take) for c in range(2)], kept_k, *heavy, of(own[start][on], here[on]), of(begin[on], np.where(here > 0, before, 0)[on])], ["label", "set", "n_bytes", "k", "w", "more", "here", "before"])

    sent = chunked(placed.select("set")).join(placed, "set").select("set", "n_bytes", "k", "w", "more", "places")
    sent = sent.mapInArrow(send, "label bigint, set bigint, n_bytes bigint, k binary, w binary, more binary, here binary, before binary")
    # A place with too many documents is dealt by those that look up and by all.
    many = places.where(F.col("n") > block).select("label", F.ceil(F.col("n_asking") / block).cast("int").alias("parts_a"), F.ceil(F.col("n") / block).cast("int").alias("parts_b"))
    dealt = sent.join(F.broadcast(many) if many.count() < 10_000 else many, "label", "left").withColumns({p: F.coalesce(p, F.lit(1)) for p in ("parts_a", "parts_b")})
    part_a, part_b = (F.pmod(F.xxhash64("set"), F.col(p)).cast("int") for p in ("parts_a", "parts_b"))
    looks = F.length("here") > 0
    all_a, all_b = (F.sequence(F.lit(0), F.col(p) - 1) for p in ("parts_a", "parts_b"))
    as_asking = F.transform(F.filter(all_b, lambda q: looks), lambda q: F.struct(part_a.alias("i"), q.alias("j"), F.lit(True).alias("as_a"), (q == part_b).alias("as_b")))
    as_held = F.transform(F.filter(all_a, lambda q: ~looks | (q != part_a)), lambda q: F.struct(q.alias("i"), part_b.alias("j"), F.lit(False).alias("as_a"), F.lit(True).alias("as_b")))
    rows_ = dealt.withColumn("c", F.explode(F.concat(as_asking, as_held))).select(F.xxhash64("label", "c.i", "c.j").alias("g"), "c.as_a", "c.as_b", "set", "n_bytes", "k", "w", "more", "here", "before")

    @released
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            waiting.append(batch)
            if sum(b.num_rows for b in waiting) < 2048:
                continue
            table = pa.Table.from_batches(waiting).combine_chunks()
            last = int(np.searchsorted(table.column("g").to_numpy(), table.column("g")[-1].as_py()))
            if last:
                yield from _meet(table.slice(0, last), threshold, as_pairs)
                waiting = table.slice(last).combine_chunks().to_batches()
        if waiting:
            yield from _meet(pa.Table.from_batches(waiting).combine_chunks(), threshold, as_pairs)

    return members, classes, same, rows_.repartition("g").sortWithinPartitions("g", "set").mapInArrow(meet, PAIRS if as_pairs else NUMBERS)


PAIRS = "a bigint, b bigint, shared_bytes bigint, n_bytes bigint"
NUMBERS = "set bigint, n_containing bigint, n_contained bigint, best struct<shared:bigint,b:bigint>"


def _among(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Whether each value is in the sorted table."""
    at = np.searchsorted(table, values)
    return table[np.minimum(at, len(table) - 1)] == values if len(table) else np.zeros(len(values), bool)


def _at(label: np.ndarray, k: np.ndarray) -> np.ndarray:
    """A hash of each chunk at a place."""
    return mix(mix(label.view(np.uint64)) + k.view(np.uint64)).view(np.int64)


def _least(weight: np.ndarray, goal: float) -> int:
    """The fewest chunks that can weigh as much as the goal; more than there are if all don't."""
    return int(np.searchsorted(np.cumsum(-np.sort(-weight)), goal)) + 1


def _weights(table: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of each document's chunks, the chunks, and their weights (0 where none are sent), of columns k, w and more."""
    keys, w, more = (b"".join(table.column(c).to_pylist()) for c in ("k", "w", "more"))
    count, weighed = (pc.binary_length(table.column(c)).to_numpy().astype(np.int64) // unit for c, unit in (("k", 6), ("w", 1)))
    sent = np.frombuffer(w, np.uint8).astype(np.int64)
    sent[sent == 255] = np.frombuffer(more, "<i8")
    weight = np.zeros(int(count.sum()), np.int64)
    weight[np.repeat(weighed > 0, count)] = sent
    return count, _unpack(keys), weight


def _sets(digest: np.ndarray, weight: np.ndarray, until: np.ndarray) -> np.ndarray:
    """A hash of each document's chunks and weights."""
    value = mix(digest.view(np.uint64) + weight.astype(np.uint64) * U(_SPREAD | 1))
    return span_hash(value, until[:-1], until[1:]).view(np.int64)


def _blobs(raw: np.ndarray, offs: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(offs) - 1, [None, pa.py_buffer(offs.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw))]).cast(pa.binary())


def _meet(table: pa.Table, threshold: float, as_pairs: bool) -> Iterator[pa.RecordBatch]:
    """Documents of some places (column g, sorted): each that looks up chunks here is held against those that have one of them."""
    table = table.combine_chunks()
    n_rows = table.num_rows
    g, name, n = (table.column(c).to_numpy() for c in ("g", "set", "n_bytes"))
    as_a, as_b = (table.column(c).to_numpy(zero_copy_only=False) for c in ("as_a", "as_b"))
    here, before = (b"".join(table.column(c).to_pylist()) for c in ("here", "before"))
    size = lambda c, unit: pc.binary_length(table.column(c)).to_numpy().astype(np.int64) // unit
    count, keys, weight = _weights(table)
    until = np.concatenate([[0], np.cumsum(count)])
    values, chunk = np.unique(keys, return_inverse=True)
    row = np.repeat(np.arange(n_rows), count)
    # Postings of the chunks that are looked up here.
    own_k, own_until = np.searchsorted(values, _unpack(here)), np.concatenate([[0], np.cumsum(size("here", 6))])
    old_k, old_until = np.searchsorted(values, _unpack(before)), np.concatenate([[0], np.cumsum(size("before", 6))])
    looked = np.zeros(len(values), bool)
    looked[own_k] = True
    at = np.flatnonzero(looked[chunk] & as_b[row])
    at = at[np.lexsort((row[at], g[row[at]], chunk[at]))]
    posting, post_key = row[at], chunk[at]
    own = np.zeros(len(values), np.int64)
    earlier = np.zeros(len(values), bool)
    containing, contained = np.zeros(n_rows, np.int64), np.zeros(n_rows, np.int64)
    best, best_b = np.full(n_rows, -1, np.int64), np.zeros(n_rows, np.int64)
    found: list[tuple] = []
    for a in np.flatnonzero(as_a & (np.diff(own_until) > 0)).tolist():
        mine = own_k[own_until[a] : own_until[a + 1]]
        lo, hi = np.searchsorted(post_key, mine), np.searchsorted(post_key, mine, "right")
        others = np.unique(posting[ranges(lo, hi - lo)])
        others = others[(g[others] == g[a]) & (name[others] != name[a])]
        if not len(others):
            continue
        chunks_ = chunk[until[a] : until[a + 1]]
        own[chunks_] = weight[until[a] : until[a + 1]]
        earlier[old_k[old_until[a] : old_until[a + 1]]] = True
        for start in range(0, len(others), 4096):
            b = others[start : start + 4096]
            flat = chunk[ranges(until[b], count[b])]
            begin = np.cumsum(count[b]) - count[b]
            shared = np.add.reduceat(own[flat], begin)
            # A pair that an earlier place sees counts there.
            good = (shared >= threshold * n[a]) & ~np.logical_or.reduceat(earlier[flat], begin)
            b, shared = b[good], shared[good]
            if not len(b):
                continue
            if as_pairs:
                found.append((np.full(len(b), name[a]), name[b], shared, np.full(len(b), n[a])))
                continue
            containing[a] += len(b)
            contained[b] += 1
            top = int(np.lexsort((-name[b], shared))[-1])
            if (shared[top], -name[b[top]]) > (best[a], -best_b[a]):
                best[a], best_b[a] = shared[top], name[b[top]]
        own[chunks_] = 0
        earlier[old_k[old_until[a] : old_until[a + 1]]] = False
    if as_pairs:
        columns = [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, np.int64)] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b", "shared_bytes", "n_bytes"])
        return
    on = np.flatnonzero((containing > 0) | (contained > 0))
    top = pa.StructArray.from_arrays([pa.array(best[on]), pa.array(best_b[on])], ["shared", "b"], mask=pa.array(best[on] < 0))
    yield pa.RecordBatch.from_arrays([pa.array(name[on]), pa.array(containing[on]), pa.array(contained[on]), top], ["set", "n_containing", "n_contained", "best"])
