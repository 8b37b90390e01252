"""Suffix-array dedup: passages of at least ``LENGTH`` words that occur again are found by threshold-bounded interval expansion.

Beller, Gog, Ohlebusch and Schnattinger (2013) derive common prefixes from a Burrows-Wheeler transform breadth first: the
interval of the empty string is extended to the left by every symbol, the right end of each new interval of depth l is where the
common prefix with the next suffix has l symbols, if nothing was set there before, and only such intervals are extended again.
Values come out by increasing size, so the search stops at depth ``LENGTH``: the entries that are still unset are those of
suffixes that share at least ``LENGTH`` words with their neighbour.

To spread this over a cluster, occurrences are brought together by content. Of every ``LENGTH`` consecutive words, the run of
``ANCHOR`` words with the least hash is an anchor (winnowing), so a passage that occurs twice has the same anchors at the same
places. Only anchors that occur twice matter; around each occurrence the words that a passage of ``LENGTH`` could reach are cut
out, and the cuttings of an anchor meet in one partition, sorted by content. Of equal cuttings all but the first are repeats as
they stand; the transform is built over the different ones. An anchor with more than ``GROUP`` symbols of different cuttings is
split: a passage around it has so many words to its left or so many to its right, so the cuttings meet again by the anchor
lengthened to either side, step by step until it is short enough of the passage (at last it is the passage, and all cuttings are
equal). So no group is held whole, and the search is the same at every size. Words are compared by 32 bits of their hashes, anchors
by 64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, col, cut, fresh, join_keys, pieces, ranks, released, small_batches, split, text_hash, written
from .kernels import U, Three, Two, mix, powers, ranges, sliding, span_hash, spans, word_hashes

#: Words of a repeated passage at least, and of an anchor.
LENGTH, ANCHOR = 50, 20
#: Symbols over which one transform is built, and of an anchor's different cuttings before it is lengthened.
BATCH, GROUP = 250_000, 1_000_000


def gram_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words."""
    n = len(h)
    power, inverse = powers(n + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * power[:n])])
    return mix((total[size:] - total[:-size]) * inverse[: n - size + 1])


def anchors(h: np.ndarray, words: np.ndarray, length: int = LENGTH, size: int = ANCHOR) -> Two:
    """Positions and hashes of the anchors of all texts; words are the n + 1 word offsets of the texts."""
    if len(h) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    width = length - size + 1
    g = gram_hashes(h, size)
    least = sliding(g, width)
    end = np.repeat(words[1:], np.diff(words))
    whole = np.arange(len(least)) + length <= end[: len(least)]
    least = np.where(whole, least, U(0))
    padded = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    most = sliding(padded, width, np.maximum)[: len(g)]
    where = np.flatnonzero((most == g) & (g != 0))
    return where, g[where]


def suffix_array(s: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes ordered by their first ``depth`` symbols at least, by prefix tripling: three ranks make one sort key."""
    n = len(s)
    _, rank = np.unique(s, return_inverse=True)
    rank, k = rank.astype(np.int64) + 1, 1
    order = np.argsort(rank, kind="stable")
    ways = 3 if n < (1 << 21) - 2 else 2
    bits = U(n + 1).item().bit_length()
    while k < depth:
        key = rank << bits * (ways - 1)
        for j in range(1, ways):
            if j * k < n:
                key[: n - j * k] |= rank[j * k :] << bits * (ways - 1 - j)
        order = np.argsort(key)
        sorted_ = key[order]
        new = np.cumsum(np.concatenate([[1], (sorted_[1:] != sorted_[:-1]).astype(np.int64)]))
        rank = np.empty(n, np.int64)
        rank[order] = new
        k *= ways
        if new[-1] == n:
            break
    return order


def expand(s: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """For each place in the suffix order, whether at least ``depth`` symbols are shared with the place before."""
    n = len(s)
    inverse = np.empty(n, np.int64)
    inverse[order] = np.arange(n)
    back = inverse[order - 1]  # LF mapping; the text is taken as a circle
    front = s[order]
    set_ = np.zeros(n + 1, bool)
    set_[0] = set_[n] = True
    lb, rb = np.zeros(1, np.int64), np.full(1, n - 1, np.int64)
    for _ in range(depth):
        if not len(lb):
            break
        sizes = rb - lb + 1
        y = back[ranges(lb, sizes)]
        own = np.repeat(np.arange(len(lb)), sizes)
        by = np.argsort(y)
        y, own = y[by], own[by]
        symbol = front[y]
        edge = np.flatnonzero((y[1:] != y[:-1] + 1) | (own[1:] != own[:-1]) | (symbol[1:] != symbol[:-1]))
        left = y[np.concatenate([[0], edge + 1])]
        right = y[np.concatenate([edge, [len(y) - 1]])]
        on = ~set_[right + 1]
        lb, rb = left[on], right[on]
        set_[rb + 1] = True
    return ~set_[:n]


def classes(segments: list[np.ndarray], length: int = LENGTH) -> Three:
    """Class, segment and place in it of every run of ``length`` words; equal runs have the same class."""
    n = len(segments)
    sizes = np.array([len(x) for x in segments])
    flat = np.zeros(int(sizes.sum()) + n, np.int64)
    begin = np.cumsum(sizes + 1) - (sizes + 1)
    flat[ranges(begin, sizes)] = np.concatenate(segments).astype(np.int64) + n
    flat[begin + sizes] = np.arange(n)  # each segment ends with a symbol of its own
    order = suffix_array(flat, length)
    own = np.cumsum(~expand(flat, order, length))
    seg = np.searchsorted(begin, order, "right") - 1
    place = order - begin[seg]
    on = place + length <= sizes[seg]
    return own[on], seg[on], place[on]


def _edges(*sorted_: np.ndarray) -> np.ndarray:
    """Where a new combination of values begins."""
    new = np.zeros(len(sorted_[0]), bool)
    new[:1] = True
    for x in sorted_:
        new[1:] |= x[1:] != x[:-1]
    return new


def _marks(anchor: np.ndarray, doc: np.ndarray, word: np.ndarray, segments: list[np.ndarray], length: int) -> list[np.ndarray]:
    """(document, from, to, first's document, from) for every stretch of runs that aren't the first of their class.

    The arrays describe cuttings: anchor, rank of the document, first word; segments are their words.
    """
    cls, seg, place = classes(segments, length)
    d, w = doc[seg], word[seg] + place
    by = np.lexsort((w, d, cls))
    cls, d, w = cls[by], d[by], w[by]
    head = _edges(cls)
    f = np.flatnonzero(head)[np.cumsum(head) - 1]
    later = (d != d[f]) | (w != w[f])
    d, w, fd, fw = d[later], w[later], d[f][later], w[f][later]
    if not len(d):
        return [d, w, w, fd, fw]
    by = np.lexsort((w, w - fw, fd, d))
    d, w, fd, fw = d[by], w[by], fd[by], fw[by]
    start = _edges(d, fd, w - fw)
    start[1:] |= w[1:] > w[:-1] + 1
    s = np.flatnonzero(start)
    e = np.append(s[1:], len(d)) - 1
    return [d[s], w[s], w[e] + length, fd[s], fw[s]]


def _words(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The 32-bit words of binary values and the n + 1 offsets of the values in them."""
    until = np.frombuffer(array.buffers()[1], np.int32, len(array) + 1, array.offset * 4).astype(np.int64)
    data = array.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[until[0] : until[-1]].copy().view(np.uint32) if data is not None else np.zeros(0, np.uint32)
    return flat, (until - until[0]) // 4


def _binary(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offs = np.concatenate([[0], np.cumsum(sizes * 4)])
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offs.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(flat))]).cast(pa.binary())


def find_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """doc_id, h, first_word, end_word, from_id, from_h, from_word: stretches of words that an earlier place has too.

    A stretch holds the words [first_word, end_word) of the text, of at least ``length`` words, all of whose runs of ``length``
    words occur before (stretches may be listed more than once): in a document with a smaller doc_id (a null one is the largest, h
    decides between equals) or earlier in the same. from_id and from_word are such a place. Words are parted by ASCII white space
    and compared as they stand, whole texts of any length. Stretches of a document may overlap. Null, empty and shorter texts have
    none, but what other rows repeat of a document counts, whatever its other columns hold; rows with equal doc_id and text are one
    document. An empty table gives no rows. ``group`` only bounds memory: the result doesn't depend on it.
    """
    small_batches(docs.sparkSession)
    size = min(ANCHOR, length)
    reach = length - size
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(col(doc_id).alias("d"), text_hash(text).alias("h"), col(text).alias("t"))

    @released
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "t"):
                buf, offs = bytes_of(part.column(2))
                starts, ends, words = spans(buf, offs)
                where, a = anchors(word_hashes(buf, starts, ends), words, length, size)
                doc = np.searchsorted(words, where, "right") - 1
                take = pa.array(doc)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), part.column(0).take(take), part.column(1).take(take), pa.array((where - words[doc]).astype(np.int32))], ["a", "d", "h", "w"])

    found = rows.mapInArrow(find, f"a bigint, d {kind}, h bigint, w int")
    by_anchor = found.repartition("a").sortWithinPartitions("a")

    @released
    def twice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows whose anchor occurs again; the last group of a batch waits for the next."""
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if rest is not None:
                table = pa.concat_tables([rest, table])
            a = table.column(0).to_numpy()
            if not len(a):
                continue
            last = int(np.searchsorted(a, a[-1])) if a[0] != a[-1] else 0
            same = np.concatenate([[False], a[1:] == a[:-1]])
            same[:-1] |= same[1:]
            if last:
                yield from table.slice(0, last).filter(pa.array(same[:last])).combine_chunks().to_batches()
            elif len(a) > 200_000:  # one anchor fills all that was read: pass it on
                yield from table.slice(0, len(a) - 2).combine_chunks().to_batches()
                last = len(a) - 2
            rest = table.slice(last)
        if rest is not None and rest.num_rows > 1:
            yield from rest.combine_chunks().to_batches()

    hits = by_anchor.mapInArrow(twice, by_anchor.schema).groupBy("d", "h").agg(F.sort_array(F.collect_set(F.struct("w", "a"))).alias("hits"))
    hits = cut(hits.toDF("hd", "hh", "hits"))
    near, _ = split(rows, "h", hits.select("hh"))
    cuts = join_keys(near, hits, [("h", "hh"), ("d", "hd")]).groupBy("d", "h").agg(F.first("t").alias("t"), F.first("hits").alias("hits"))

    @released
    def clip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "t"):
                buf, offs = bytes_of(part.column(2))
                starts, ends, words = spans(buf, offs)
                w32 = (word_hashes(buf, starts, ends) >> U(32)).astype(np.uint32)
                hit = part.column(3)
                counts = np.diff(hit.offsets.to_numpy())
                flat = hit.flatten()
                w, a = flat.field(0).to_numpy().astype(np.int64), flat.field(1)
                doc = np.repeat(np.arange(part.num_rows), counts)
                lo = np.maximum(w - reach, 0)
                hi = np.minimum(w + size + reach, np.diff(words)[doc])
                flat32 = w32[ranges(words[doc] + lo, hi - lo)]
                content = span_hash(w32.astype(np.uint64) + U(1), words[doc] + lo, words[doc] + hi)
                take, none = pa.array(doc), pa.array(np.zeros(len(w), np.int32))
                yield pa.RecordBatch.from_arrays(
                    [a, part.column(0).take(take), part.column(1).take(take), pa.array(lo.astype(np.int32)), pa.array((w - lo).astype(np.int32)), none, none, _binary(flat32, hi - lo), pa.array(content.view(np.int64))], names
                )

    def solve(table: pa.Table) -> Iterator[pa.RecordBatch]:
        """The stretches of the groups; a cutting that is alone needs no search."""
        a = table.column("a").to_numpy()
        edge = _edges(a)
        many = np.diff(np.append(np.flatnonzero(edge), len(a)))[np.cumsum(edge) - 1] > 1
        table = table.filter(pa.array(many)).combine_chunks()
        if not table.num_rows:
            return
        d, h = table.column("d").combine_chunks(), table.column("h").combine_chunks()
        ids, hashes = ranks(d), h.to_numpy()
        by = np.lexsort((hashes, ids))
        new = _edges(ids[by], hashes[by])
        doc = np.empty(len(by), np.int64)
        doc[by] = np.cumsum(new) - 1
        name = by[new]
        flat, until = _words(table.column("s").combine_chunks())
        own, first, end, from_, word = _marks(a[many], doc, table.column("w").to_numpy().astype(np.int64), [flat[i:j] for i, j in zip(until[:-1].tolist(), until[1:].tolist())], length)
        yield stretches(d, h, name[own], first, end, name[from_], word)

    def stretches(d, h, own, first, end, from_, word) -> pa.RecordBatch:
        own, from_ = pa.array(own), pa.array(from_)
        n = len(own)
        found = [d.take(own), h.take(own), pa.array(first.astype(np.int32)), pa.array(end.astype(np.int32)), d.take(from_), h.take(from_), pa.array(word.astype(np.int32))]
        return pa.RecordBatch.from_arrays([*found, pa.nulls(n, pa.int64()), *[pa.nulls(n, pa.int32())] * 3, pa.nulls(n, pa.binary())], both)

    def left_over(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        """Cuttings of an anchor that has too many different ones, to be met again by longer anchors."""
        for b in rows.combine_chunks().to_batches():
            none = pa.nulls(b.num_rows, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("d"), b.column("h"), b.column("w"), none, pa.nulls(b.num_rows, b.schema.field("d").type), pa.nulls(b.num_rows, pa.int64()), none, b.column("a"), b.column("x"), b.column("l"), b.column("r"), b.column("s")], both)

    @released
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.Table] = []  # different cuttings, whose anchors aren't complete or that wait for more
        symbols, hot = 0, None
        last = None  # the last row of the slice before
        lead = None  # the first of the cuttings that equal it, as one row
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                table = pa.Table.from_batches([batch.slice(at, step)])
                if last is not None:
                    table = pa.concat_tables([lead, last, table])
                table = table.combine_chunks()
                skip = 2 if last is not None else 0
                a, c = table.column("a").to_numpy(), table.column("c").to_numpy()
                d, h, w = table.column("d").combine_chunks(), table.column("h").combine_chunks(), table.column("w").to_numpy().astype(np.int64)
                _, until = _words(table.column("s").combine_chunks())
                sizes = np.diff(until)
                new = _edges(a, c)
                first = np.flatnonzero(new)[np.cumsum(new) - 1]
                # A place comes again where its cutting holds the anchor twice; such rows are searched.
                head = (new | ~_edges(a, c, ranks(d), h.to_numpy(), w)) & (np.arange(len(a)) >= skip)
                follow = np.flatnonzero(~new & ~head & (np.arange(len(a)) >= skip) & (sizes >= length))
                if len(follow):
                    yield stretches(d, h, follow, w[follow], w[follow] + sizes[follow], first[follow], w[first[follow]])
                lead, last = table.slice(int(first[-1]), 1), table.slice(len(a) - 1, 1)
                heads, head_sizes = table.filter(pa.array(head)), sizes[head]
                if hot is not None:
                    mine = int(np.searchsorted(heads.column("a").to_numpy(), hot, "right"))
                    if mine:
                        yield from left_over(heads.slice(0, mine))
                        heads, head_sizes = heads.slice(mine), head_sizes[mine:]
                    if a[-1] != hot:
                        hot = None
                if heads.num_rows:
                    waiting.append(heads)
                    symbols += int(head_sizes.sum())
                if symbols < enough or not waiting:
                    continue
                held = pa.concat_tables(waiting).combine_chunks()
                ha = held.column("a").to_numpy()
                done = int(np.searchsorted(ha, a[-1]))
                if done:
                    yield from solve(held.slice(0, done))
                    held = held.slice(done).combine_chunks()
                symbols = len(_words(held.column("s").combine_chunks())[0]) if held.num_rows else 0
                if symbols > group:
                    hot = int(a[-1])
                    yield from left_over(held)
                    held, symbols = held.slice(0, 0), 0
                waiting = [held] if held.num_rows else []
        if waiting:
            yield from solve(pa.concat_tables(waiting).combine_chunks())

    @released
    def lengthen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, left, right = (batch.column(k).to_numpy().astype(np.int64) for k in ("x", "l", "r"))
            flat, until = _words(batch.column("s"))
            value, n = flat.astype(np.uint64) + U(1), np.diff(until)
            free = reach - left - right
            more = (free + 1) // 2
            for l, r in ((left + more, right), (left, right + free - more + 1)):
                on = np.flatnonzero((free > 0) & (x >= l) & (n - x - size >= r))
                lo = np.maximum(x - (reach - r), 0)
                hi = np.minimum(n, x + size + reach - l)
                on = on[(hi - lo)[on] >= length]
                key = mix(span_hash(value, (until[:-1] + x - l)[on], (until[:-1] + x + size + r)[on]) + (l * 4096 + r + 1)[on].astype(np.uint64) * U(0x9E3779B97F4A7C15))
                content = span_hash(value, until[:-1][on] + lo[on], until[:-1][on] + hi[on])
                take = pa.array(on)
                s = _binary(flat[ranges(until[:-1][on] + lo[on], (hi - lo)[on])], (hi - lo)[on])
                ints = [pa.array(v.astype(np.int32)) for v in (batch.column("w").to_numpy()[on] + lo[on], (x - lo)[on], l[on], r[on])]
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column("d").take(take), batch.column("h").take(take), *ints, s, pa.array(content.view(np.int64))], names)

    enough = min(BATCH, group)
    step = max(1, enough // (2 * length))
    names = ["a", "d", "h", "w", "x", "l", "r", "s", "c"]
    both = ["doc_id", "h", "first_word", "end_word", "from_id", "from_h", "from_word", "a", "x", "l", "r", "s"]
    cutting = f"a bigint, d {kind}, h bigint, w int, x int, l int, r int, s binary, c bigint"
    out = f"doc_id {kind}, h bigint, first_word int, end_word int, from_id {kind}, from_h bigint, from_word int, a bigint, x int, l int, r int, s binary"
    cuttings, done = cuts.mapInArrow(clip, cutting), None
    for _ in range(reach.bit_length() + 1):  # each step halves the words that are free
        grouped = cuttings.repartition("a").sortWithinPartitions("a", "c", F.col("d").isNull(), "d", "h", "w")
        solved = written(grouped.mapInArrow(search, out))
        found = solved.where("s is null").select(both[:7])
        done = found if done is None else done.unionByName(found)
        rest = solved.where("s is not null")
        if rest.isEmpty():
            break
        cuttings = rest.select("a", F.col("doc_id").alias("d"), "h", F.col("first_word").alias("w"), "x", "l", "r", "s").mapInArrow(lengthen, cutting)
    return done


def merge_stretches(found: DataFrame) -> DataFrame:
    """doc_id, h, first_word, end_word, n_words, from_ids: the union of each document's stretches, as disjoint spans."""

    @released
    def union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {k: [] for k in ("doc_id", "h", "first_word", "end_word", "n_words", "from_ids")}
            for d, h, spans_ in zip(*(batch.column(i).to_pylist() for i in range(3))):
                lo = hi = None
                for s in [*spans_, None]:
                    if s is None or hi is None or s["first_word"] > hi:
                        if hi is not None:
                            for k, v in zip(rows, (d, h, lo, hi, hi - lo, sorted(ids))):
                                rows[k].append(v)
                        if s is None:
                            break
                        lo, hi, ids = s["first_word"], s["end_word"], set()
                    hi = max(hi, s["end_word"])
                    if s["from_id"] is not None:
                        ids.add(s["from_id"])
            yield pa.RecordBatch.from_pydict(rows, pa.schema([("doc_id", batch.schema.field(0).type), ("h", pa.int64()), ("first_word", pa.int32()), ("end_word", pa.int32()), ("n_words", pa.int32()), ("from_ids", pa.list_(batch.schema.field(0).type))]))

    kind = found.schema["doc_id"].dataType.simpleString()
    lists = found.groupBy("doc_id", "h").agg(F.sort_array(F.collect_list(F.struct("first_word", "end_word", "from_id"))).alias("s"))
    return lists.mapInArrow(union, f"doc_id {kind}, h bigint, first_word int, end_word int, n_words int, from_ids array<{kind}>")


def repeated_spans(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """The spans that ``suffix_dedup`` deletes: doc_id, h, first_word, end_word, n_words, from_ids (see ``find_repeats``)."""
    return merge_stretches(find_repeats(docs, text, doc_id, length, group))


def suffix_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH, n_chars: str = "n_chars") -> DataFrame:
    """docs with every passage of at least ``length`` words deleted that occurs before, the first place staying as it is.

    A deleted passage goes with the white space after it. A document of which nothing but white space is left goes; others keep
    all their columns, n_chars (if there is such a column) being counted again where words were deleted. Documents without
    repeats, null and empty texts among them, stay untouched. Of rows with equal doc_id and text each is treated alike; an empty
    table gives an empty table.
    """
    spans_ = cut(repeated_spans(docs, text, doc_id, length).groupBy("doc_id", "h").agg(F.sort_array(F.collect_list(F.struct("first_word", "end_word"))).alias("s")))
    h, sd, sh, s = fresh(docs, "h", "sd", "sh", "s")
    spans_ = spans_.select(F.col("doc_id").alias(sd), F.col("h").alias(sh), F.col("s").alias(s))
    near, far = split(docs.withColumn(h, text_hash(text)), h, spans_.select(sh))
    joined = join_keys(near, spans_, [(h, sh), (doc_id, sd)], "left").drop(h, sd, sh)
    untouched = joined.where(F.col(s).isNull()).drop(s)

    def cut_out(texts: pd.Series, spans_: pd.Series) -> pd.Series:
        return pd.Series([delete_words(t, [(x["first_word"], x["end_word"]) for x in xs]) for t, xs in zip(texts, spans_)])

    less = joined.where(F.col(s).isNotNull()).withColumn(text, F.pandas_udf(cut_out, "string")(col(text), F.col(s))).where(F.length(F.trim(col(text))) > 0).drop(s)
    if n_chars in docs.columns:
        less = less.withColumn(n_chars, F.length(col(text)).cast(docs.schema[n_chars].dataType))
    out = untouched.unionByName(less)
    return far.drop(h).unionByName(out)


def delete_words(text: str, spans_: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and the white space after each."""
    raw = np.frombuffer(text.encode(), np.uint8)
    starts, _, _ = spans(raw, np.array([0, len(raw)]))
    stops = np.append(starts, len(raw))
    keep = np.ones(len(raw), bool)
    for a, b in spans_:
        keep[starts[a] : stops[b]] = False
    return raw[keep].tobytes().decode()


__all__ = ["find_repeats", "repeated_spans", "suffix_dedup"]
