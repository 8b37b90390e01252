"""Token ids as Simple-8b words: 64-bit little-endian words of a 4-bit selector and 60 bits of payload.

Selector 0 is a run of 240 zeros, 2 to 15 hold 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2 or 1 values of equal width, and 1 is
the escape: the next word is a value of more than 60 bits, whole. Ids are grouped in blocks of ``BLOCK``; no word spans two
blocks, and the offset of each block's first word is kept, so blocks decode independently and all at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import DEFAULT_VOCABULARY, encoder
from .common import bytes_of, col, pieces, released, small_batches
from .kernels import Four, ranges, sliding

BLOCK = 240
U = np.uint64
#: (selector, values in a word, bits of each), densest first.
MODES = [(0, 240, 0), (2, 60, 1), (3, 30, 2), (4, 20, 3), (5, 15, 4), (6, 12, 5), (7, 10, 6), (8, 8, 7), (9, 7, 8), (10, 6, 10), (11, 5, 12), (12, 4, 15), (13, 3, 20), (14, 2, 30), (15, 1, 60)]
ESCAPE = 1
COUNT = np.zeros(16, np.int64)
WIDTH = np.zeros(16, np.int64)
for _s, _c, _b in MODES:
    COUNT[_s], WIDTH[_s] = _c, _b
COUNT[ESCAPE] = 1
_SHORT_BITS = np.array([i.bit_length() for i in range(1 << 16)], np.uint8)


def _bit_lengths(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values), np.uint8)
    for shift in (48, 32, 16, 0) if len(values) and int(values.max()) >> 16 else (0,):
        part = _SHORT_BITS[((values >> U(shift)) & U(0xFFFF)).astype(np.int64)]
        out = np.where((out == 0) & (part > 0), part + np.uint8(shift), out)
    return out


def pack(values: np.ndarray, offs: np.ndarray, block: int = BLOCK) -> Four:
    """Encode texts' ids, values[offs[i]:offs[i + 1]] being those of text i.

    Gives the words, the n + 1 offsets of the texts in them, each block's first word counted from its text's first, and the
    n + 1 offsets of the texts in the blocks.
    """
    values = values.astype(np.uint64)
    n, sizes = len(values), np.diff(offs)
    blocks = -(-sizes // block)
    block_offs = np.concatenate([[0], np.cumsum(blocks)])
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offs), np.int64), np.zeros(0, np.int64), block_offs
    first = np.repeat(offs[:-1], blocks) + block * (np.arange(block_offs[-1]) - np.repeat(block_offs[:-1], blocks))
    last = np.minimum(first + block, np.repeat(offs[1:], blocks))
    bits = _bit_lengths(values)
    taken = np.ones(n, np.uint8)
    selector = np.where(bits > 60, ESCAPE, 15).astype(np.uint8)
    # The densest mode whose width holds the next values, from the sparsest mode on.
    widest, reach = bits, 1
    for s, c, b in reversed(MODES):
        if c > n:
            break
        if c > 15:
            if not (good := sliding(bits <= b, c, np.logical_and)).any():
                continue
        else:
            while reach < c:
                widest = np.maximum(widest[:-1], bits[reach:])
                reach += 1
            good = widest <= b
        np.putmask(taken[: len(good)], good, c)
        np.putmask(selector[: len(good)], good, s)
    # Close to a block's end the modes that would run over it are judged by the values that are left, and hold only those.
    back = np.arange(1, min(int(COUNT.max()), block) + 1) if n and int(taken.max()) > 15 else np.arange(1, min(15, block) + 1)
    tail = last[:, None] - back
    inside = tail >= first[:, None]
    tail = np.where(inside, tail, last[:, None] - 1)
    rest = np.maximum.accumulate(np.where(inside, bits[tail], 0), axis=1)
    for s, c, b in reversed(MODES):
        whole = inside & (back <= c) & (rest <= b)
        taken[tail[whole]] = np.broadcast_to(back, rest.shape)[whole]
        selector[tail[whole]] = s
    over = inside & (taken[tail] > back)
    if over.any():  # a mode that looked past the block's end, where the values left need one that is less dense
        for t, k in zip(tail[over].tolist(), np.broadcast_to(back, rest.shape)[over].tolist()):
            s, c = next(((s, c) for s, c, b in MODES if (bits[t : t + min(c, k)] <= b).all()), (ESCAPE, 1))
            taken[t], selector[t] = min(c, k), s
    begins = np.zeros(n, bool)
    at, end = first.copy(), last
    while len(at):
        begins[at] = True
        at = at + taken[at]
        on = at < end
        at, end = at[on], end[on]
    where = np.flatnonzero(begins)
    sel, cnt = selector[where].astype(np.int64), taken[where].astype(np.int64)
    escaped = sel == ESCAPE
    place = np.cumsum(1 + escaped) - (1 + escaped)
    words = np.zeros(int((1 + escaped).sum()), np.uint64)
    for s, c, b in MODES:
        mine = np.flatnonzero(sel == s)
        if not len(mine):
            continue
        word = np.full(len(mine), U(s) << U(60))
        for j in range(c if b else 0):
            has = j < cnt[mine]
            word |= np.where(has, values[np.minimum(where[mine] + j, n - 1)], U(0)) << U(b * j)
        words[place[mine]] = word
    if escaped.any():
        words[place[escaped]] = U(ESCAPE) << U(60)
        words[place[escaped] + 1] = values[where[escaped]]
    bounds = np.append(place, len(words))
    word_offs = bounds[np.searchsorted(where, offs)]
    return words, word_offs, bounds[np.searchsorted(where, first)] - np.repeat(word_offs[:-1], blocks), block_offs


def unpack(words: np.ndarray, starts: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
    """Decode one text of n ids: all blocks advance together, one word each a step."""
    out = np.zeros(n, np.uint64)
    at = np.asarray(starts, np.int64).copy()
    put = np.arange(len(at), dtype=np.int64) * block
    end = np.minimum(put + block, n)
    while len(at):
        w = words[at]
        sel = (w >> U(60)).astype(np.int64)
        cnt = np.minimum(COUNT[sel], end - put)
        for s in np.unique(sel):
            mine = np.flatnonzero(sel == s)
            if s == ESCAPE:
                out[put[mine]] = words[at[mine] + 1]
                continue
            b = int(WIDTH[s])
            if not b:
                continue
            flat = ranges(put[mine], cnt[mine])
            j = flat - np.repeat(put[mine], cnt[mine])
            out[flat] = (np.repeat(w[mine], cnt[mine]) >> (j * b).astype(np.uint64)) & ((U(1) << U(b)) - U(1))
        at, put = at + 1 + (sel == ESCAPE), put + cnt
        on = put < end
        at, put, end = at[on], put[on], end[on]
    return out


def decode(words: bytes, starts: list[int], n: int, block: int = BLOCK) -> np.ndarray:
    """The ids of a row of ``encode_documents``."""
    return unpack(np.frombuffer(words, "<u8"), np.asarray(starts, np.int64), n, block)


def encode_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, words (binary) and block_offsets (array of int) of each row; a map without shuffle.

    Every row gives one row, repeated rows and null doc_ids included. A null text gives null words and offsets and null
    n_tokens; an empty text gives empty ones. Texts are encoded whole, however long. Other columns are not carried.
    """

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        for batch in batches:
            for part in pieces(batch, "t"):
                t = part.column(1)
                buf, offs = bytes_of(t)
                ids, id_offs = encode(buf, offs)
                words, word_offs, starts, block_offs = pack(ids, id_offs)
                gone = np.asarray(t.is_null())
                raw = pa.Array.from_buffers(pa.large_binary(), len(t), [None, pa.py_buffer((word_offs * 8).astype(np.int64)), pa.py_buffer(words.astype("<u8"))])
                lists = pa.ListArray.from_arrays(pa.array(block_offs.astype(np.int32)), pa.array(starts.astype(np.int32)))
                if gone.any():
                    raw = pa.array([None if g else v for g, v in zip(gone, raw.to_pylist())], pa.large_binary())
                    lists = pa.array([None if g else v for g, v in zip(gone, lists.to_pylist())], pa.list_(pa.int32()))
                n = pa.array(np.diff(id_offs), pa.int64(), mask=gone)
                yield pa.RecordBatch.from_arrays([part.column(0), n, raw.cast(pa.binary()), lists], ["doc_id", "n_tokens", "words", "block_offsets"])

    small_batches(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(col(doc_id).alias("d"), col(text).alias("t")).mapInArrow(run, f"doc_id {kind}, n_tokens bigint, words binary, block_offsets array<int>")


def total_bytes(encoded: DataFrame) -> DataFrame:
    return encoded.agg(F.sum("n_tokens").alias("n_tokens"), F.sum(F.length("words")).alias("n_bytes"))
