"""Byte-level BPE by corpus-level merge replay, and its inverse.

The distinct pre-tokens of all texts at hand are laid out once as rows of byte symbols. An inverted index maps each token pair
to the places where it stands; the merges are then replayed in rank order over the whole collection, each visiting only the
places that the index has for its pair, and only the pairs with the merged token's two neighbours enter the index anew. A merge
of a later rank never precedes its parts', so one pass over the ranks gives what the usual loop over each word gives. The corpus
that is replayed together is a task's part of the table: every distinct pre-token in it is merged once, however often it occurs.
It is read in steps of ``CORPUS_BYTES``, each of which replays the pre-tokens that are new; what is known is given up and learnt
again only beyond ``KNOWN_BYTES`` of distinct pieces, which bounds memory and doesn't change the ids.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import _WIDE_SPACE, PATTERN
from .common import bytes_of, col, pieces, released, small_batches
from .kernels import BYTE_HASH, SPACE, Two, ranges, span_hash

DEFAULT_MERGES = "/opt/tokenizers/byte_bpe_50k.json"
#: Bytes of text that are read before their new pre-tokens are replayed, and bytes of distinct pieces that are kept at most.
CORPUS_BYTES, KNOWN_BYTES = 8 << 20, 24 << 20
_WORDS = regex.compile(PATTERN)
_loaded: dict[str, "Merges"] = {}


def _byte_symbols() -> dict[str, int]:
    """The printable stand-ins of bytes that byte-level vocabularies write tokens with."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Merges:
    """Merge table of a vocabulary file: ranks of pairs, merged ids, bytes of ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocabulary, byte_of = model["vocab"], _byte_symbols()
        self.size = max(vocabulary.values()) + 1
        self.tokens = [b""] * self.size
        for token, i in vocabulary.items():
            if all(c in byte_of for c in token):
                self.tokens[i] = bytes(byte_of[c] for c in token)
        self.of_byte = np.zeros(256, np.int32)
        for c, b in byte_of.items():
            self.of_byte[b] = vocabulary[c]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.left = np.array([vocabulary[a] for a, _ in pairs], np.int64)
        self.right = np.array([vocabulary[b] for _, b in pairs], np.int64)
        self.merged = np.array([vocabulary[a + b] for a, b in pairs], np.int32)
        key = self.left * self.size + self.right
        self.rank_of = np.argsort(key, kind="stable")
        self.keys = key[self.rank_of]
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.pool = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where it has none."""
        key = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank_of[at], -1)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of a run of ids."""
        return self.pool[ranges(self.starts[ids], self.lengths[ids])]


def merges(path: str = DEFAULT_MERGES) -> Merges:
    if path not in _loaded:
        _loaded[path] = Merges(path)
    return _loaded[path]


def replay(table: Merges, words: list[bytes]) -> Two:
    """The ids of all words in one array, and the words' n + 1 offsets in it."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    symbol = table.of_byte[np.frombuffer(b"".join(words), np.uint8)]
    n = len(symbol)
    offs = np.concatenate([[0], np.cumsum(lengths)])
    if not n:
        return np.zeros(0, np.int32), np.zeros(len(words) + 1, np.int64)
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    filled = lengths > 0
    after[offs[1:][filled] - 1] = -1
    before[offs[:-1][filled]] = -1
    alive = np.ones(n, bool)
    index: list[list[np.ndarray] | None] = [None] * len(table.merged)

    def enter(where: np.ndarray, rank: np.ndarray) -> None:
        on = rank >= 0
        where, rank = where[on], rank[on]
        if not len(rank):
            return
        if len(rank) > 1:
            by = np.argsort(rank, kind="stable")
            where, rank = where[by], rank[by]
            edge = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            parts, firsts = np.split(where, edge), rank[np.concatenate([[0], edge])].tolist()
        else:
            parts, firsts = [where], rank.tolist()
        for r, part in zip(firsts, parts):
            if index[r] is None:
                index[r] = [part]
            else:
                index[r].append(part)

    first = np.flatnonzero(after >= 0)
    enter(first, table.ranks(symbol[first], symbol[first + 1]))
    lefts, rights, made = table.left.tolist(), table.right.tolist(), table.merged.tolist()
    for rank in range(len(made)):
        if index[rank] is None:
            continue
        found = index[rank]
        index[rank] = None
        at = found[0] if len(found) == 1 else np.concatenate(found)
        if len(at) > 1:
            at = np.unique(at)
        next_ = after[at]
        good = alive[at] & (symbol[at] == lefts[rank]) & (next_ >= 0)
        good &= symbol[next_] == rights[rank]
        at, next_ = at[good], next_[good]
        if not len(at):
            continue
        if lefts[rank] == rights[rank] and len(at) > 1 and (next_[:-1] == at[1:]).any():
            keep, taken = [], -1  # a run of equal tokens pairs up from the left
            for a, b in zip(at.tolist(), next_.tolist()):
                keep.append(a != taken)
                if a != taken:
                    taken = b
            at, next_ = at[keep], next_[keep]
        symbol[at] = made[rank]
        alive[next_] = False
        far = after[next_]
        after[at] = far
        more = far >= 0
        before[far[more]] = at[more]
        near = before[at]
        has = near >= 0
        left_at, right_at = near[has], at[more]
        where = np.concatenate([left_at, right_at])
        if len(where):
            enter(where, table.ranks(symbol[where], symbol[after[where]]))
    left = np.concatenate([[0], np.cumsum(alive)])
    return symbol[alive], left[offs]


class Pool:
    """An array that grows at its end."""

    def __init__(self, kind: type):
        self.values, self.n = np.zeros(1 << 12, kind), 0

    def add(self, more: np.ndarray) -> None:
        if self.n + len(more) > len(self.values):
            self.values = np.concatenate([self.values[: self.n], np.zeros(self.n + 2 * len(more), self.values.dtype)])
        self.values[self.n : self.n + len(more)] = more
        self.n += len(more)


class Corpus:
    """Texts that are encoded together: the ids of their distinct pieces, and the batches that wait for them."""

    def __init__(self, table: Merges, most: int = KNOWN_BYTES):
        self.table, self.most = table, most
        self.parts: list[tuple] = []
        self.size = 0
        self.forget()

    def forget(self) -> None:
        self.known: dict[int, int] = {}  # piece hash -> piece
        self.word: dict[str, int] = {}  # pre-token -> number
        self.ids, self.until = Pool(np.int32), Pool(np.int64)  # of the pre-tokens
        self.piece_ids, self.piece_until = Pool(np.int32), Pool(np.int64)
        self.until.add(np.zeros(1, np.int64))
        self.piece_until.add(np.zeros(1, np.int64))
        self.new_words: list[str] = []
        self.new_pieces: list[list[int]] = []
        self.bytes = 0

    def add(self, batch: pa.RecordBatch, column: int) -> None:
        buf, offs = bytes_of(batch.column(column))
        self.size += len(buf)
        if not len(buf):
            self.parts.append((batch, buf, offs, np.zeros(0, np.int32), np.zeros(len(offs), np.int64)))
            return
        raw = buf.tobytes()
        space = SPACE[buf]
        for m in _WIDE_SPACE.finditer(raw):
            space[m.end() - 1] = True
        begin = np.zeros(len(buf), bool)
        begin[1:] = (buf[1:] == 32) & ~space[:-1]
        begin[offs[:-1][offs[:-1] < len(buf)]] = True
        starts = np.flatnonzero(begin)
        ends = np.append(starts[1:], len(buf))
        h, first, back = np.unique(span_hash(BYTE_HASH[buf], starts, ends), return_index=True, return_inverse=True)
        piece = np.empty(len(h), np.int32)
        for i, (x, f) in enumerate(zip(h.tolist(), first.tolist())):
            p = self.known.get(x)
            if p is None:
                p = self.known[x] = len(self.known)
                self.bytes += int(ends[f] - starts[f])
                words = []
                for w in _WORDS.findall(raw[starts[f] : ends[f]].decode()):
                    n = self.word.get(w)
                    if n is None:
                        n = self.word[w] = len(self.word)
                        self.new_words.append(w)
                    words.append(n)
                self.new_pieces.append(words)
            piece[i] = p
        self.parts.append((batch, buf, offs, piece[back], np.searchsorted(starts, offs)))

    def learn(self) -> None:
        """Replay the merges over the pre-tokens that are new, and put the new pieces together."""
        ids, until = replay(self.table, [w.encode() for w in self.new_words])
        self.until.add(until[1:] + self.ids.n)
        self.ids.add(ids)
        counts = np.fromiter(map(len, self.new_pieces), np.int64, len(self.new_pieces))
        flat = np.fromiter((w for ws in self.new_pieces for w in ws), np.int64, int(counts.sum()))
        start, size = self.until.values[flat], self.until.values[flat + 1] - self.until.values[flat]
        ends = np.concatenate([[0], np.cumsum(size)])[np.cumsum(counts)]
        self.piece_until.add(ends + self.piece_ids.n)
        self.piece_ids.add(self.ids.values[ranges(start, size)])
        self.new_words, self.new_pieces = [], []

    def encode(self) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
        """Each waiting batch with its ids, its texts' offsets in them, and whether the ids give back the texts' bytes."""
        self.learn()
        parts, self.parts, self.size = self.parts, [], 0
        for batch, buf, offs, piece, texts in parts:
            start = self.piece_until.values[piece]
            n = self.piece_until.values[piece + 1] - start
            own = self.piece_ids.values[ranges(start, n)]
            at = np.concatenate([[0], np.cumsum(n)])[texts]
            back = self.table.decode(own)
            ends = np.concatenate([[0], np.cumsum(self.table.lengths[own])])[at]
            if len(back) == len(buf) and (ends == offs).all():
                bad = np.concatenate([[0], np.cumsum(back != buf)])
                same = bad[offs[1:]] == bad[offs[:-1]]
            else:
                same = np.array([back[a:b].tobytes() == buf[c:d].tobytes() for a, b, c, d in zip(ends[:-1], ends[1:], offs[:-1], offs[1:])], bool)
            yield batch, own, at, same
        if self.bytes > self.most:
            self.forget()


def encode_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", vocabulary: str = DEFAULT_MERGES, corpus_bytes: int = CORPUS_BYTES, known_bytes: int = KNOWN_BYTES) -> DataFrame:
    """doc_id, ids (array of int), n_tokens, exact (whether the ids decode to the text's bytes) of each row; a map, no shuffle.

    Special tokens' strings are ordinary text. A null text gives nulls; an empty one no ids. Whole texts are encoded, repeated
    rows and null doc_ids like others. The ids don't depend on which texts are encoded together. An empty table gives no rows.
    """

    def emit(corpus: Corpus) -> Iterator[pa.RecordBatch]:
        for batch, ids, at, same in corpus.encode():
            gone = np.asarray(batch.column(1).is_null())
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32), mask=np.append(gone, False)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(np.diff(at), pa.int64(), mask=gone), pa.array(same, pa.bool_(), mask=gone)], ["doc_id", "ids", "n_tokens", "exact"])

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        corpus = Corpus(merges(vocabulary), known_bytes)
        for batch in batches:
            for part in pieces(batch, "t"):
                corpus.add(part, 1)
                if corpus.size >= corpus_bytes:
                    yield from emit(corpus)
        yield from emit(corpus)

    small_batches(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(col(doc_id).alias("d"), col(text).alias("t")).mapInArrow(run, f"doc_id {kind}, ids array<int>, n_tokens bigint, exact boolean")


def decode(ids: Column, vocabulary: str = DEFAULT_MERGES) -> Column:
    """The text of an array of ids; null for null. Bytes that are no UTF-8 (ids cut within a character) become U+FFFD."""

    @F.pandas_udf("string")
    def texts(values: pd.Series) -> pd.Series:
        table = merges(vocabulary)
        return pd.Series([None if v is None else table.decode(np.asarray(v, np.int64)).tobytes().decode("utf-8", "replace") for v in values])

    return texts(ids)
