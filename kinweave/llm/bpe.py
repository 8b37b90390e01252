"""Byte-pair encoding of whole batches, with a cache of pieces.

A text is parted before each space that follows a character other than white space; no pre-token spans such a place, so the
pieces encode alone to the same ids as within the text. Each distinct piece is encoded once while it stays in the cache.
"""

from __future__ import annotations

import base64
import re

import numpy as np

from .kernels import BYTE_HASH, SPACE, Two, ranges, span_hash

#: The vocabulary file; any .tiktoken file of byte-level ranks will do.
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_WIDE_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
_SLOTS = 1 << 20
_POOL = 6_000_000
_loaded: dict[str, "Encoder"] = {}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file) if a}


class Encoder:
    def __init__(self, path: str):
        import tiktoken

        ranks = read_ranks(path)
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.byte_length = np.zeros(max(ranks.values()) + 1, np.int32)
        for token, rank in ranks.items():
            self.byte_length[rank] = len(token)
        self.tag = np.zeros(_SLOTS, np.uint64)
        self.clear()

    def clear(self) -> None:
        self.tag[:] = 0
        self.start = np.zeros(_SLOTS, np.int64)
        self.length = np.zeros(_SLOTS, np.int32)
        self.pool = np.zeros(1 << 16, np.int32)
        self.filled = 0

    def add(self, ids: np.ndarray) -> None:
        while self.filled + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.filled : self.filled + len(ids)] = ids
        self.filled += len(ids)

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> Two:
        """The ids of all texts in one array, and the n + 1 offsets of the texts in it."""
        n = len(buf)
        if not n:
            return np.zeros(0, np.int32), np.zeros(len(offs), np.int64)
        raw = buf.tobytes()
        space = SPACE[buf]
        if (buf >= 0xC2).any():
            for m in _WIDE_SPACE.finditer(raw):
                space[m.end() - 1] = True
        cut = np.zeros(n, bool)
        cut[1:] = (buf[1:] == 32) & ~space[:-1]
        cut[offs[:-1][offs[:-1] < n]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], n)
        h = span_hash(BYTE_HASH[buf], starts, ends)
        h[h == 0] = 1
        if self.filled > _POOL:
            self.clear()
        slot = (h & np.uint64(_SLOTS - 1)).astype(np.int64)
        at, size = self.start[slot], self.length[slot]
        missing = np.flatnonzero(self.tag[slot] != h)
        if len(missing):
            _, first, back = np.unique(h[missing], return_index=True, return_inverse=True)
            encode = self.encoding.encode_ordinary
            s, e = starts[missing[first]].tolist(), ends[missing[first]].tolist()
            found = [encode(raw[a:b].decode()) for a, b in zip(s, e)]
            counts = np.fromiter(map(len, found), np.int64, len(found))
            begin = self.filled + np.cumsum(counts) - counts
            self.add(np.fromiter((x for ids in found for x in ids), np.int32, int(counts.sum())))
            at[missing], size[missing] = begin[back], counts[back]
            own = slot[missing[first]]
            self.tag[own], self.start[own], self.length[own] = h[missing[first]], begin, counts
        ids = self.pool[ranges(at, size)]
        until = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        return ids, until[np.searchsorted(starts, offs)]


def encoder(path: str = DEFAULT_VOCABULARY) -> Encoder:
    """One encoder for each worker process and vocabulary."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]
