"""Array kernels over UTF-8 bytes: word and k-gram hashes, sliding minima, ragged ranges."""

from __future__ import annotations

import numpy as np

U = np.uint64
Two = tuple[np.ndarray, np.ndarray]
Three = tuple[np.ndarray, np.ndarray, np.ndarray]
Four = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_random = np.random.default_rng(20240229)
BYTE_HASH = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)

#: Bytes that part words: ASCII white space.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
#: Bytes that part normalised words: everything in ASCII but letters and digits.
PUNCT = np.ones(256, bool)
PUNCT[128:] = False
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    PUNCT[_a:_b] = False

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> Two:
    """The first n powers of the base and of its inverse modulo 2**64."""
    if "b" not in _powers or len(_powers["b"]) < n:
        m = max(n, 1 << 12)
        for k, b in (("b", _BASE), ("i", _INVERSE)):
            p = np.full(m, U(b))
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers["b"][:n], _powers["i"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit hashes."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def span_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of values[s:e] for each span, the same wherever the span lies."""
    n = len(values)
    power, inverse = powers(n + 1)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(values * power[:n], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * U(0xD6E8FEB86659FD93))


def spans(buf: np.ndarray, offs: np.ndarray, gap: np.ndarray = SPACE) -> Three:
    """Starts and ends of the words of all texts (runs of bytes outside gap), and the n + 1 word offsets of the texts."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    word = np.empty(len(buf) + 1, bool)
    word[:-1] = ~gap[buf]
    word[-1] = False
    begin = word[:-1].copy()
    begin[1:] &= ~word[:-2]
    inner = offs[1:-1]
    inner = inner[inner < len(buf)]
    begin[inner] = word[inner]
    starts = np.flatnonzero(begin)
    end = word[:-1] & ~word[1:]
    before = inner[inner > 0] - 1
    end[before] |= word[before]
    ends = np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hash(BYTE_HASH[buf], starts, ends) if len(starts) else np.zeros(0, np.uint64)


def sliding(values: np.ndarray, width: int, ufunc=np.minimum) -> np.ndarray:
    """ufunc over values[i : i + width]; has len(values) - width + 1 elements."""
    if len(values) < width:
        return values[:0]
    done, out = 1, values
    while done * 2 <= width:
        out = ufunc(out[:-done], out[done:])
        done *= 2
    if done < width:
        out = ufunc(out[: len(values) - width + 1], out[width - done : len(values) - done + 1])
    return out


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The concatenation of arange(s, s + c)."""
    counts = counts.astype(np.int64)
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(counts) - counts
    return np.arange(total) + np.repeat(starts - first, counts)
