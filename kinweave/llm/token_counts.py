"""Token counts of sections: offset-mapped attribution.

A document is encoded once, whole; the ids' byte lengths give each token's span, and the spans are interval-joined to the
sections by binary search on the sorted boundaries. A token that crosses a boundary is allocated by ``rule``:

* ``majority``: to the section that holds most of its bytes, the earliest of equals;
* ``start``: to the section that holds its first byte;
* ``end``: to the section that holds its last byte.

So the counts of a document's sections add up to the document's own count. Sections are lines by default: each runs to and
includes its line feed, and the text after the last line feed is one more unless it is empty. ``field_tokens`` takes a table of
fields or sections instead; what lies between them is a part like them, to which a token may be allocated and which isn't told.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import DEFAULT_VOCABULARY, encoder
from .common import bytes_of, col, pieces, released, small_batches

RULES = ("majority", "start", "end")


def line_sections(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sorted starts of the sections of all texts."""
    begin = np.zeros(len(buf) + 1, bool)
    begin[1:] = buf == 10
    begin[offs[:-1]] = True
    begin[-1] = False
    return np.flatnonzero(begin)


def allocate(starts: np.ndarray, token_ends: np.ndarray, lengths: np.ndarray, rule: str) -> np.ndarray:
    """The section of each token; starts are the sections' first bytes, token spans lie in the same coordinates."""
    begin = token_ends - lengths
    a = np.searchsorted(starts, begin, "right") - 1
    if rule == "start":
        return a
    b = np.searchsorted(starts, token_ends - 1, "right") - 1
    if rule == "end":
        return b
    out = a.copy()
    for i in np.flatnonzero(a != b):
        edges = [begin[i], *starts[a[i] + 1 : b[i] + 1], token_ends[i]]
        out[i] = a[i] + int(np.argmax(np.diff(edges)))
    return out


def field_tokens(docs: DataFrame, sections: DataFrame, text: str = "text", doc_id: str = "doc_id", rule: str = "majority", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """doc_id, section, char_start, char_end, n_tokens, n_crossing for each row of ``sections`` and each document row of its doc_id.

    sections: doc_id, section (of any type), char_start, char_end, in characters of the text; those of a document may touch and
    leave gaps, but not overlap (that raises when the plan runs). Ends beyond the text are cut to it; a section without characters
    has no tokens. Documents without sections, and sections of no document, give no rows; null ids meet each other. A null text is
    an empty one. Each document is encoded once, whole, however many sections it has; its sections are brought to it by a join.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    kind, name = docs.schema[doc_id].dataType.simpleString(), sections.schema["section"].dataType.simpleString()
    place = F.struct(F.col("char_start").cast("bigint").alias("s"), F.col("char_end").cast("bigint").alias("e"), F.col("section").alias("n"))
    lists = sections.groupBy(F.col("doc_id").alias("sd")).agg(F.sort_array(F.collect_list(place)).alias("x"))
    rows = docs.select(col(doc_id).alias("d"), F.coalesce(col(text), F.lit("")).alias("t"))
    rows = rows.join(lists, F.col("d").eqNullSafe(F.col("sd"))).select("d", "t", "x")

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            for part in pieces(batch, "t"):
                buf, offs = bytes_of(part.column(1))
                ids, _ = enc.encode(buf, offs)
                lengths = enc.byte_length[ids].astype(np.int64)
                ends = np.cumsum(lengths)
                begins = np.append(np.flatnonzero((buf & 0xC0) != 0x80), len(buf))  # of the characters
                base = np.searchsorted(begins, offs)
                flat = part.column(2).flatten()
                own = np.repeat(np.arange(part.num_rows), np.diff(part.column(2).offsets.to_numpy()))
                s, e = (np.clip(flat.field(k).to_numpy(), 0, (base[1:] - base[:-1])[own]) for k in (0, 1))
                e = np.maximum(s, e)
                if ((own[1:] == own[:-1]) & (s[1:] < e[:-1])).any():
                    raise ValueError("sections of a document overlap")
                on = np.flatnonzero(e > s)
                lo, hi = begins[base[own] + s], begins[base[own] + e]
                starts = np.unique(np.concatenate([offs[:-1], lo[on], hi[on]]))
                starts = starts[starts < len(buf)]
                counts, crossed = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
                if len(ids):
                    at = allocate(starts, ends, lengths, rule)
                    crossing = np.searchsorted(starts, ends - lengths, "right") != np.searchsorted(starts, ends - 1, "right")
                    segment = np.searchsorted(starts, lo[on])
                    counts[on] = np.bincount(at, minlength=len(starts))[segment]
                    crossed[on] = np.bincount(at[crossing], minlength=len(starts))[segment]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(own)), flat.field(2), pa.array(s), pa.array(e), pa.array(counts), pa.array(crossed)], ["doc_id", "section", "char_start", "char_end", "n_tokens", "n_crossing"])

    small_batches(docs.sparkSession)
    return rows.mapInArrow(run, f"doc_id {kind}, section {name}, char_start bigint, char_end bigint, n_tokens bigint, n_crossing bigint")


def section_tokens(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", rule: str = "majority", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """doc_id, section, char_start, char_end, n_tokens, n_crossing for each section of each row; a map without shuffle.

    Sections count from 0; n_crossing are those of its tokens that other sections share bytes of. A null or empty text has no
    sections, an empty table gives no rows, and very long texts are encoded whole. Rows with a null doc_id are counted like others,
    and a repeated row gives its sections again.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            for part in pieces(batch, "t"):
                buf, offs = bytes_of(part.column(1))
                ids, _ = enc.encode(buf, offs)
                if not len(ids):
                    continue
                lengths = enc.byte_length[ids].astype(np.int64)
                ends = np.cumsum(lengths)
                starts = line_sections(buf, offs)
                own = allocate(starts, ends, lengths, rule)
                counts = np.bincount(own, minlength=len(starts))
                crossing = np.searchsorted(starts, ends - lengths, "right") != np.searchsorted(starts, ends - 1, "right")
                crossed = np.bincount(own[crossing], minlength=len(starts))
                chars = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
                row = np.searchsorted(offs, starts, "right") - 1
                first = np.searchsorted(starts, offs[:-1])
                stop = np.append(starts[1:], len(buf))
                base = chars[offs[row]]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(row)),
                        pa.array((np.arange(len(starts)) - first[row]).astype(np.int32)),
                        pa.array(chars[starts] - base, pa.int64()),
                        pa.array(chars[stop] - base, pa.int64()),
                        pa.array(counts, pa.int64()),
                        pa.array(crossed, pa.int64()),
                    ],
                    ["doc_id", "section", "char_start", "char_end", "n_tokens", "n_crossing"],
                )

    small_batches(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(col(doc_id).alias("d"), col(text).alias("t")).mapInArrow(
        run, f"doc_id {kind}, section int, char_start bigint, char_end bigint, n_tokens bigint, n_crossing bigint"
    )
