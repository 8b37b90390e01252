"""Mentions: identifier patterns, a pluggable tagger with its span repairs, overlap rules, de-duplication into entities.

Finders are table functions over chunks: one Arrow batch of texts in, one row for each mention out. Where a rule compares spans of
one chunk only by overlap it is a join on chunk_id (``merge_patterns_with_tags``), so it needs no Python at all.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import context_window, hash_id, normalize_name

Span = tuple[int, int, str]
Tagger = Callable[[str], list[Span]]
#: A tagger of many texts at once, for models that work in batches.
BatchTagger = Callable[[list[str]], list[list[Span]]]

STREETS = "alléen allé bakken gaten gate gata kroken løkka plassen plass stien sti svingen torget torg tunet veien vei".split()
PLACES = "åsen vollen viken vika tunet toppen svingen stua sætra setra plassen odden neset moen løkka lia kroken hytta huset holtet heim haugen gården fjellet enga berget bakken".split()
BODIES = "agency authority constabulary department kommissariat lagmannsrett police politidistrikt tingrett".split()
_STREET, _UP, _LOW = "|".join(STREETS), "[A-ZÆØÅ]", "[a-zæøå]"
_ANY = "[a-zæøåA-ZÆØÅ]"
_TAIL = f"(?:~#{{1,4}}[a-zA-Z]?)?(?:,~####~{_UP}{_ANY}+)?"

#: Patterns by entity type, in the order in which they win ties. # is a digit, ~ a white space, < and > bound words.
_WRITTEN = [
    ("COMM", "<###~##~###>"),
    ("COMM", "<#{8}>"),
    ("COMM", "(?<!#)[+]#{7,15}>"),
    ("COMM", "(?<!#)[+]#{1,3}(?:[~-]#{2,5}){2,5}>"),
    ("COMM", r"<(?a:[\w.%+-]+@(?:[^\W_]|[.-])+[.][^\W\d_]{2,})>"),
    ("COMM", r"<(?a:(?=[\d_]*[^\W\d_])(?=[^\W_]*_)\w{3,})>"),
    ("PER", "<#{6}[~-]?#{5}>"),
    ("VEH", "<[A-Z][A-Z]~?#{4,5}>"),
    ("FIN", "<####[.]##[.]#{4,5}>"),
    ("FIN", "<NO##(?:~?####){2}~?###>"),
    ("LOC", f"<{_UP}{_ANY}*(?:{_STREET}){_TAIL}>"),
    ("LOC", f"<{_UP}{_LOW}+(?:~{_UP}{_LOW}+)*~(?:{_STREET}){_TAIL}>"),
]


def _expanded(pattern: str) -> re.Pattern[str]:
    bounds = re.sub(r"(?<![?(])<(?!!)|>$", r"\\b", pattern)
    return re.compile(bounds.replace("#", r"\d").replace("~", r"\s"))


FAMILIES: list[tuple[str, re.Pattern[str]]] = [(kind, _expanded(p)) for kind, p in _WRITTEN]
#: What no pattern matches without: chunks that lack it stay in the JVM.
_HINT = rf"(?U)\d|@|_|\b(?:{_STREET})\b|{_UP}{_ANY}*(?:{_STREET})\b"
_BODY = re.compile(rf"\b(?:{'|'.join(BODIES)})\s*$", re.I)
_STREET_END = re.compile(rf"(?:{_STREET}|avenue|drive|lane|road|square|street)\s*\d*\s*$", re.I)
_HEAD = re.compile(rf"(?:(?:{'|'.join(PLACES)})|(?:{_STREET})(?:\s+\d+{'[A-Z]'}?)?)\s*$", re.I)
_LOCALITY = re.compile(rf"(?:{_UP}{_LOW}+|{_UP}{{2,}})(?:-{_UP}{_ANY}+)?\s*", re.I)
LABELS = {label: label[-3:] for label in ("GPE_LOC", "GPE_ORG", "LOC", "ORG", "PER")}


def without_overlaps(spans: list[Span]) -> list[Span]:
    """Sorted by start, longest first, the order of equals kept; a span stays if it starts at or after the last one's end."""
    out: list[Span] = []
    for span in sorted(spans, key=lambda s: (s[0], -s[1])):
        if not out or span[0] >= out[-1][1]:
            out.append(span)
    return out


def pattern_spans(text: str) -> list[Span]:
    return without_overlaps([(m.start(), m.end(), kind) for kind, p in FAMILIES for m in p.finditer(text)])


def join_fragments(spans: list[Span], most_gap: int = 1) -> list[Span]:
    """Neighbouring spans of one type at most ``most_gap`` apart become one."""
    out: list[Span] = []
    for start, end, kind in spans:
        if out and out[-1][2] == kind and 0 <= start - out[-1][1] <= most_gap:
            out[-1] = (out[-1][0], end, kind)
        else:
            out.append((start, end, kind))
    return out


def join_localities(spans: list[Span], text: str) -> list[Span]:
    """A place or address and the single word after its comma become one place, unless that names a body."""
    out: list[Span] = []
    for start, end, kind in spans:
        if out and kind == out[-1][2] == "LOC" and text[out[-1][1] : start] == ", ":
            head = out[-1][0]
            if _HEAD.search(text[head : out[-1][1]]) and _LOCALITY.fullmatch(text[start:end].strip()) and not _BODY.search(text[head:end]):
                out[-1] = (head, end, kind)
                continue
        out.append((start, end, kind))
    return out


def type_of(text: Column, kind: Column) -> Column:
    """The type less two slips of taggers: a place that ends in a body's name is an ORG, a body that ends in a street's a LOC."""
    body, street = (F.lit("(?iU)" + p.pattern) for p in (_BODY, _STREET_END))
    return F.when((kind == "LOC") & F.regexp_like(text, body), "ORG").when((kind == "ORG") & F.regexp_like(text, street), "LOC").otherwise(kind)


def is_plausible(text: Column, kind: Column) -> Column:
    """At least two characters; a one-word ORG is in capitals, or has three characters and begins with one."""
    t = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    capital = lambda c: (c == F.upper(c)) & (c != F.lower(c))
    return (F.length(t) >= 2) & ((kind != "ORG") | F.contains(t, F.lit(" ")) | capital(t) | (capital(F.substring(t, 1, 1)) & (F.length(t) >= 3)))


_COMPANY = re.compile(r"\b(?:AS|ASA|ANS|DA|SA|Inc|Ltd|GmbH|AG|Corp)\.?$")


def capital_tagger(text: str) -> list[Span]:
    """The tagger without a model: runs of at least two capitalised words; their endings tell bodies and places from people."""
    out: list[Span] = []
    for m in re.finditer(r"\b[^\W\d_a-zæøå][\w'’-]+(?: [^\W\d_a-zæøå][\w'’-]*)+", text):
        words = m.group()
        kind = "ORG" if _COMPANY.search(words) or _BODY.search(words) else "LOC" if _STREET_END.search(words) else "PER"
        out.append((m.start(), m.end(), kind))
    return out


def tagged_spans(text: str, tagger: Tagger = capital_tagger) -> list[Span]:
    """A tagger's spans of the known labels, fragments and localities joined."""
    return join_localities(join_fragments(sorted((s, e, LABELS[k]) for s, e, k in tagger(text) if k in LABELS)), text)


_MENTION = "array<struct<text:string,type:string,char_start:int,char_end:int>>"


def _explode(chunks: DataFrame, spans_of: Callable[[list[str]], list[list[Span]]], source: str, text: str) -> DataFrame:
    @F.pandas_udf(_MENTION)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            filled = texts.fillna("").tolist()
            yield pd.Series([[{"text": t[s:e], "type": k, "char_start": s, "char_end": e} for s, e, k in found] for t, found in zip(filled, spans_of(filled))], dtype=object)

    keys = [c for c in chunks.columns if c != text]
    return chunks.select(*keys, F.explode(find(F.col(text))).alias("m")).select(*keys, "m.*", F.lit(source).alias("source"))


def pattern_mentions(chunks: DataFrame, text: str = "text") -> DataFrame:
    """Each chunk's identifiers, with every other column of the chunk. A null or empty text has none."""
    return _explode(chunks.where(F.col(text).rlike(_HINT)), lambda texts: [pattern_spans(t) for t in texts], "regex", text)


def tagged_mentions(chunks: DataFrame, tagger: Tagger | BatchTagger = capital_tagger, text: str = "text", batched: bool = False) -> DataFrame:
    """Each chunk's tagged mentions, their types corrected and implausible ones left out (both in the JVM)."""
    if batched:

        def spans_of(texts: list[str]) -> list[list[Span]]:
            return [tagged_spans(t, lambda _, s=s: s) for t, s in zip(texts, tagger(texts))]

    else:

        def spans_of(texts: list[str]) -> list[list[Span]]:
            return [tagged_spans(t, tagger) for t in texts]

    found = _explode(chunks, spans_of, "ner", text)
    return found.withColumn("type", type_of(F.col("text"), F.col("type"))).where(is_plausible(F.col("text"), F.col("type")))


def _overlaps() -> Column:
    return F.expr("r.chunk_id = n.chunk_id and r.char_start < n.char_end and n.char_start < r.char_end")


def patterns_off_tags(patterns: DataFrame, tags: DataFrame) -> DataFrame:
    """Pattern mentions that overlap no tagged mention of their chunk."""
    return patterns.alias("r").join(tags.alias("n"), _overlaps(), "left_anti")


def merge_patterns_with_tags(patterns: DataFrame, tags: DataFrame) -> DataFrame:
    """Both together, overlaps decided: a pattern that contains all tags it overlaps, all of its own type, replaces them; a
    pattern that overlaps tags otherwise goes."""
    r, n = patterns.alias("r"), tags.alias("n")
    inside = F.expr("r.char_start <= n.char_start and n.char_end <= r.char_end and r.type = n.type")
    key = ["chunk_id", "char_start", "char_end", "type"]
    hit = r.join(n, _overlaps()).select(*[F.col(f"r.{k}").alias(k) for k in key], *[F.col(f"n.{k}").alias(f"n_{k}") for k in key[1:]], inside.alias("inside"))
    wins = hit.groupBy(*key).agg(F.bool_and("inside").alias("wins"))
    kept = patterns.join(wins.where("not wins"), key, "left_anti")
    gone = hit.join(wins.where("wins"), key).select("chunk_id", *[F.col(f"n_{k}").alias(k) for k in key[1:]])
    return kept.unionByName(tags.join(gone, key, "left_anti"))


def span_islands(spans: DataFrame, keys: list[str], most_gap: int = 1) -> DataFrame:
    """Runs of neighbouring spans (char_start, char_end) of equal keys and type that are 0 to ``most_gap`` apart, in SQL.

    A run takes the first start and the last span's end.
    """
    order = Window.partitionBy(*keys).orderBy("char_start", "char_end", "type")
    gap = F.col("char_start") - F.lag("char_end").over(order)
    new = (~F.coalesce((F.lag("type").over(order) == F.col("type")) & gap.between(0, most_gap), F.lit(False))).cast("int")
    runs = spans.withColumn("new", new).withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.max(F.struct("char_start", "char_end"))["char_end"]
    return runs.groupBy(*keys, "run", "type").agg(F.min("char_start").alias("char_start"), last.alias("char_end"), F.count(F.lit(1)).alias("n_spans")).drop("run")


def greedy_spans(spans: DataFrame, keys: list[str]) -> DataFrame:
    """keys, char_start, char_end of the spans that ``without_overlaps`` keeps, key by key."""
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in spans.select(*keys, "char_start", "char_end").schema.fields)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, end = None, None
        for batch in batches:
            keep = []
            columns = [c.to_pylist() for c in batch.columns]
            for i, (*own, start, stop) in enumerate(zip(*columns)):
                if own != group or start >= end:
                    group, end = own, stop
                    keep.append(i)
            yield batch.take(pa.array(keep, pa.int64()))

    rows = spans.select(*keys, "char_start", "char_end").repartition(*keys).sortWithinPartitions(*keys, "char_start", F.desc("char_end"))
    return rows.mapInArrow(pick, kind)


def normalized_mentions(mentions: DataFrame) -> DataFrame:
    """Mentions with their canonical form; those with an empty one go."""
    return mentions.withColumn("normalized", normalize_name(F.col("text"), F.col("type"))).where("normalized <> ''")


def dedup_mentions(mentions: DataFrame) -> DataFrame:
    """One entity for each (doc_id, type, normalized), with all positions in order; the first gives text and place.

    Mentions need chunk_id, char_start, char_end, page_num, source_unit_kind, text. First is by (chunk_id, char_start).
    """
    place = F.struct("chunk_id", "char_start", "char_end", "page_num", "source_unit_kind")
    first = F.min(F.struct("chunk_id", "char_start", "char_end", "text")).alias("first")
    grouped = mentions.groupBy("doc_id", "type", "normalized").agg(first, F.array_sort(F.collect_list(place)).alias("positions"))
    rows = grouped.select("doc_id", "type", "normalized", "first.*", "positions", F.size("positions").alias("count"))
    return rows.withColumn("entity_id", hash_id("doc_id", "type", "chunk_id", F.col("char_start").cast("string"), F.col("char_end").cast("string"), "normalized"))


def with_contexts(entities: DataFrame, chunks: DataFrame) -> DataFrame:
    """Entities with the text around their first place; "" where the chunk is missing."""
    texts = chunks.select("chunk_id", F.col("text").alias("chunk_text"))
    window = context_window(F.col("chunk_text"), F.col("char_start"), F.col("char_end"))
    return entities.join(texts, "chunk_id", "left").withColumn("context", F.coalesce(window, F.lit(""))).drop("chunk_text")


def extract_entities(chunks: DataFrame, tagger: Tagger | BatchTagger = capital_tagger, batched: bool = False) -> DataFrame:
    """Chunks to entities: both finders, overlaps, canonical forms, de-duplication, contexts."""
    keys = chunks.select("doc_id", "chunk_id", "page_num", "source_unit_kind", "text")
    every = merge_patterns_with_tags(pattern_mentions(keys), tagged_mentions(keys, tagger, batched=batched))
    return with_contexts(dedup_mentions(normalized_mentions(every)), chunks)


def mention_counts(mentions: DataFrame) -> DataFrame:
    return mentions.groupBy("source", "type").agg(F.count(F.lit(1)).alias("n"))
