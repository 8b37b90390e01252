"""From files and units to registered documents and chunks."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.names import hash_id, normalize_text

CHUNK, OVERLAP, SHORT_TEXT = 512, 50, 20
SEPARATORS = ("\n" * 2, "\n", ". ", " ")
_MIME = {"docx_paragraph": "vnd.openxmlformats-officedocument.wordprocessingml.document", "pdf_page": "pdf"}
KINDS = {f".{kind.split('_')[0]}": (f"application/{mime}", kind) for kind, mime in _MIME.items()}
Unit = tuple[int, str]


def content_id(content: Column) -> Column:
    """The first 32 hex digits of the content's SHA-256."""
    return F.substring(F.sha2(content, 256), 1, 32)


def document_rows(files: DataFrame, root: str, run_id: str) -> DataFrame:
    """Rows of docs for binary files (path, length, content) of the known suffixes; page_count is null until units are read."""
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    mime, kind = (F.create_map(*[F.lit(x) for s, v in KINDS.items() for x in (s, v[i])])[suffix] for i in (0, 1))
    relative = F.regexp_replace(F.col("path"), "^(?:file:)?/*" + root.strip("/") + "/", "")
    return files.where(suffix.isin(*KINDS)).select(
        F.lit(run_id).alias("run_id"), content_id(F.col("content")).alias("doc_id"), relative.alias("path"), mime.alias("mime_type"), kind.alias("source_unit_kind"),
        F.lit(None).cast("int").alias("page_count"), F.col("length").alias("file_size"), F.current_timestamp().alias("extracted_at"),
    )


def register_documents(candidates: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Candidates (run_id, doc_id, path, ...) that are new: one for each doc_id, the first by path, that is neither known by its
    doc_id nor by its path. A changed file at a known path is thus skipped."""
    first = Window.partitionBy("run_id", "doc_id").orderBy("path")
    new = candidates.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn")
    if known is None:
        return new
    keys = known.select("run_id", "doc_id", "path")
    return new.join(keys.select("run_id", "doc_id").distinct(), ["run_id", "doc_id"], "left_anti").join(keys.select("run_id", "path").distinct(), ["run_id", "path"], "left_anti").select(*candidates.columns)


def _fit(parts: list[str], size: int, overlap: int) -> Iterator[str]:
    """Neighbouring parts joined up to ``size``; each text begins with at most ``overlap`` characters of the last one's parts."""
    held: list[str] = []
    total = 0
    for part in parts:
        if held and total + len(part) > size:
            yield "".join(held)
            while held and (total > overlap or total + len(part) > size):
                total -= len(held.pop(0))
        held.append(part)
        total += len(part)
    if held:
        yield "".join(held)


def split_text(text: str, size: int = CHUNK, overlap: int = OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Texts of at most ``size`` characters, cut at the first separator that occurs, parts that are still too long at the next.

    A separator stays at the head of the part after it. A part without any separator stays whole. Texts are stripped.
    """
    at = next((i for i, s in enumerate(separators) if s in text), len(separators))
    if at == len(separators):
        return [text.strip()] if text.strip() else []
    sep, rest = separators[at], separators[at + 1 :]
    head, *tail = text.split(sep)
    parts = [p for p in [head, *(sep + t for t in tail)] if p]
    out: list[str] = []
    short: list[str] = []
    for part in [*parts, None]:
        if part is not None and len(part) < size:
            short.append(part)
            continue
        out += [c for c in (x.strip() for x in _fit(short, size, overlap)) if c]
        short = []
        if part is not None:
            out += split_text(part, size, overlap, rest) if rest else [part.strip()]
    return out


def chunk_units(units: list[Unit], size: int = CHUNK, overlap: int = OVERLAP) -> list[tuple[int, str, int, int]]:
    """(chunk_index, text, page_num, start) of a document's units (page_num, text), joined by blank lines.

    A chunk's start is looked for from just after the last one's, less the overlap; blank chunks keep their index and go.
    """
    text = "\n\n".join(t for _, t in units)
    starts, at = [], 0
    for _, t in units:
        starts.append(at)
        at += len(t) + 2
    out, last, length = [], 0, 0
    for i, chunk in enumerate(split_text(text, size, overlap)):
        found = text.find(chunk, last + max(1, length - overlap) if i else 0)
        if found < 0:
            found = max(text.find(chunk), 0)
        last, length = found, len(chunk)
        if chunk.strip():
            out.append((i, chunk, units[max(bisect_right(starts, found) - 1, 0)][0], found))
    return out


def chunk_documents(units: DataFrame, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """run_id, chunk_id, doc_id, chunk_index, text, source_unit_kind, page_num, global_start from units (run_id, doc_id,
    source_unit_kind, page_num, text). Texts are normalised first; one group of rows for each document."""

    made = StructType.fromDDL("run_id string, doc_id string, chunk_index int, text string, source_unit_kind string, page_num int, global_start int")

    def chunk(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("page_num", kind="stable")
        kind = rows.source_unit_kind.iloc[0]
        found = chunk_units(list(zip(rows.page_num.tolist(), rows.text.tolist())), size, overlap)
        return pd.DataFrame([(key[0], key[1], i, t, kind, p, s) for i, t, p, s in found], columns=made.names)

    clean = units.withColumn("text", normalize_text(F.coalesce("text", F.lit(""))))
    got = clean.groupBy("run_id", "doc_id").applyInPandas(chunk, made)
    return got.select("run_id", hash_id("doc_id", F.col("chunk_index").cast("string"), sep=":").alias("chunk_id"), *made.names[1:])


def page_counts(docs: DataFrame, units: DataFrame) -> DataFrame:
    """docs with page_count filled where units were read."""
    n = units.groupBy("run_id", "doc_id").agg(F.count(F.lit(1)).cast("int").alias("_n"))
    return docs.join(n, ["run_id", "doc_id"], "left").withColumn("page_count", F.coalesce("_n", "page_count")).drop("_n").select(*docs.columns)


def unit_of_position(units: DataFrame, positions: DataFrame) -> DataFrame:
    """doc_id, pos, page_num: the last unit (doc_id, page_num, start) that starts at or before each position (doc_id, pos)."""
    hit = positions.join(units, "doc_id").where("start <= pos")
    return hit.groupBy("doc_id", "pos").agg(F.max_by("page_num", F.struct("start", "page_num")).alias("page_num"))


def chunk_statistics(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """docs_processed, chunk_count and least, most and median chunks of a document (0 for none)."""
    n = docs.select("doc_id").distinct().join(chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")), "doc_id", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return n.agg(F.count(F.lit(1)).alias("docs_processed"), zero(F.sum("n")).alias("chunk_count"), zero(F.min("n")).alias("chunks_min"), zero(F.max("n")).alias("chunks_max"), F.round(F.coalesce(F.percentile("n", F.lit(0.5)), F.lit(0.0)), 1).alias("chunks_median"))


def short_documents(units: DataFrame, least: int = SHORT_TEXT) -> DataFrame:
    """Documents whose units have fewer than ``least`` characters together (likely scans)."""
    return units.groupBy("run_id", "doc_id").agg(F.sum(F.length(F.trim(F.coalesce("text", F.lit(""))))).alias("n_chars")).where(F.col("n_chars") < least)


def warnings(new: DataFrame, units: DataFrame, found: DataFrame, known: DataFrame | None = None) -> dict[str, int]:
    """How many documents gave too little text (or none) and how many known paths hold another content now; only kinds that occur."""
    texts = units.groupBy("run_id", "doc_id").agg(F.sum(F.length(F.trim(F.coalesce("text", F.lit(""))))).alias("n"))
    out = {"extraction_failed_or_short": new.join(texts, ["run_id", "doc_id"], "left").where(F.coalesce("n", F.lit(0)) < SHORT_TEXT).count()}
    if known is not None:
        old = known.select("run_id", "path", F.col("doc_id").alias("known_id"))
        out["content_changed_since_registration"] = found.join(old, ["run_id", "path"]).where("doc_id <> known_id").count()
        out["file_not_found"] = old.join(found, ["run_id", "path"], "left_anti").count()
    return {k: n for k, n in out.items() if n}


def rebuild_text(chunks: DataFrame) -> DataFrame:
    """doc_id, text: each document's text from its chunks, placed by global_start or else by their longest common border."""

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("chunk_index")
        placed = "global_start" in rows.columns and rows.global_start.notna().all()
        text = ""
        for r in rows.itertuples():
            if placed:
                start = int(r.global_start)
                text = text[:start].ljust(start) + r.text
            else:
                k = next((k for k in range(min(len(text), len(r.text)), 0, -1) if text.endswith(r.text[:k])), 0)
                text += r.text[k:]
        return pd.DataFrame({"doc_id": [key[0]], "text": [text]})

    return chunks.groupBy("doc_id").applyInPandas(build, "doc_id string, text string")
