"""Document files: discovery, DOCX and PDF units, web pages and conversations as units."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ingestion import KINDS, content_id

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
UNITS = "array<struct<page_num:int,text:string>>"
Backend = Callable[[bytes], list[str]]


def discover(spark: SparkSession, root: str) -> DataFrame:
    """path, length, content of all .pdf and .docx files under a folder, whatever their case."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.where(F.lower("path").rlike(r"\.(pdf|docx)$")).select("path", "length", "content")


def _text(node) -> str:
    out = []
    for x in node.iter():
        if x.tag == _W + "t":
            out.append(x.text or "")
        elif x.tag == _W + "tab":
            out.append("\t")
        elif x.tag in (_W + "br", _W + "cr"):
            out.append("\n")
    return "".join(out)


def docx_units(content: bytes) -> list[str]:
    """The paragraphs of a DOCX file in order, then the cells of its tables row by row."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(_W + "body")
    if body is None:
        return []
    cells = [c for t in body.findall(_W + "tbl") for row in t.findall(_W + "tr") for c in row.findall(_W + "tc")]
    return [*(_text(p) for p in body.findall(_W + "p")), *("\n".join(_text(p) for p in c.findall(_W + "p")) for c in cells)]


def pdf_units(content: bytes) -> list[str]:
    """The pages of a PDF file, by PyMuPDF where it is installed."""
    try:
        import fitz
    except ImportError as e:
        raise RuntimeError("no PDF backend is installed; pass one as backends={'pdf_page': ...}") from e
    with fitz.open(stream=content, filetype="pdf") as pdf:
        return [page.get_text() for page in pdf]


def read_units(files: DataFrame, run_id: str, backends: dict[str, Backend] | None = None) -> DataFrame:
    """run_id, doc_id, source_unit_kind, page_num, text of each unit of files; error instead where a file can't be read."""
    read = {"docx_paragraph": docx_units, "pdf_page": pdf_units} | (backends or {})
    kinds = {s: k for s, (_, k) in KINDS.items()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for r in rows.itertuples():
                kind = kinds[r.suffix]
                try:
                    out += [(r.doc_id, kind, i, t, None) for i, t in enumerate(read[kind](bytes(r.content)))]
                except Exception as e:  # a broken file must not end the run; its row says why
                    out.append((r.doc_id, kind, None, None, f"{type(e).__name__}: {e}"[:500]))
            yield pd.DataFrame(out, columns=["doc_id", "source_unit_kind", "page_num", "text", "error"]).astype({"page_num": "Int32"})

    keyed = files.select(content_id(F.col("content")).alias("doc_id"), F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).alias("suffix"), "content").where(F.col("suffix").isin(*kinds))
    return keyed.mapInPandas(run, "doc_id string, source_unit_kind string, page_num int, text string, error string").withColumn("run_id", F.lit(run_id))


def table_units(rows: DataFrame, key: str, text: str, run_id: str, page: str | None = None) -> DataFrame:
    """A table of texts as units: one document for each key, its rows ordered by ``page``."""
    return rows.select(F.lit(run_id).alias("run_id"), F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 32).alias("doc_id"), F.lit("docx_paragraph").alias("source_unit_kind"), (F.col(page).cast("int") if page else F.lit(0)).alias("page_num"), F.col(text).alias("text"))


def html_text(html: Column) -> Column:
    """The text of HTML without its scripts, styles, comments and tags, entities of the five common kinds undone."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(bare, r"\s+", " "))
