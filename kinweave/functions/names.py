"""Scalar text transforms: normalisation of texts and of entity names, phonetic keys, ids."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

HONORIFICS = ["hr", "hr.", "herr", "fru", "fru.", "frøken", "dr", "dr."]
_CONTROL = re.compile(r"[^\n\x20-\x7e\xa0-\U0010ffff]")
_BLANKS = re.compile(r"[^\S\n]+")
_BROKEN = re.compile(r"[Â-ô][\u0080-¿ŒœŠšŸŽžƒˆ˜–-›€™]")


def hash_id(*parts: Column | str, sep: str = "|") -> Column:
    """The first 32 hex digits of the SHA-256 of the parts joined by ``sep``; null parts are left out."""
    return F.substring(F.sha2(F.concat_ws(sep, *[F.col(p) if isinstance(p, str) else p for p in parts]), 256), 1, 32)


def repair_mojibake(text: str) -> str:
    """Undo UTF-8 that was read as Windows-1252 or Latin-1, as long as that gives valid text."""
    for _ in range(3):
        if not _BROKEN.search(text):
            return text
        for codec in ("cp1252", "latin-1"):
            try:
                better = text.encode(codec).decode("utf-8")
            except UnicodeError:
                continue
            break
        else:
            return text
        text = better
    return text


def clean_text(text: str | None) -> str:
    """Repaired, composed (NFC), without control characters but line feeds, blanks collapsed, stripped; "" for None."""
    if not text:
        return ""
    text = unicodedata.normalize("NFC", repair_mojibake(text)).replace("\t", " ")
    return _BLANKS.sub(" ", _CONTROL.sub("", text)).strip()


@F.pandas_udf(StringType())
def normalize_text(texts: pd.Series) -> pd.Series:
    return texts.map(clean_text)


def collapse_blanks(text: Column) -> Column:
    """The part of ``normalize_text`` that needs no Python: tabs, control characters, blanks, ends."""
    text = F.regexp_replace(F.translate(text, "\t", " "), r"[^\n\x20-\x7e\x{80}-\x{10ffff}]", "")
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \x0b\f]+", " "), r"^\s+|\s+$", "")


@F.pandas_udf(StringType())
def title_case(texts: pd.Series) -> pd.Series:
    """Upper case after every character that is no letter."""
    return texts.map(lambda t: None if t is None else t.title())


@F.pandas_udf(StringType())
def fold(texts: pd.Series) -> pd.Series:
    """Composed and case-folded; "" for null."""
    return texts.map(lambda t: unicodedata.normalize("NFC", t or "").casefold())


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: F.length(w) > 0)


def normalize_name(text: Column, kind: Column) -> Column:
    """Canonical form of a mention by its entity type (PER, ORG, LOC, VEH, COMM, FIN, others lower-cased)."""
    flat = F.array_join(_words(F.coalesce(text, F.lit(""))), " ")
    words = F.split(flat, " ")
    bare = F.filter(words, lambda w: ~F.lower(w).isin(HONORIFICS))
    person = F.when(F.size(bare) > 0, F.array_join(bare, " ")).otherwise(flat)
    organisation = F.regexp_replace(flat, r"(?iU)\s+(?:asa?|ans|[sd]a)\s*$", "")
    place = F.regexp_replace(flat, r"(?iU)\s+(?:fylke|kommune)\s*$", "")
    digits = F.regexp_replace(flat, r"[^0-9]", "")
    contact = F.when(F.length(digits) >= 0.5 * F.length(flat), digits).otherwise(F.lower(flat))
    titled = title_case(F.when(kind == "PER", person).when(kind == "ORG", organisation).otherwise(place))
    return (
        F.when(flat == "", flat)
        .when(kind.isin("PER", "ORG", "LOC"), titled)
        .when(kind == "VEH", F.upper(flat))
        .when(kind == "COMM", contact)
        .when(kind == "FIN", F.upper(F.regexp_replace(flat, r"(?U)[\s-]", "")))
        .otherwise(F.lower(flat))
    )


def _chain(text: Column, steps: list[tuple[str, str]]) -> Column:
    for old, new in steps:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


_LETTERS = [("æ", "ae"), ("ø", "o"), ("å", "a")]
_DIGRAPHS = [("skj", "sk"), ("kj", "k"), ("hj", "j"), ("gj", "j")]


def phonetic_blocking_form(text: Column) -> Column:
    """Lower-cased, letters first, then digraphs."""
    return _chain(F.lower(text), _LETTERS + _DIGRAPHS)


def phonetic_feature_form(text: Column) -> Column:
    """Digraphs first, then letters, case untouched."""
    return _chain(text, _DIGRAPHS + _LETTERS)


def context_window(text: Column, start: Column, end: Column, reach: int = 50) -> Column:
    """The text from ``reach`` characters before a span to as many after it."""
    lo = F.greatest(start - reach, F.lit(0))
    return F.substring(text, lo + 1, F.greatest(F.least(end + reach, F.length(text)) - lo, F.lit(0)))
