"""Vectors of texts without a model: hashed character n-grams, signed, of unit length."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

DIM = 768


def text_vector(text: str | None, dim: int = DIM, orders: tuple[int, ...] = (2, 3, 4)) -> np.ndarray:
    """The vector of a text; that of an empty one points along the first axis."""
    out = np.zeros(dim, np.float64)
    flat = f" {' '.join((text or '').casefold().split())} "
    for n in orders:
        for i in range(len(flat) - n + 1):
            h = zlib.crc32(flat[i : i + n].encode())
            out[h % dim] += 1 if h >> 31 else -1
    norm = np.linalg.norm(out)
    if not norm:
        out[0] = norm = 1.0
    return (out / norm).astype(np.float32)


@F.pandas_udf(ArrayType(FloatType()))
def hashed_vectors(texts: pd.Series) -> pd.Series:
    return texts.map(text_vector)
