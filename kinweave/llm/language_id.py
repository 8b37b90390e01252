"""Language ID by rank-order profiles (Cavnar and Trenkle).

A profile is a list of the ``PROFILE`` most frequent letter n-grams in order. A text's profile is compared with each language's
by the out-of-place distance: the sum over the text's n-grams of the difference of ranks, an n-gram that the language's profile
lacks costing ``PROFILE``. The language with the least distance wins, the first by name of equals. Divided by the most that the
sum can be, the distance lies between 0 and 1.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import col, cut, fresh, released, small_batches
from .kernels import Two

PROFILE = 300
ORDERS = (1, 2, 3)
#: Labelled texts of each language that the profiles are made from: those with the smallest hash of doc_id and text.
SAMPLE = 400
#: The sample is looked for among this many times as many rows.
SPARE = 4
#: A text is rejected beyond this distance from every profile. Own-language prose stays under 0.65, of any length.
REJECT = 0.8
#: Letters below which a text is too short to be rejected for its distance.
SHORT = 40

_GAP = re.compile(r"[\W\d_]+")
_STEP = 1 << 20


def grams(text: str) -> Two:
    """The distinct n-grams of a text (code points packed in 21 bits each) and their counts.

    Letters are lower-cased and all else becomes single spaces, one on either side of the text; a lone space is no n-gram.
    """
    parts: list[Two] = []
    plain = " " + _GAP.sub(" ", text.lower()).strip() + " "
    if len(plain) <= 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    for at in range(0, len(plain), _STEP):
        code = np.frombuffer(plain[at : at + _STEP + max(ORDERS) - 1].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        most = min(_STEP, len(plain) - at)
        keys, value = [], np.zeros(len(code), np.int64)
        for n in range(1, max(ORDERS) + 1):
            value = (value[: len(code) - n + 1] << 21) | code[n - 1 :]
            if n in ORDERS:
                keys.append(value[:most])
        found = np.concatenate(keys)
        found.sort()
        edge = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
        parts.append((found[edge], np.diff(np.append(edge, len(found)))))
    if len(parts) > 1:
        values, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        parts = [(values, np.bincount(back, np.concatenate([p[1] for p in parts])).astype(np.int64))]
    values, counts = parts[0]
    keep = values != 32
    return values[keep], counts[keep]


def profile(values: np.ndarray, counts: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams in order; the smaller code of equals comes first."""
    if len(values) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        on = counts >= least
        values, counts = values[on], counts[on]
    return values[np.lexsort((values, -counts))[:size]]


@dataclass
class Model:
    languages: list[str]
    profiles: list[np.ndarray]

    def __post_init__(self):
        self.sorted = [(p[o], o) for p in self.profiles for o in [np.argsort(p)]]

    def distances(self, own: np.ndarray) -> np.ndarray:
        rank = np.arange(len(own))
        out = np.ones(len(self.languages))
        for i, (values, ranks) in enumerate(self.sorted):
            if len(values) and len(own):
                at = np.minimum(np.searchsorted(values, own), len(values) - 1)
                out[i] = np.where(values[at] == own, np.abs(ranks[at] - rank), PROFILE).sum() / (PROFILE * len(own))
        return out

    def classify(self, text: str | None, reject: float = REJECT) -> tuple[str | None, float | None, float | None, bool]:
        """Language, distance, margin over the next language, rejected."""
        if text is None:
            return None, None, None, True
        values, counts = grams(text)
        if not len(values) or not self.languages:
            return None, None, None, True
        d = self.distances(profile(values, counts))
        best = int(np.argmin(d))
        margin = float(np.partition(d, 1)[1] - d[best]) if len(d) > 1 else 1 - float(d[best])
        letters = int(counts[values < 1 << 21].sum())
        return self.languages[best], float(d[best]), margin, bool(d[best] > reject and letters >= SHORT)


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", sample: int = SAMPLE) -> Model:
    """Profiles from at most ``sample`` labelled texts of each language (a documented bound; only the profiles depend on it).

    The rows are those with the smallest hashes, so the choice doesn't depend on the partitions. Rows without text or language
    are left out; with no labelled row the model has no language and rejects all.
    """
    h, rank = fresh(labelled, "h", "rank")
    rows = labelled.where(col(text).isNotNull() & col(lang).isNotNull()).select(col(lang).alias("lang"), col(text).alias("text"), F.xxhash64(col(doc_id), col(text)).alias(h))
    first = lambda of: of.withColumn(rank, F.row_number().over(Window.partitionBy("lang").orderBy(h, "text"))).where(F.col(rank) <= sample).select("lang", "text")
    # Of n rows the smallest hashes lie in the first part of the range, so that few rows go to a language's task, whatever n is.
    totals = {r[0]: r[1] for r in labelled.where(col(lang).isNotNull()).groupBy(col(lang).alias("lang")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not totals:
        return Model([], [])
    ends = {k: min((1 << 63) - 1, -(1 << 63) + (1 << 64) * SPARE * sample // n) for k, n in totals.items()}
    end = F.create_map(*[F.lit(x) for k, e in ends.items() for x in (k, e)])[F.col("lang")]
    chosen = cut(first(rows.where(F.col(h) <= end)))
    found = {r[0]: r[1] for r in chosen.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if any(found.get(k, 0) < min(sample, n) for k, n in totals.items()):  # many null texts or repeated rows: look at all
        chosen = first(rows)

    def count(key, table):
        found = [grams(t) for t in table.column("text").to_pylist()]
        values, back = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
        own = profile(values, np.bincount(back, np.concatenate([f[1] for f in found])).astype(np.int64)) if len(values) else values
        return pa.table({"lang": pa.array([key[0].as_py()]), "grams": pa.array([own.tolist()], pa.list_(pa.int64()))})

    got = sorted(chosen.groupBy("lang").applyInArrow(count, "lang string, grams array<bigint>").collect(), key=lambda r: r.lang)
    return Model([r.lang for r in got], [np.array(r.grams, np.int64) for r in got])


def identify(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id", lang: str = "lang", reject: float = REJECT) -> DataFrame:
    """doc_id, lang (the label), predicted, distance, margin and rejected for each row; a map without shuffle.

    Whole texts are used. A null text, an empty one and one without letters have no language: predicted, distance and margin are
    null and the row is rejected. A text with letters is rejected when its distance to every profile exceeds ``reject`` and it
    has at least ``SHORT`` letters. Each row gives one row; null ids and labels stay null. An empty table gives no rows.
    """

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [model.classify(t.as_py(), reject) for t in batch.column(2)]
            cols = list(zip(*got)) if got else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.bool_())],
                ["doc_id", "lang", "predicted", "distance", "margin", "rejected"],
            )

    small_batches(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(col(doc_id), col(lang), col(text)).mapInArrow(run, f"doc_id {kind}, lang string, predicted string, distance double, margin double, rejected boolean")


def accept(docs: DataFrame, model: Model, text: str = "text", reject: float = REJECT) -> DataFrame:
    """The rows that aren't rejected (see ``identify``), with all their columns; a map without shuffle.

    Null texts, empty ones and those without letters go; repeated rows and null ids are judged like others. An empty table gives
    an empty table.
    """
    small_batches(docs.sparkSession)
    at = docs.columns.index(text)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([not model.classify(t.as_py(), reject)[3] for t in batch.column(at)], pa.bool_()))

    # mapInArrow looks columns up by name, and not all names can be looked up.
    plain = [f"c{i}" for i in range(len(docs.columns))]
    schema = StructType([StructField(c, f.dataType, f.nullable, f.metadata) for c, f in zip(plain, docs.schema)])
    return docs.toDF(*plain).mapInArrow(run, schema).toDF(*docs.columns)
