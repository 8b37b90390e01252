"""Pieces that the training-data operators share: names, row keys, checkpoints, broadcastable key filters.

Row identity. Every operator names a document by ``doc_id`` and the 64-bit hash of its text. Rows that agree in both are the
same document; rows that share only the ``doc_id`` are different documents, ordered by that hash. A null ``doc_id`` sorts last.
"""

from __future__ import annotations

import atexit
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

Kernel = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]

#: Bytes of a filter at most: what is sent to every executor. A filter of more keys is fuller and lets more rows shuffle.
FILTER_LIMIT = 64 << 20
#: Bits of a filter for each key, probes, and keys among which a part looks for repeated ones.
FILTER_BITS, PROBES, PART_KEYS = 12, 4, 2 << 20
#: Bytes of text that the kernels work on at a time, and that a worker is sent at a time.
CHUNK_BYTES, BATCH_BYTES = 512 << 10, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Send at most ``BATCH_BYTES`` to a worker at a time, unless the session says otherwise: a batch of 10,000 long texts is held
    by the executor and by its worker, several times over."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if name not in spark.conf.getAll:
        spark.conf.set(name, str(BATCH_BYTES))


def release() -> None:
    """Give freed memory back to the system at a task's end; the worker waits for other tasks and would hold it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:  # only where the C library has it
        trim(0)


def released(run: Kernel) -> Kernel:
    """The kernel of a mapInArrow, which gives freed memory back when its task ends."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return wrapped


def ranks(values: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Dense ranks of values of any type with an order; nulls are equal and last."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if pa.types.is_nested(values.type) or pa.types.is_boolean(values.type) or pa.types.is_null(values.type):
        plain = [_sortable(v) for v in values.to_pylist()]
        place = {v: i for i, v in enumerate(sorted({v for v in plain if v is not None}))}
        return np.array([len(place) if v is None else place[v] for v in plain], np.int64)
    return pc.rank(values, sort_keys="ascending", null_placement="at_end", tiebreaker="dense").to_numpy().astype(np.int64)


def _sortable(v):
    """Structs and lists as tuples that Python can sort, null parts last."""
    if isinstance(v, dict):
        v = list(v.values())
    return tuple((x is None, None if x is None else _sortable(x)) if x is not None else (True,) for x in v) if isinstance(v, list) else v


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` doesn't have (Spark compares names without case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        candidate = f"__{name}"
        while candidate.lower() in taken:
            candidate += "_"
        taken.add(candidate.lower())
        out.append(candidate)
    return out


def col(name: str) -> Column:
    """A column whose name may hold dots or backticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_hash(name: str = "text") -> Column:
    """64-bit hash of a text; a null text has the hash of an empty row and never compares equal to a text's."""
    return F.xxhash64(F.coalesce(col(name), F.lit("")), col(name).isNull())


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; where none is set and all is on one machine (tests), a
    temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and (dir_ := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        found = dir_.get()
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="kinweave-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage at ``df`` in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, which goes when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(delete, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the table of ``written``, which nothing reads any more."""
    for folder in {path.rpartition("/")[0] for path in df.inputFiles()}:
        delete(df.sparkSession, folder)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder, if the session still stands."""
    context = spark.sparkContext
    if context._jsc is not None and not context._jsc.sc().isStopped():
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def _probes(h: np.ndarray, bits: int | np.ndarray, probes: int = PROBES) -> Iterator[np.ndarray]:
    a = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    b = ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) | np.uint64(1)
    for i in range(probes):
        x = a + np.uint64(i) * b
        yield ((x >> np.uint64(32)) % np.asarray(bits, np.uint64)).astype(np.int64)


class KeyFilter:
    """A Bloom filter over 64-bit keys, built by the executors in parts and broadcast; it never exceeds ``limit`` bytes or so.

    It has ``FILTER_BITS`` bits for each key as long as they fit. Of more keys it gets fuller, so that more rows count as held
    and shuffle: the plan and the result are the same for any number of keys. It has false positives and no false negatives.

    With ``repeated`` it holds only keys that occur at least twice, and its size follows their number. All keys are dealt to parts
    of about ``PART_KEYS`` at most; in a first pass each part keeps a plane of bits and sets those keys aside that find theirs set; in
    the second it makes the filter of them.
    """

    def __init__(self, keys: DataFrame, repeated: bool = False, limit: int = FILTER_LIMIT, count: int | None = None):
        spark = keys.sparkSession
        small_batches(spark)
        n = keys.count() if count is None else count
        parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions", "8")), n // 4096 + 1), -(-n // PART_KEYS))
        first = max(1024, -(-n * FILTER_BITS // parts) // 64 * 64 + 64)  # bits of a part's first plane
        most = max(64, limit * 8 // parts // 64 * 64)

        @released
        def build(batches):
            planes: dict[int, np.ndarray] = {}
            held: dict[int, list[np.ndarray]] = {}
            for batch in batches:
                part = batch.column(1).to_numpy(zero_copy_only=False)
                h = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
                for s in np.unique(part).tolist():
                    values, counts = np.unique(h[part == s], return_counts=True)
                    if repeated:
                        plane = planes.setdefault(s, np.zeros(first, np.bool_))
                        where = list(_probes(values, first))
                        values, set_ = values[(counts > 1) | np.logical_and.reduce([plane[p] for p in where])], where
                        for p in set_:
                            plane[p] = True
                    own = held.setdefault(s, [])
                    own.append(values)
                    if len(own) > 64:
                        held[s] = [np.unique(np.concatenate(own))]
            out = {"s": [], "bits": [], "probes": [], "plane": []}
            for s, own in held.items():
                values = np.unique(np.concatenate(own))
                if not len(values):
                    continue
                bits = min(most, -(-len(values) * FILTER_BITS // 64) * 64)
                probes = max(1, min(PROBES, round(0.7 * bits / len(values))))
                plane = np.zeros(bits, np.bool_)
                for p in _probes(values, bits, probes):
                    plane[p] = True
                for k, v in zip(out, (s, bits, probes, np.packbits(plane).tobytes())):
                    out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, pa.schema([("s", pa.int32()), ("bits", pa.int64()), ("probes", pa.int32()), ("plane", pa.binary())]))

        dealt = keys.select(F.col(keys.columns[0]).alias("k")).where("k is not null").withColumn("s", F.expr(f"cast(pmod(shiftrightunsigned(k, 40), {parts}) as int)"))
        rows = sorted(dealt.repartition(parts, "s").mapInArrow(build, "s int, bits bigint, probes int, plane binary").collect(), key=lambda r: r.s)
        self.parts, bits, probes = parts, np.zeros(parts, np.int64), np.zeros(parts, np.int64)
        for r in rows:
            bits[r.s], probes[r.s] = r.bits, r.probes
        self.broadcast = spark.sparkContext.broadcast((np.frombuffer(b"".join(r.plane for r in rows), np.uint8), np.cumsum(bits) - bits, bits, probes))

    def contains(self, keys: np.ndarray) -> np.ndarray:
        """Whether each 64-bit key may be in the filter; for use on the executors."""
        plane, start, bits, probes = self.broadcast.value
        h = keys.astype(np.int64, copy=False).view(np.uint64)
        part = ((h >> np.uint64(40)) % np.uint64(self.parts)).astype(np.int64)
        found = bits[part] > 0
        if not found.any():
            return found
        size, start, probes = np.maximum(bits[part], 1).astype(np.uint64), start[part], probes[part]
        most = len(plane) * 8 - 1
        for i, p in enumerate(_probes(h, size)):
            at = np.minimum(start + p, most)
            found &= ((plane[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1) | (i >= probes)
        return found

    def holds(self, key: Column) -> Column:
        """Whether a key may be in the filter (a null key is not)."""

        @pandas_udf("boolean")
        def may(k: pd.Series) -> pd.Series:
            return pd.Series(self.contains(k.to_numpy(dtype=np.int64)))

        return F.coalesce(may(F.coalesce(key, F.lit(0))) & key.isNotNull(), F.lit(False))


def large(array: pa.Array | pa.ChunkedArray) -> pa.LargeStringArray:
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    return array.cast(pa.large_string())


def bytes_of(array: pa.Array) -> Two:
    """The UTF-8 bytes of a string array and the n + 1 offsets of its texts; a null is an empty text."""
    array = large(array)
    if array.null_count:
        array = array.fill_null("")
    _, offsets, data = array.buffers()
    offs = np.frombuffer(offsets, np.int64, len(array) + 1, array.offset * 8)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(array) + 1, np.int64)
    buf = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]]
    return buf, offs - offs[0]


def pieces(batch: pa.RecordBatch, name: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes of text each; a longer text comes alone."""
    if batch.num_rows == 0:
        return
    _, offs = bytes_of(batch.column(batch.schema.get_field_index(name)))
    at, n = 0, batch.num_rows
    while at < n:
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def split(df: DataFrame, h: str, keys: DataFrame, limit: int = FILTER_LIMIT) -> tuple[DataFrame, DataFrame]:
    """Rows of ``df`` whose key ``h`` may be among ``keys`` (one column of hashes), and those for which it surely isn't."""
    found = KeyFilter(keys, limit=limit)
    (flag,) = fresh(df, "flag")
    marked = df.withColumn(flag, found.holds(F.col(h)))
    return marked.where(F.col(flag)).drop(flag), marked.where(~F.col(flag)).drop(flag)


def join_keys(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]], how: str = "inner") -> DataFrame:
    """Join on pairs of column names of either side; nulls are equal. Right's names must be fresh in left."""
    on = None
    for a, b in pairs:
        one = left[a].eqNullSafe(right[b])
        on = one if on is None else on & one
    return left.join(right, on, how)


def without(docs: DataFrame, gone: DataFrame, text: str = "text", doc_id: str = "doc_id", limit: int = FILTER_LIMIT) -> DataFrame:
    """docs less the documents of ``gone`` (doc_id, h of text_hash). Only rows that the key filter holds shuffle."""
    h, gd, gh = fresh(docs, "h", "gone_id", "gone_h")
    gone = gone.select(F.col("doc_id").alias(gd), F.col("h").alias(gh)).distinct()
    maybe, sure = split(docs.withColumn(h, text_hash(text)), h, gone.select(gh), limit)
    left = join_keys(maybe, gone, [(h, gh), (doc_id, gd)], "left_anti").drop(h)
    return sure.drop(h).unionByName(left)
