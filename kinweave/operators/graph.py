"""Connected components of an edge table, by alternating large-star and small-star steps.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014). Every step is one shuffle of the edges; lineage is cut in
the shared checkpoint folder after each round, so that a lost executor costs one round at most.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def ensure_checkpoints(spark: SparkSession) -> None:
    """Use spark.checkpoint.dir; make a temporary folder only where none is set and all is on one machine (tests)."""
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(folder or "file://" + tempfile.mkdtemp(prefix="kinweave-"))


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = F.least(F.col("u"), F.min("v").over(Window.partitionBy("u")))
    return both.withColumn("m", least).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    hung = down.withColumn("m", F.min("v").over(Window.partitionBy("u")))
    moved = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))
    return hung.select(F.explode(moved).alias("e")).select("e.u", "e.v").where("u <> v").distinct()


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def roots(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The tree that each of n nodes belongs to, by edges of node numbers."""
    root = np.arange(n)
    while True:
        a, b = root[u], root[v]
        on = a != b
        if not on.any():
            return root
        u, v, a, b = u[on], v[on], a[on], b[on]
        root[np.maximum(a, b)] = np.minimum(a, b)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


#: Edges that are looked at together, and of a task's forest at most.
TOGETHER, MOST = 1_000_000, 2_000_000


def forest(edges: DataFrame) -> DataFrame:
    """Edges (u, v) that connect what ``edges`` do: of each task's edges a forest, so that no more than its nodes are passed on.

    Edges stream by; a forest of MOST edges is passed on at once, and the next one begun.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def planted(rows: list) -> pa.RecordBatch:
            u, v = (pa.chunked_array([b.column(i) for b in rows]).combine_chunks() for i in (0, 1))
            places, names = pd.factorize(pa.concat_arrays([u, v]).to_pandas())
            root = roots(places[: len(u)], places[len(u) :], len(names))
            at = np.flatnonzero(root != np.arange(len(names)))
            return pa.RecordBatch.from_arrays([pa.array(names[at], u.type), pa.array(names[root[at]], u.type)], ["u", "v"])

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= TOGETHER and n >= 2 * held[0].num_rows:
                held = [planted(held)]
                n = held[0].num_rows
                if n >= MOST:
                    yield held[0]
                    held, n = [], 0
        if n:
            yield planted(held)

    kind = edges.schema["u"].dataType.simpleString()
    return edges.mapInArrow(run, f"u {kind}, v {kind}") if kind in ("string", "bigint", "int") else edges


def connected_components(edges: DataFrame, src: str | Column = "src", dst: str | Column = "dst") -> DataFrame:
    """node, component for every node with an edge to another; component is the component's least node.

    Node ids may be of any type with an order. Self-loops and null ends are left out, repeated edges count once. Numbers and strings
    are cut down to forests before anything shuffles.
    """
    ensure_checkpoints(edges.sparkSession)
    a, b = (F.col(x) if isinstance(x, str) else x for x in (src, dst))
    now = edges.select(a.alias("u"), b.alias("v")).where("u is not null and v is not null and u <> v")
    now = forest(now).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint()
    mark = _print(now)
    while True:
        now = _small(_large(now)).checkpoint()
        before, mark = mark, _print(now)
        if before == mark:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots).distinct()
