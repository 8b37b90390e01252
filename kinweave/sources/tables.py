"""Reads and writes of the resolution's tables: projection and filters that reach the scan, appends without repeats, upserts."""

from __future__ import annotations

import json
import os
import re
import uuid
from base64 import urlsafe_b64decode, urlsafe_b64encode
from collections.abc import Callable
from datetime import date, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.graph import ensure_checkpoints

GOLD = "case_id string, doc_id string, doc_name string, mention_id string, char_start int, char_end int, text string, entity_type string, group_id string, canonical_text string, notes string"
GOLD_REQUIRED = "mention_id group_id doc_id entity_type char_start char_end text".split()
CLUSTERS = "run_id string, cluster_count int, clusters array<struct<cluster_id:string,cluster_size:int,confidence:double,min_edge_score:double,density:double,canonical_name:string,canonical_type:string,suspicious_merge:boolean,routing_actions_by_profile:struct<balanced_hitl:string,quick_low_hitl:string>>>"
CLUSTER_ROW = "cluster_id string, cluster_size int, confidence double, min_edge_score double, density double, canonical_name string, canonical_type string, suspicious_merge boolean, balanced_hitl string, quick_low_hitl string"


def run_folder(run_id: str) -> str:
    return "rid_" + urlsafe_b64encode(run_id.encode()).decode().rstrip("=")


def run_of_folder(name: str) -> str | None:
    if not name.startswith("rid_"):
        return None
    try:
        return urlsafe_b64decode(name[4:] + "=" * (-len(name[4:]) % 4)).decode()
    except ValueError:
        return None


def discover_runs(root: str) -> list[str]:
    """Runs under a folder that have a clusters.json, sorted."""
    found = [run_of_folder(p.parent.name) for p in Path(root).glob("rid_*/clusters.json")]
    return sorted(r for r in found if r)


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None, where: str | None = None) -> DataFrame:
    """A Parquet table; columns that it lacks are left out, filter and projection reach the scan."""
    df = spark.read.parquet(path)
    if where:
        df = df.where(where)
    return df.select([c for c in columns if c in df.columns]) if columns else df


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """Gold mentions from a CSV file with a header; columns may come in any order, doc_name and notes may lack."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    missing = [c for c in GOLD_REQUIRED if c not in df.columns]
    if missing:
        raise ValueError(f"gold mentions lack {', '.join(missing)}")
    kinds = {f.name: f.dataType for f in StructType.fromDDL(GOLD).fields}
    return df.select([(F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in kinds.items()])


def write_csv(rows: DataFrame, path: str) -> None:
    """A folder of CSV files with headers, wherever ``path`` lies; cells that are lists are joined by a bar."""
    flat = rows.select([F.concat_ws("|", c).alias(c) if t.startswith("array") else F.col(c) for c, t in rows.dtypes])
    flat.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_clusters(spark: SparkSession, path: str, one_line: bool = False) -> DataFrame:
    """The clusters of a clusters.json, flat. one_line: each line is a file of its own, as Spark writes them."""
    rows = spark.read.schema(CLUSTERS).option("multiLine", not one_line).option("mode", "FAILFAST").json(path).select(F.explode("clusters").alias("c"))
    return rows.select("c.*").select("*", "routing_actions_by_profile.*").drop("routing_actions_by_profile")


def read_clusters_or_empty(spark: SparkSession, path: str) -> tuple[DataFrame, str | None]:
    """As ``read_clusters``; an empty table and the reason where the file lacks or is broken."""
    try:
        df = read_clusters(spark, path)
        df.count()
        return df, None
    except Exception as e:
        return spark.createDataFrame([], CLUSTER_ROW), f"{path}: {type(e).__name__}"


def read_json_or_none(path: str) -> dict | None:
    try:
        found = json.loads(Path(path).read_text())
    except (OSError, ValueError):
        return None
    return found if isinstance(found, dict) else None


def _plain(value):
    if isinstance(value, (date, datetime)):
        return value.isoformat()
    if hasattr(value, "asDict"):
        return value.asDict(True)
    raise TypeError(f"{type(value).__name__} can't be written as JSON")


def write_json(value, path: str) -> None:
    """Keys sorted, dates in ISO form; the file is replaced whole."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    part = target.with_name(f".{target.name}.{uuid.uuid4().hex}")
    part.write_text(json.dumps(value, indent=2, sort_keys=True, default=_plain, ensure_ascii=False) + "\n")
    os.replace(part, target)


def put_json(spark: SparkSession, value, path: str) -> None:
    """As ``write_json``, wherever the path lies: by the session's file systems."""
    put_text(spark, json.dumps(value, indent=2, sort_keys=True, default=_plain, ensure_ascii=False) + "\n", path)


def put_text(spark: SparkSession, text: str, path: str) -> None:
    """A small text file, written beside its place and then moved there."""
    of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = of(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    part = of(f"{path}.{uuid.uuid4().hex}")
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(of(path), False)
    fs.rename(part, of(path))


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def append_new(rows: DataFrame, path: str, keys: list[str], partition: str = "run_id") -> int:
    """Append the rows whose keys the table lacks; gives their number. The new rows are read against the old table first."""
    spark = rows.sparkSession
    ensure_checkpoints(spark)
    if exists(spark, path):
        rows = rows.join(spark.read.parquet(path).select(*keys).distinct(), keys, "left_anti")
    rows = rows.checkpoint()
    rows.write.mode("append").partitionBy(partition).parquet(path)
    return rows.count()


def replace_table(rows: DataFrame, path: str, check: Callable[[DataFrame], None] | None = None) -> None:
    """Write beside the table, look at what was written, and take the table's place: a failed write, a failed ``check`` or a failed
    move leaves the old one."""
    spark = rows.sparkSession
    staged = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    rows.write.parquet(staged)
    if check:
        check(spark.read.schema(rows.schema).parquet(staged))
    jvm = spark.sparkContext._jvm
    of = jvm.org.apache.hadoop.fs.Path
    fs = of(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    old = f"{staged}.old"
    if fs.exists(of(path)):
        fs.rename(of(path), of(old))
    if not fs.rename(of(staged), of(path)):
        fs.rename(of(old), of(path))
        raise OSError(f"{staged} can't be moved to {path}")
    fs.delete(of(old), True)


def upsert_run(rows: DataFrame, path: str, partition: str = "run_id") -> None:
    """Replace the rows of the runs at hand, keep all others (dynamic partition overwrite)."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def markdown_table(rows: DataFrame, title: str = "", limit: int = 1000) -> str:
    """A small table as Markdown: numbers to four digits, bars escaped, what is beyond ``limit`` rows told."""

    def cell(v) -> str:
        if isinstance(v, float):
            return f"{v:.4f}"
        return "-" if v is None else re.sub(r"\s+", " ", str(v)).replace("|", "\\|")

    got = rows.take(limit + 1)
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + " --- |" * len(rows.columns)]
    lines += ["| " + " | ".join(cell(v) for v in r) + " |" for r in got[:limit]]
    more = ["", f"More than {limit} rows; the rest is left out."] if len(got) > limit else []
    return "\n".join([*([f"## {title}", ""] if title else []), *lines, *more]) + "\n"
