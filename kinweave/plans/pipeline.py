"""The six stages from documents to resolved entities, and their driver.

A stage reads and writes tables under one folder, partitioned by run where rows are appended, so a run may go on where it broke off.
``python -m kinweave.plans.pipeline --case-root DIR --data-dir DIR [--run-id ID] [--enable-shap]``
"""

from __future__ import annotations

import argparse
import sys
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.pairs import add_features
from ..operators import blocking, contracts, extraction, ingestion, resolution, scoring
from ..operators.graph import ensure_checkpoints
from ..sources import files, tables
from . import reports
from .vectors import hashed_vectors


@dataclass
class Run:
    spark: SparkSession
    folder: str
    run_id: str
    root: str | None = None
    units: DataFrame | None = None
    backends: dict = field(default_factory=dict)
    tagger: extraction.Tagger | extraction.BatchTagger = extraction.capital_tagger
    batched_tagger: bool = False
    embedder: Callable[[Column], Column] = hashed_vectors
    model: PipelineModel | None = None
    shap: bool = False
    neighbours: int = 100
    exact_neighbours: bool = False
    keep: float = resolution.KEEP
    neutral: float = resolution.NEUTRAL
    warnings: dict[str, int] = field(default_factory=dict)

    def path(self, table: str) -> str:
        return f"{self.folder.rstrip('/')}/{tables.run_folder(self.run_id)}/{table}"

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(self.path(table))

    def write(self, table: str, rows: DataFrame, check: Callable[[DataFrame], DataFrame] | None = None) -> int:
        """Write a table whole; one that breaks its contract doesn't take the place of the old one."""
        if "run_id" not in rows.columns:
            rows = rows.withColumn("run_id", F.lit(self.run_id))
        tables.replace_table(rows, self.path(table), (lambda staged: contracts.require(check(staged), table)) if check else None)
        return self.read(table).count()


def ingest(run: Run) -> dict[str, int]:
    """docs and chunks; documents that are registered already stay as they are."""
    if run.units is not None:
        units = run.units.withColumn("run_id", F.lit(run.run_id))
        whole = units.groupBy("doc_id", "source_unit_kind").agg(F.sum(F.length(F.coalesce("text", F.lit("")))).cast("bigint").alias("file_size"))
        found = whole.select(F.lit(run.run_id).alias("run_id"), "doc_id", F.col("doc_id").alias("path"), F.lit("text/plain").alias("mime_type"), "source_unit_kind", F.lit(None).cast("int").alias("page_count"), F.greatest("file_size", F.lit(1).cast("bigint")).alias("file_size"), F.current_timestamp().alias("extracted_at"))
    else:
        binary = files.discover(run.spark, run.root)
        if binary.isEmpty():
            raise FileNotFoundError(f"no .pdf or .docx file under {run.root}")
        units = files.read_units(binary, run.run_id, run.backends).checkpoint()
        found = ingestion.document_rows(binary, run.root, run.run_id)
        run.write("ingestion_errors", units.where("error is not null").select("run_id", "doc_id", "source_unit_kind", "error"))
        units = units.where("error is null").drop("error")
    known = run.read("docs") if tables.exists(run.spark, run.path("docs")) else None
    new = ingestion.register_documents(found, known).checkpoint()
    run.warnings = ingestion.warnings(new, units, found, known)
    units = units.join(new.select("doc_id"), "doc_id", "left_semi").checkpoint()
    docs = ingestion.page_counts(new, units)
    chunks = ingestion.chunk_documents(units)
    if known is not None:
        docs, chunks = known.unionByName(docs), run.read("chunks").unionByName(chunks)
    return {"docs": run.write("docs", docs), "chunks": run.write("chunks", chunks)}


def extract(run: Run) -> dict[str, int]:
    entities = extraction.extract_entities(run.read("chunks"), run.tagger, run.batched_tagger).withColumn("run_id", F.lit(run.run_id))
    return {"entities": run.write("entities", entities, contracts.check_entities)}


def block(run: Run) -> dict[str, int]:
    entities = run.read("entities")
    vectors = entities.select("entity_id", run.embedder(F.col("normalized")).alias("embedding"), run.embedder(F.col("context")).alias("context_embedding"))
    run.write("embeddings", vectors)
    find = blocking.nearest_neighbours if run.exact_neighbours else blocking.indexed_neighbours
    near = find(run.read("embeddings"), "entity_id", "embedding", run.neighbours)
    sources = {"exact": blocking.exact_name_pairs(entities), "structured": blocking.structured_id_pairs(entities), "phonetic": blocking.phonetic_pairs(entities).drop("n_shared"), "minhash": blocking.minhash_pairs(entities), "faiss": blocking.neighbour_pairs(near)}
    n = run.write("candidate_pairs", blocking.union_candidates(sources, entities), contracts.check_candidate_pairs)
    tables.put_json(run.spark, manifest(run, n), run.path("handoff_manifest.json"))
    return {"candidate_pairs": n}


def manifest(run: Run, candidates: int) -> dict:
    """What the matching stages get from the blocking stage."""
    entities, first = run.read("entities"), run.read("embeddings").select(F.size("embedding").alias("n")).first()
    types = entities.groupBy("type").agg(F.count(F.lit(1)).alias("n")).collect()  # a handful of types
    return {
        "schema_version": "1.1", "run_id": run.run_id, "created_at": datetime.now(timezone.utc).isoformat(), "mention_count": sum(r.n for r in types), "candidate_count": candidates,
        "embedding_dim": first.n if first else None, "entity_types_present": sorted(r.type for r in types), "k": run.neighbours,
    }


def featurize(run: Run) -> dict[str, int]:
    entities = run.read("entities").join(run.read("embeddings").drop("run_id"), "entity_id", "left")
    columns = {"normalized": "name", "context": "context", "type": "entity_type", "doc_id": "doc_id", "embedding": "embedding", "context_embedding": "context_embedding"}
    return {"features": run.write("features", add_features(blocking.with_entities(run.read("candidate_pairs"), entities, columns)))}


def score(run: Run) -> dict[str, int]:
    rows = scoring.scored_pairs(run.read("features"), run.read("candidate_pairs"), run.model, "gbt" if run.model else "rules", run.shap)
    return {"scored_pairs": run.write("scored_pairs", rows, lambda staged: contracts.check_scored_pairs(staged, run.read("candidate_pairs")))}


def resolve(run: Run) -> dict[str, int]:
    resolution.check_thresholds(run.keep, run.neutral)
    entities = run.read("entities")
    scored = run.read("scored_pairs").select(F.col("entity_id_a").alias("a"), F.col("entity_id_b").alias("b"), "score", *resolution.LINEAGE)
    edges = resolution.retained_edges(scored, entities, run.keep).checkpoint()
    membership = resolution.resolve(entities, edges, run.neutral, diagnostics=True).checkpoint()
    evidence = resolution.cluster_evidence(membership, edges, run.neutral)
    records = resolution.cluster_records(membership.select("entity_id", "cluster_id"), entities.drop("run_id"), evidence, scored)
    method = membership.select("entity_id", "clustering_method", "component_id")
    rows = resolution.resolved_entities(records).join(method, "entity_id")
    rows = rows.select(
        F.lit(run.run_id).alias("run_id"), "cluster_id", "entity_id", "doc_id", "entity_type", "canonical_name", "canonical_type", F.col("cluster_size").cast("int").alias("cluster_size"), F.col("confidence").cast("float").alias("confidence"),
        "needs_review", "route_action", "clustering_method", "component_id", "doc_ids", F.lit(None).cast("string").alias("most_recent_doc_id"), F.lit(None).cast("date").alias("most_recent_doc_date"), "attributes",
    )
    n = run.write("resolved_entities", rows, contracts.check_resolved_entities)
    run.write("cluster_records", records)
    run.write("components", resolution.component_summaries(membership, edges, run.neutral))
    tables.put_json(run.spark, reports.diagnostics(run, edges), run.path("resolution_diagnostics.json"))
    return {"resolved_entities": n, "clusters": run.write("clusters", evidence)}


STAGES: list[tuple[str, Callable[[Run], dict[str, int]]]] = [("ingestion", ingest), ("extraction", extract), ("blocking", block), ("matching_features", featurize), ("matching_scoring", score), ("resolution", resolve)]


def run_pipeline(run: Run, stages=STAGES) -> dict:
    """All stages in order; a summary is written whatever happens.

    A stage that gives no rows ends the run as succeeded_no_results, and those after it are skipped; one that raises ends it as
    failed, and raises again once the summary is written.
    """
    ensure_checkpoints(run.spark)
    summary: dict = {"run_id": run.run_id, "status": "succeeded", "stages": []}
    ended, failure = False, None
    for name, stage in stages:
        if ended:
            summary["stages"].append({"stage": name, "status": "skipped"})
            continue
        began = time.monotonic()
        record: dict = {"stage": name, "status": "succeeded"}
        try:
            record["counts"] = stage(run)
            if not all(record["counts"].values()):
                ended, record["status"], summary["status"] = True, "no_results", "succeeded_no_results"
        except Exception as e:
            ended, failure, record["status"], summary["status"] = True, e, "failed", "failed"
            record["error"] = f"{type(e).__name__}: {e}"[:1000]
        record["elapsed_s"] = round(time.monotonic() - began, 3)
        summary["stages"].append(record)
    if run.warnings:
        summary["warnings"] = run.warnings
    tables.put_json(run.spark, summary, run.path("pipeline_summary.json"))
    if failure:
        raise failure
    return summary


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser()
    p.add_argument("--case-root", required=True)
    p.add_argument("--data-dir", required=True)
    p.add_argument("--run-id", default=None)
    p.add_argument("--enable-shap", default=False, action=argparse.BooleanOptionalAction)
    p.add_argument("--model", help="a saved model; rules score the pairs without one")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("kinweave").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    model = scoring.load(a.model)[0] if a.model else None
    summary = run_pipeline(Run(spark, a.data_dir, a.run_id or uuid.uuid4().hex, a.case_root, model=model, shap=a.enable_shap))
    print(summary["status"])
    return 0


if __name__ == "__main__":
    sys.exit(main())
