"""Reports on a run: the resolution's diagnostics, labels from gold mentions, the evaluation, prepared cases and folds.

Tables stay tables; what a report collects is counts, metrics and a bounded number of examples.
"""

from __future__ import annotations

import argparse
import hashlib
import json
import os
from datetime import datetime, timezone
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import evaluation, folds, resolution, scoring
from ..sources import tables

if TYPE_CHECKING:
    from .pipeline import Run

#: Examples of each kind of error in a report.
EXAMPLES = 10


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(True) for r in df.collect()]


def diagnostics(run: Run, edges: DataFrame) -> dict:
    """Timing, sizes and routes of a resolved run."""
    components = run.read("components")
    timing = components.where("not is_trivial").select("component_id", "size", "elapsed_ms")
    sizes = _rows(resolution.component_sizes(components.select("component_id", F.col("size").alias("component_size"))).orderBy("size"))
    return {
        "run_id": run.run_id, "components": components.count(), "retained_edges": edges.count(), "timing": _rows(resolution.timing_summary(timing))[0], "timing_by_size": _rows(resolution.timing_by_bucket(timing).orderBy("bucket")),
        "component_sizes": sizes, "early_stopped": components.where("early_stopped").count(), "pivot_runs": components.agg(F.sum("runs")).first()[0] or 0,
    }


def gold_bridge(run: Run, gold: DataFrame) -> dict[str, DataFrame | dict]:
    """What labels and evaluation need: gold mentions placed in the run's texts, predicted ones, groups of entities, labels.

    Tables: trusted (gold mentions that were found), predicted, groups (entity_id, gold_group), labels; counts: what was left out.
    """
    docs, chunks, entities, pairs = (run.read(t) for t in ("docs", "chunks", "entities", "candidate_pairs"))
    from ..operators.ingestion import rebuild_text

    placed = evaluation.realigned(evaluation.with_document_ids(gold, docs), rebuild_text(chunks)).checkpoint()
    trusted = placed.where("char_start is not null").checkpoint()
    predicted = evaluation.predicted_mentions(entities, chunks).checkpoint()
    matches = evaluation.two_phase_match(trusted, predicted).checkpoint()
    found = matches.join(trusted.select("mention_id", "group_id"), "mention_id").select("entity_id", "group_id")
    groups = evaluation.gold_groups(entities, found).checkpoint()
    keys = pairs.select("entity_id_a", "entity_id_b")
    labels = evaluation.labels_from_gold(keys, groups).withColumn("run_id", F.lit(run.run_id)).checkpoint()
    n_gold, n_trusted, n_pairs, n_labels = placed.count(), trusted.count(), pairs.count(), labels.count()
    missing = F.startswith("gold_group", F.lit(evaluation.NO_GROUP))
    many = F.startswith("gold_group", F.lit(evaluation.MANY_GROUPS))
    left_out = groups.agg(F.count_if(missing).alias("m"), F.count_if(many).alias("a"), F.count(F.lit(1)).alias("n")).first()
    phases = {r.phase: r.n for r in matches.groupBy("phase").agg(F.count(F.lit(1)).alias("n")).collect()}
    counts = {
        "gold_mentions": n_gold, "trusted_gold_mentions": n_trusted, "matched_mentions_by_method": phases, "matched_mention_rate": round(sum(phases.values()) / n_trusted, 6) if n_trusted else 0.0, "entities": left_out.n,
        "entities_without_gold_match": left_out.m, "entities_with_ambiguous_gold_groups": left_out.a, "label_rows_written": n_labels, "candidate_pairs": n_pairs, "candidate_pairs_excluded_from_labels": n_pairs - n_labels,
    }
    return {"trusted": trusted, "predicted": predicted, "groups": groups, "labels": labels, "counts": counts}


def write_labels(run: Run, gold: DataFrame, shared: str | None = None, documents: list[str] | None = None, bridge: dict | None = None) -> dict:
    """The labels of the run's candidates as a table of the run and, if asked, in a shared table, there only of pairs of ``documents``."""
    bridge = bridge or gold_bridge(run, gold)
    labels = bridge["labels"]
    run.write("labels", labels)
    if shared:
        if documents is not None:
            own = run.read("entities").where(F.col("doc_id").isin(documents)).select("entity_id")
            for s in "ab":
                labels = labels.join(own.withColumnRenamed("entity_id", f"entity_id_{s}"), f"entity_id_{s}", "left_semi")
        tables.upsert_run(labels, shared)
    return {"run_id": run.run_id, "labels_path": run.path("labels"), "bridge": bridge["counts"]}


def run_evaluation(run: Run, gold: DataFrame, threshold: float = 0.5, baseline: dict | None = None, shared: str | None = None, documents: list[str] | None = None) -> dict:
    """Mentions, blocking, matching and clusters of a resolved run against gold mentions; written as JSON and Markdown too.

    Only entities with one gold group count. baseline: metrics of an earlier report, from which a fall is told.
    """
    if not 0 <= threshold <= 1:
        raise ValueError("the threshold lies between 0 and 1")
    bridge = gold_bridge(run, gold)
    write_labels(run, gold, shared, documents, bridge)
    groups = bridge["groups"].where(evaluation.labelable(F.col("gold_group")))
    resolved = run.read("resolved_entities")
    membership = groups.join(resolved.select("entity_id", F.col("cluster_id").alias("predicted_cluster")), "entity_id").checkpoint()
    positive = evaluation.positive_pairs(membership, "gold_group").select("a", "b").checkpoint()
    scored = run.read("scored_pairs").join(bridge["labels"].select("entity_id_a", "entity_id_b", "label"), ["entity_id_a", "entity_id_b"])
    ends = [F.least("entity_id_a", "entity_id_b").alias("a"), F.greatest("entity_id_a", "entity_id_b").alias("b")]
    metrics = _rows(evaluation.cluster_metrics(membership))[0]
    span = evaluation.SPAN
    report = {
        "run_id": run.run_id, "evaluated_at": datetime.now(timezone.utc).isoformat(), "alignment": bridge["counts"], "metrics": {k: v for k, v in metrics.items() if k != "n"}, "evaluated_entities": metrics["n"],
        "stage_metrics": {
            "extraction": _rows(evaluation.set_metrics(bridge["trusted"].select(span), bridge["predicted"].select(span)))[0],
            "blocking": _rows(evaluation.blocking_recall(positive, run.read("candidate_pairs").select(*ends)))[0],
            "matching": {"score_threshold": threshold} | _rows(evaluation.set_metrics(positive, scored.where(F.col("score") >= threshold).select(*ends)))[0],
        },
        "error_analysis": {
            "extraction": _rows(evaluation.missing_and_spurious(bridge["trusted"], bridge["predicted"]).orderBy("entity_type", "kind")),
            "false_merges": _rows(evaluation.false_merges(membership).orderBy(F.desc("n_pairs"), "predicted_cluster").limit(EXAMPLES)),
            "false_splits": _rows(evaluation.false_splits(membership).orderBy(F.desc("n_clusters"), "gold_group").limit(EXAMPLES)),
        },
    }
    report["regression_checks"] = evaluation.regression_checks(report["metrics"], baseline) + ([] if metrics["n"] else ["no entity could be evaluated"])
    tables.put_json(run.spark, report, run.path("evaluation_report.json"))
    tables.put_text(run.spark, markdown(run, report), run.path("evaluation_report.md"))
    return report


def markdown(run: Run, report: dict) -> str:
    """An evaluation as Markdown tables."""
    table = lambda d, title: tables.markdown_table(run.spark.createDataFrame([(k, str(v)) for k, v in d.items()], "name string, value string"), title)
    parts = [f"# Run {report['run_id']}\n", table(report["metrics"], "Clusters"), *(table(v, k.capitalize()) for k, v in report["stage_metrics"].items()), table({k: v for k, v in report["alignment"].items() if not isinstance(v, dict)}, "Gold mentions")]
    checks = "\n".join(f"* {c}" for c in report["regression_checks"]) or "None."
    return "\n".join([*parts, "## What is wrong", "", checks, "", folds.reading(report["metrics"])]) + "\n"


# Prepared cases and folds


def identity(run: Run) -> str:
    """Names the input of a prepared case: the paths, sizes and contents of its documents."""
    rows = run.read("docs").select("path", "file_size", "doc_id")
    n, low = rows.agg(F.count(F.lit(1)), F.sum(F.xxhash64("path", "file_size", "doc_id").cast("decimal(38,0)"))).first()
    return hashlib.sha256(f"{n}|{low}".encode()).hexdigest()[:16]


def prepare_case(run: Run, gold: DataFrame, stages) -> DataFrame:
    """The labelled features of a case. Stages up to the features run only if the case's documents aren't those of the last time."""
    mark = run.path("case_identity.json")
    stages[0][1](run)
    now = identity(run)
    if not (tables.exists(run.spark, mark) and tables.exists(run.spark, run.path("features")) and _text(run, mark).get("identity") == now):
        for name, stage in stages[1:]:
            if name in ("extraction", "blocking", "matching_features"):
                stage(run)
        tables.put_json(run.spark, {"identity": now}, mark)
    write_labels(run, gold)
    return folds.labelled_matrix(run.read("features"), run.read("labels").select(*folds.KEYS, "label"))


def _text(run: Run, path: str) -> dict:
    rows = run.spark.read.text(path, wholetext=True).collect()
    return json.loads(rows[0][0]) if rows else {}


def train_fold(matrices: list[DataFrame], path: str, version: str, **params) -> dict:
    """Train on several cases' labelled features and save; gives what a fold's summary tells of its training."""
    every = matrices[0]
    for m in matrices[1:]:
        every = every.unionByName(m)
    every = every.checkpoint()
    model = scoring.train(every, **params)
    stats = _rows(folds.run_statistics(every).orderBy("run_id"))
    scoring.save(model, path, version, runs=stats)
    return {"model_path": path, "version": version, "runs": stats, "n_pairs": sum(r["n_pairs"] for r in stats), "n_positive": sum(r["n_positive"] for r in stats)}


def fold_row(fold: folds.Fold, training: dict, report: dict) -> dict:
    """One row of the summary of folds."""
    return {"fold": fold.name, "held_out": fold.held_out, "train": "/".join(fold.train), "n_pairs": training["n_pairs"], "n_positive": training["n_positive"], "version": training["version"]} | {m: report["metrics"][m] for m in folds.METRICS}


def run_folds(plan: folds.Plan, runs: dict[str, Run], gold: dict[str, DataFrame], folder: str, stages, **params) -> DataFrame:
    """Prepare each case once; then, fold by fold, train on its cases, score and resolve the one held out, and evaluate.

    runs and gold: of each case. Gives a row of metrics for each fold, which is written as CSV too.
    """
    matrices = {c: prepare_case(runs[c], gold[c], stages) for c in plan.cases}
    own = dict(stages)
    rows = []
    for fold in plan.folds:
        training = train_fold([matrices[c] for c in fold.train], f"{folder.rstrip('/')}/{fold.name}/model", fold.name, **params)
        held = runs[fold.held_out]
        held.model = scoring.load(training["model_path"])[0]
        for stage in ("matching_scoring", "resolution"):
            own[stage](held)
        rows.append(fold_row(fold, training, run_evaluation(held, gold[fold.held_out])))
    spark = next(iter(runs.values())).spark
    out = spark.createDataFrame(rows)
    tables.write_csv(out, f"{folder.rstrip('/')}/folds")
    tables.put_json(spark, {m: sum(r[m] for r in rows) / len(rows) for m in folds.METRICS}, f"{folder.rstrip('/')}/mean.json")
    return out


def main(args: list[str] | None = None) -> int:
    """``python -m kinweave.plans.reports --plan plan.json --folder DIR``: run the folds of a plan whose cases name their root and gold."""
    from pyspark.sql import SparkSession

    from .pipeline import STAGES, Run

    p = argparse.ArgumentParser()
    p.add_argument("--plan", required=True)
    p.add_argument("--folder", required=True)
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("kinweave folds").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    payload = json.loads(spark.read.text(a.plan, wholetext=True).first()[0])
    plan = folds.read_plan(payload)
    runs = {c["name"]: Run(spark, os.path.join(a.folder, "cases"), c["name"], c["root"]) for c in payload["cases"]}
    gold = {c["name"]: tables.read_gold(spark, c["gold"]) for c in payload["cases"]}
    run_folds(plan, runs, gold, a.folder, STAGES).show(truncate=False)
    return 0


def mock_tables(spark, run_id: str = "mock") -> tuple[DataFrame, DataFrame]:
    """Two people and two organisations as valid entities, and the pair of either kind as candidates: for tests of what follows."""
    named = [("Per Hansen", "PER", 0), ("P. Hansen", "PER", 4), ("Fjord Invest AS", "ORG", 9), ("F. Invest", "ORG", 30)]
    rows = [(run_id, text, kind, at) for text, kind, at in named]
    base = spark.createDataFrame(rows, "run_id string, text string, type string, char_start int")
    key = lambda salt: F.substring(F.sha2(F.concat_ws("/", F.lit(salt), "type", "text"), 256), 1, 32)
    entities = base.select("run_id", key("e").alias("entity_id"), key("d").alias("doc_id"), key("c").alias("chunk_id"), "text", F.lower("text").alias("normalized"), "type", "char_start", (F.col("char_start") + F.length("text")).alias("char_end"), F.concat(F.lit("seen: "), "text").alias("context"), F.lit(1).alias("count"))
    entities = entities.withColumn("positions", F.array(F.struct("chunk_id", "char_start", "char_end", F.lit(0).alias("page_num"), F.lit("docx_paragraph").alias("source_unit_kind"))))
    w = Window.partitionBy("type")
    pairs = entities.select("run_id", "type", F.min("entity_id").over(w).alias("entity_id_a"), F.max("entity_id").over(w).alias("entity_id_b")).distinct().drop("type")
    return entities, pairs.select("*", F.array(F.lit("exact")).alias("blocking_methods"), F.lit("exact").alias("blocking_source"), F.lit(1).cast("tinyint").alias("blocking_method_count"))


if __name__ == "__main__":
    import sys

    sys.exit(main())
