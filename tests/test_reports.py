"""Evaluation, labels, manifest and folds over the runs of two small cases."""

import json

import pytest
from pyspark.sql import functions as F

from kinweave.operators import contracts, evaluation, folds
from kinweave.plans import pipeline, reports
from kinweave.sources import tables

PEOPLE = ["Per Hansen", "Kari Nordmann", "Ola Berg", "Anne Lund"]


def case(spark, folder, name, shift):
    rows = []
    for n in range(4):
        who = [PEOPLE[(n + k + shift) % 4] for k in range(3)]
        rows.append((f"{n}{name}" * 16, "docx_paragraph", 0, f"{who[0]} met {who[1]} in town {n}. Later {who[2]} wrote to {who[0]} about case {name}."))
    units = spark.createDataFrame([(d[:32].ljust(32, "0"), *r) for d, *r in rows], "doc_id string, source_unit_kind string, page_num int, text string")
    return pipeline.Run(spark, folder, name, units=units, neighbours=5)


def gold_of(run):
    """Gold mentions that the run finds all of, one group for each name."""
    found = evaluation.predicted_mentions(run.read("entities"), run.read("chunks"))
    rows = found.select(F.lit(run.run_id).alias("case_id"), "doc_id", F.lit(None).cast("string").alias("doc_name"), F.col("pred_id").alias("mention_id"), F.col("char_start").cast("int").alias("char_start"), F.col("char_end").cast("int").alias("char_end"), "text", "entity_type", F.col("text").alias("group_id"))
    return found.sparkSession.createDataFrame(rows.collect(), rows.schema)  # as a file's, it doesn't change with the run's tables


@pytest.fixture(scope="module")
def cases(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("runs"))
    runs = {name: case(spark, folder, name, shift) for name, shift in (("a", 0), ("b", 1))}
    for run in runs.values():
        assert pipeline.run_pipeline(run)["status"] == "succeeded"
    return folder, runs


def text(spark, path):
    return spark.read.text(path, wholetext=True).first()[0]


def test_evaluation(spark, cases):
    _, runs = cases
    run = runs["a"]
    report = reports.run_evaluation(run, gold_of(run), shared=f"{run.folder}/shared_labels")
    assert report["metrics"]["pairwise_recall"] == 1.0 == report["metrics"]["bcubed_f1"] and report["regression_checks"] == []
    assert report["stage_metrics"]["extraction"]["f1"] == 1.0 and report["stage_metrics"]["blocking"]["recall"] == 1.0
    assert report["alignment"]["entities_without_gold_match"] == 0 and report["alignment"]["trusted_gold_mentions"] == report["alignment"]["gold_mentions"] > 0
    assert json.loads(text(spark, run.path("evaluation_report.json")))["run_id"] == "a" and "## Clusters" in text(spark, run.path("evaluation_report.md"))
    assert spark.read.parquet(f"{run.folder}/shared_labels").count() == run.read("labels").count() > 0
    worse = reports.run_evaluation(run, gold_of(run), baseline={"nmi": 2.0})
    assert worse["regression_checks"] and "nmi" in worse["regression_checks"][0]
    with pytest.raises(ValueError):
        reports.run_evaluation(run, gold_of(run), threshold=2)


def test_manifest_and_diagnostics(spark, cases):
    _, runs = cases
    run = runs["a"]
    told = json.loads(text(spark, run.path("handoff_manifest.json")))
    assert told["mention_count"] == run.read("entities").count() and told["candidate_count"] == run.read("candidate_pairs").count() and told["entity_types_present"] == ["PER"]
    found = json.loads(text(spark, run.path("resolution_diagnostics.json")))
    components = run.read("components")
    assert found["components"] == components.count() and components.where("n_edges > 0").count() > 0
    assert components.where("is_trivial <> (runs = 0) or elapsed_ms is null or n_clusters > size").count() == 0
    edges = run.read("cluster_records").where(F.size("edges") > 0).select(F.explode("edges").alias("e")).select("e.*")
    assert {"score", "blocking_methods", "shap_top5"} <= set(edges.columns) and edges.count() > 0


def test_folds(spark, cases, tmp_path):
    _, runs = cases
    plan = folds.read_plan({"cases": ["a", "b"], "folds": [{"train": ["a"], "held_out": "b"}]})
    gold = {c: gold_of(r) for c, r in runs.items()}
    out = reports.run_folds(plan, runs, gold, str(tmp_path), pipeline.STAGES, maxIter=3, minInstancesPerNode=1)
    row = out.first()
    assert row.held_out == "b" and 0 <= row.pairwise_recall <= 1 and row.n_pairs > row.n_positive > 0
    before = runs["a"].read("features").inputFiles()
    reports.prepare_case(runs["a"], gold["a"], pipeline.STAGES)
    assert runs["a"].read("features").inputFiles() == before, "a case that hasn't changed isn't prepared again"


def test_mock_tables(spark):
    entities, pairs = reports.mock_tables(spark)
    assert entities.count() == 4 and pairs.count() == 2
    assert contracts.check_entities(entities).count() == 0 and contracts.check_candidate_pairs(pairs).count() == 0


def test_a_broken_contract_keeps_the_old_table(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.replace_table(spark.range(3), path)

    def refuse(_):
        raise ValueError("no")

    with pytest.raises(ValueError):
        tables.replace_table(spark.range(9), path, refuse)
    assert spark.read.parquet(path).count() == 3
