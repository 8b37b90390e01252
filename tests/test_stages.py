"""Contracts, scoring, folds, training data, annotation, files, and the six stages together."""

import io
import itertools
import json
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinweave.operators import annotation, contracts, folds, scoring, synthetic
from kinweave.plans import pipeline
from kinweave.sources import files, tables
from kinweave.streaming import registration

A, B, C = ("0" * 31 + x for x in "123")


def rules(df):
    return {r.rule for r in df.collect()}


def candidates(spark, *rows):
    return spark.createDataFrame(list(rows), contracts.SCHEMAS["candidate_pairs"])


def test_candidate_contract(spark):
    good = ("r", A, B, ["exact", "faiss"], "multi", 2)
    assert rules(contracts.check_candidate_pairs(candidates(spark, good, ("r", A, C, ["exact"], "exact", 1)))) == set()
    for bad, rule in [(("R", *good[1:]), "run_id"), (("r", B, A, *good[3:]), "order"), (("r", "x", B, *good[3:]), "entity_id_a"), (("r", A, B, ["faiss", "exact"], "multi", 2), "sorted methods"), (("r", A, B, ["exact"], "multi", 1), "source of methods"),
                      (("r", A, B, ["exact"], "exact", 2), "count"), (("r", A, B, ["magic"], "exact", 1), "known methods"), (("r", A, B, None, None, None), "source"), ((None, None, None, None, None, None), "run_id")]:
        assert rule in rules(contracts.check_candidate_pairs(candidates(spark, bad))), (bad, rule)
    assert "unique pair" in rules(contracts.check_candidate_pairs(candidates(spark, good, good)))
    with pytest.raises(ValueError, match="order"):
        contracts.require(contracts.check_candidate_pairs(candidates(spark, ("r", B, A, *good[3:]))), "candidate_pairs")


def test_scored_contract(spark):
    import datetime

    row = lambda score, shap, b=B: ("r", A, b, score, "v", datetime.datetime(2024, 1, 1), ["exact"], "exact", 1, shap)
    make = lambda *rows: spark.createDataFrame(list(rows), contracts.SCHEMAS["scored_pairs"])
    cand = candidates(spark, ("r", A, B, ["exact"], "exact", 1))
    assert rules(contracts.check_scored_pairs(make(row(0.5, [("f", -2.0), ("g", 1.0)])), cand)) == set()
    assert "shap order" in rules(contracts.check_scored_pairs(make(row(0.5, [("f", 1.0), ("g", -2.0)]))))
    assert "score" in rules(contracts.check_scored_pairs(make(row(float("nan"), [])))) and "score" in rules(contracts.check_scored_pairs(make(row(1.5, []))))
    assert rules(contracts.check_scored_pairs(make(row(0.5, [], C)), cand)) == {"no candidate", "not scored"}


def test_schema(spark):
    assert contracts.schema_errors(candidates(spark), "candidate_pairs") == []
    assert len(contracts.schema_errors(spark.createDataFrame([], "run_id int"), "labels")) == 4


def labelled(spark, n=300):
    rng = random.Random(3)
    rows = [("r", f"{i:032x}", f"{i + 1000:032x}", x := rng.random(), y := rng.random(), rng.random(), int(x + 0.3 * y > 0.6)) for i in range(n)]
    return spark.createDataFrame(rows, "run_id string, entity_id_a string, entity_id_b string, x double, y double, z double, label int")


def test_model_scores_and_explains(spark, tmp_path):
    rows, names = labelled(spark), ["x", "y", "z"]
    model = scoring.train(rows, names, maxIter=8, minInstancesPerNode=5)
    got = scoring.score(rows, model)
    assert got.columns == [*rows.columns, "score"] and dict(got.dtypes)["score"] == "float"
    m = scoring.evaluate(got).first()
    assert m.precision > 0.9 and m.average_precision > 0.95
    # Shapley values against all orders of the features, with the path-dependent expectation as value of a subset.
    leaves = scoring._leaves(model.stages[-1])
    x = np.array([[r.x, r.y, r.z] for r in rows.take(4)])
    value = lambda row, known: sum(v * np.prod([float(lo < row[f] <= hi) if f in known else share for f, lo, hi, share in path]) for v, path in leaves)
    want = np.zeros_like(x)
    for order in itertools.permutations(range(3)):
        for i, row in enumerate(x):
            for k, f in enumerate(order):
                want[i, f] += (value(row, set(order[: k + 1])) - value(row, set(order[:k]))) / 6
    assert np.allclose(scoring.contributions(leaves, x), want)
    top = scoring.explain(rows, model, 2).first().shap_top5
    assert len(top) == 2 and abs(top[0].value) >= abs(top[1].value)
    again = scoring.score(rows.repartition(7), scoring.train(rows.repartition(5), names, maxIter=8, minInstancesPerNode=5))
    assert {(r.entity_id_a, r.score) for r in got.collect()} == {(r.entity_id_a, r.score) for r in again.collect()}
    scoring.save(model, str(tmp_path / "m"), "1")
    loaded, about = scoring.load(str(tmp_path / "m"), names)
    assert about["version"] == "1" and scoring.score(rows, loaded).first().score == got.first().score
    with pytest.raises(ValueError):
        scoring.load(str(tmp_path / "m"), ["x"])
    with pytest.raises(ValueError):
        scoring.train(rows.where("label = 1"), names)


def test_split_and_search(spark):
    rows = labelled(spark, 100)
    got = scoring.split(rows, ["entity_id_a"])
    for label in (0, 1):
        n = rows.where(F.col("label") == label).count()
        assert got.where((F.col("label") == label) & F.col("in_train")).count() == round(0.75 * n + 1e-9)
    once, twice = (scoring.search(lambda p: -abs(p["maxIter"] - 100), 12) for _ in range(2))
    assert once == twice and once["n_trials"] == 12
    assert scoring.search(lambda p: 1 / 0, 2)["best_value"] == -1


def test_folds(spark):
    plan = folds.read_plan({"cases": ["a", "b", "c", "t"], "folds": [{"train": ["a", "b"], "held_out": "c"}, {"train": ["c"], "held_out": "a"}], "final_test": "t"})
    for bad in ({"train": ["a", "a"], "held_out": "b"}, {"train": ["a"], "held_out": "a"}, {"train": ["x"], "held_out": "a"}, {"train": ["t"], "held_out": "a"}):
        with pytest.raises(ValueError):
            folds.read_plan({"cases": ["a", "b", "t"], "folds": [bad], "final_test": "t"})
    run = lambda fold, params, keep, neutral: {m: 0.8 for m in folds.METRICS} | {"pairwise_f0_5": keep, "pairwise_recall": 0.9 if keep < 0.7 else 0.5}
    study = folds.run_study(plan, run, lambda rng: {}, 10)
    assert study["best"]["trusted"] and study["best"]["keep"] < 0.7 and study["final_test"]
    assert folds.run_study(plan, run, lambda rng: {}, 12, known=study)["trials"][:10] == study["trials"]
    with pytest.raises(ValueError):
        folds.run_study(plan, run, lambda rng: {}, 1, known=study | {"fingerprint": "x"})
    broken = folds.run_trial(plan, lambda *a: 1 / 0, {}, 0.6, 0.8)
    assert broken["objective"] == folds.FAILED and not broken["trusted"]
    assert folds.geometric_mean([0.5, 0.0]) == 0 and folds.geometric_mean([4.0, 1.0]) == 2
    for seed in range(50):
        keep, neutral = folds.draw_thresholds(random.Random(seed))
        assert 0.45 <= keep <= 0.75 and max(0.65, round(keep + 0.1, 2)) <= neutral <= 0.9
    f = labelled(spark, 5).drop("label")
    y = labelled(spark, 5).select("run_id", "entity_id_a", "entity_id_b", "label")
    assert folds.labelled_matrix(f, y).count() == 5
    with pytest.raises(Exception, match="no features"):
        folds.labelled_matrix(f.limit(2), y).collect()
    with pytest.raises(Exception, match="repeated"):
        folds.labelled_matrix(f.unionByName(f), y).collect()


def groups(n=6):
    return [{"group_id": f"g{i}", "entity_type": "PER" if i % 2 else "ORG", "doc_ids": ["d1", "d2"], "variants": [{"text": f"N{i} {j}", "normalized": f"n{i} {j}", "context": "c"} for j in range(4)]} for i in range(n)]


def test_synthetic(spark):
    synthetic.check_groups(groups(), [{"group_id_a": "g0", "group_id_b": "g2"}])
    for bad in ([], groups()[:1] * 2, [groups()[0] | {"entity_type": "X"}], [groups()[0] | {"variants": []}]):
        with pytest.raises(ValueError):
            synthetic.check_groups(bad)
    df = spark.createDataFrame([(g["group_id"], g["entity_type"], g["doc_ids"], [tuple(v.values()) for v in g["variants"]]) for g in groups()], synthetic.GROUPS)
    e = synthetic.group_entities(df, "r").cache()
    hard = spark.createDataFrame([("g2", "g0")], "group_id_a string, group_id_b string")
    pairs = synthetic.training_pairs(e, hard, most=100, rate=0.2).collect()
    positive = [p for p in pairs if p.label]
    assert len(pairs) == 100 and len(positive) == 20
    group = {r.entity_id: r.group_id for r in e.collect()}
    assert all((group[p.entity_id_a] == group[p.entity_id_b]) == bool(p.label) for p in pairs)
    assert sum({group[p.entity_id_a], group[p.entity_id_b]} == {"g0", "g2"} for p in pairs) == 16, "hard pairs come first"
    v = synthetic.group_vectors(e, 32)
    assert not contracts.check_embeddings(v, e, dim=32).collect() and "no vector" in rules(contracts.check_embeddings(v.limit(3), e, dim=32))
    assert {r.entity_type: r.n for r in synthetic.quotas(df, {"PER": 3, "ORG": 2}).collect()} == {"ORG": 3}


def task(doc, spans, text="Per Hansen met Kari", cancelled=False):
    value = lambda s: dict(type="labels", value=dict(zip(("start", "end", "labels", "text"), (*s, text[s[0] : s[1]]))))
    return {"id": 1, "data": {"case_id": "c", "doc_id": doc, "doc_name": doc, "text": text}, "annotations": [{"was_cancelled": True, "result": []}, {"was_cancelled": cancelled, "result": [value(s) for s in spans]}]}


def test_annotation(spark, tmp_path):
    path = tmp_path / "export.json"
    path.write_text(json.dumps([task("a", [(0, 10, ["PER"]), (15, 19, ["PER"]), (3, 3, [])]), task("b", [(0, 10, ["PER"]), (5, 12, ["PER", "ORG"])]), task("c", [], cancelled=True)]))
    spans = annotation.without_empty_spans(annotation.labelled_spans(annotation.read_export(spark, str(path))))
    got = {(r.doc_id, r.rule) for r in annotation.export_errors(spans).collect()}
    assert got == {("b", "label"), ("b", "overlap"), ("c", "annotations")}
    gold = annotation.gold_mentions(spans.where("doc_id = 'a'")).collect()
    assert sorted(g.text for g in gold) == ["Kari", "Per Hansen"] and all(g.mention_id.startswith("m_") and len(g.mention_id) == 22 for g in gold)
    docs = spark.createDataFrame([("d", "Kari Berg and kari, Bergen; DNB  ASA"), ("e", None)], "doc_id string, text string")
    found = annotation.suggest(docs, {"PER": ["Kari", "Kari Berg"], "ORG": ["dnb asa"], "LOC": []}).collect()
    assert [(r.type, r.text) for r in found] == [("PER", "Kari Berg"), ("PER", "kari"), ("ORG", "DNB  ASA")]
    assert annotation.read_brief("title: 'A b' # c\nnames: [x, 'y, z']\nmore:\n  - one\n  - two\n") == {"title": "A b", "names": ["x", "y, z"], "more": ["one", "two"]}


W = f'xmlns:w="{files._W[1:-1]}"'


def docx(paragraphs, cells=()):
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    table = f"<w:tbl><w:tr>{''.join(f'<w:tc>{p(c)}</w:tc>' for c in cells)}</w:tr></w:tbl>" if cells else ""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{''.join(map(p, paragraphs))}{table}</w:body></w:document>")
    return out.getvalue()


def test_docx():
    assert files.docx_units(docx(["one", "two"], ["c1", "c2"])) == ["one", "two", "c1", "c2"]


def test_tables(spark, tmp_path):
    assert tables.run_of_folder(tables.run_folder("a/b c")) == "a/b c" and tables.run_of_folder("x") is None
    p = str(tmp_path / "t")
    rows = spark.createDataFrame([("r", 1), ("r", 2), ("s", 1)], "run_id string, k int")
    assert tables.append_new(rows, p, ["run_id", "k"]) == 3 and tables.append_new(rows.unionByName(spark.createDataFrame([("s", 5)], rows.schema)), p, ["run_id", "k"]) == 1
    tables.upsert_run(spark.createDataFrame([("s", 9)], rows.schema), p)
    assert {(r.run_id, r.k) for r in spark.read.parquet(p).collect()} == {("r", 1), ("r", 2), ("s", 9)}
    gold = tmp_path / "gold.csv"
    gold.write_text("doc_id,mention_id,char_start,char_end,text,entity_type,group_id,case_id\nd,m,1,5,\"a, b\",PER,g,c\n")
    r = tables.read_gold(spark, str(gold)).first()
    assert (r.text, r.char_start, r.doc_name) == ("a, b", 1, None)
    (tmp_path / "bad.csv").write_text("doc_id\nx\n")
    with pytest.raises(ValueError):
        tables.read_gold(spark, str(tmp_path / "bad.csv"))
    tables.write_csv(spark.createDataFrame([(1, ["a", "b"])], "x int, y array<string>"), str(tmp_path / "o"))
    assert [tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "o")).collect()] == [("1", "a|b")]
    assert "| 0.5000 |" in tables.markdown_table(spark.createDataFrame([(0.5,)], "x double"), "T")
    run = tmp_path / tables.run_folder("r1")
    cluster = {"cluster_id": "x", "cluster_size": 2, "confidence": 0.9, "routing_actions_by_profile": dict.fromkeys(("quick_low_hitl", "balanced_hitl"), "auto_merge")}
    tables.write_json({"run_id": "r1", "cluster_count": 1, "clusters": [cluster]}, str(run / "clusters.json"))
    assert tables.discover_runs(str(tmp_path)) == ["r1"] and tables.read_clusters(spark, str(run / "clusters.json")).first().quick_low_hitl == "auto_merge"
    empty, why = tables.read_clusters_or_empty(spark, str(tmp_path / "none.json"))
    assert empty.count() == 0 and why and tables.read_json_or_none(str(tmp_path / "none.json")) is None


def test_pipeline_of_files(spark, tmp_path):
    root = tmp_path / "case" / "sub"
    root.mkdir(parents=True)
    people = ["Per Hansen met Kari Nordmann at Storgata 12.", "Mail per_hansen at per@x.no or 912 34 567.", "Essex Constabulary wrote to Per Hansen."]
    (root / "a.DOCX").write_bytes(docx(people))
    (root / "b.docx").write_bytes(docx([*people[1:], "Kari Nordmann answered Per Hansen.", "Mail per@x.no."]))
    (root / "broken.docx").write_bytes(b"no zip")
    (root / "note.txt").write_text("x")
    run = pipeline.Run(spark, str(tmp_path / "out"), "r1", str(tmp_path / "case"), neighbours=5)
    summary = pipeline.run_pipeline(run)
    assert summary["status"] == "succeeded" and {s["status"] for s in summary["stages"]} == {"succeeded"} and len(summary["stages"]) == 6
    assert summary["stages"][0]["counts"]["docs"] == 3
    got = {}
    for r in run.read("resolved_entities").collect():
        got.setdefault((r.canonical_type, r.canonical_name), set()).add(r.doc_id)
    assert len(got["COMM", "per@x.no"]) == 2 and ("PER", "Per Hansen") in got
    assert pipeline.run_pipeline(run)["stages"][0]["counts"]["docs"] == 3, "registered documents stay"


def test_pipeline_ends_early(spark, tmp_path):
    empty = pipeline.Run(spark, str(tmp_path / "o"), "r", units=spark.createDataFrame([("d", "docx_paragraph", 0, "nothing here")], "doc_id string, source_unit_kind string, page_num int, text string"))
    summary = pipeline.run_pipeline(empty)
    assert summary["status"] == "succeeded_no_results" and "/".join(s["status"] for s in summary["stages"]) == "succeeded/no_results" + "/skipped" * 4
    (tmp_path / "none").mkdir()
    with pytest.raises(FileNotFoundError):
        pipeline.run_pipeline(pipeline.Run(spark, str(tmp_path / "o2"), "r", str(tmp_path / "none")))
    assert json.loads((tmp_path / "o2" / tables.run_folder("r") / "pipeline_summary.json").read_text())["status"] == "failed"


def test_streamed_registration(spark, tmp_path):
    src = tmp_path / "src"
    rows = lambda *texts: spark.createDataFrame([(t,) for t in texts], "text string").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    rows("a", "b", "a").write.mode("append").parquet(str(src))
    stream = lambda: registration.arriving(spark.readStream.schema("text string, ts timestamp").parquet(str(src)))
    for _ in range(2):
        registration.register(stream(), str(tmp_path / "docs"), str(tmp_path / "ckpt"), "r").awaitTermination()
        rows("b", "c").write.mode("append").parquet(str(src))
    registration.register(stream(), str(tmp_path / "docs"), str(tmp_path / "ckpt2"), "r").awaitTermination()
    assert sorted(r.text for r in spark.read.parquet(str(tmp_path / "docs")).collect()) == ["a", "b", "c"]
