import pytest
from pyspark.sql import functions as F

from kinweave.operators import blocking, evaluation, graph, resolution, review


def edges(spark, rows):
    return spark.createDataFrame(rows, "a string, b string, score float")


def nodes(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "entity_id string")


def clusters(rows):
    out = {}
    for r in rows:
        out.setdefault(r.cluster_id, set()).add(r.entity_id)
    return sorted(map(sorted, out.values()))


def test_components_at_the_threshold(spark):
    e = resolution.retained_edges(edges(spark, [("a", "b", 0.6), ("c", "b", 0.9), ("c", "d", 0.59), ("d", "e", 0.95), ("e", "f", 0.1)]))
    assert clusters(resolution.components(nodes(spark, "abcdef"), e).withColumnRenamed("component_id", "cluster_id").collect()) == [["a", "b", "c"], ["d", "e"], ["f"]]


def test_components_of_a_long_chain_and_no_edges(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)], "src int, dst int")
    got = graph.connected_components(chain).collect()
    assert {r.node for r in got} == set(range(61)) and {r.component for r in got} == {0}
    assert graph.connected_components(chain.where("src < 0")).count() == 0


def test_unknown_ends_raise(spark):
    with pytest.raises(Exception, match="unknown entity"):
        resolution.retained_edges(edges(spark, [("a", "z", 0.1)]), nodes(spark, "ab")).collect()


def test_pivot_triangle_and_pair(spark):
    tri = edges(spark, [("a", "b", 0.95), ("a", "c", 0.95), ("b", "c", 0.6)])
    once, twice = (clusters(resolution.resolve(nodes(spark, "abc"), tri).collect()) for _ in range(2))
    assert once == twice and sorted(map(len, once)) == [1, 2]
    pair = resolution.resolve(nodes(spark, "ab"), edges(spark, [("a", "b", 0.6)])).collect()
    assert clusters(pair) == [["a"], ["b"]] and {r.clustering_method for r in pair} == {"trivial_objective"}
    assert clusters(resolution.resolve(nodes(spark, "ab"), edges(spark, [("a", "b", 0.8)])).collect()) == [["a", "b"]]
    alone = resolution.resolve(nodes(spark, "a"), edges(spark, [])).collect()
    assert alone[0].clustering_method == "connected_component"


def test_evidence_and_routes(spark):
    m = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "x"), ("d", "y")], "entity_id string, cluster_id string")
    e = edges(spark, [("a", "b", 0.99), ("a", "c", 0.99), ("b", "c", 0.51)])
    got = {r.cluster_id: r for r in resolution.cluster_evidence(m, e).collect()}
    assert got["x"].confidence == pytest.approx(0.638, abs=1e-6) and got["x"].suspicious_merge
    assert (got["x"].quick_low_hitl, got["x"].balanced_hitl) == ("defer", "review")
    assert got["y"].confidence == 0 and got["y"].quick_low_hitl == "keep_separate" and got["y"].density == 1 and not got["y"].suspicious_merge


def test_thresholds():
    resolution.check_thresholds(0.6, 0.8)
    for bad in ((0.6, 0.69), (-0.1, 0.8), (0.6, 1.1)):
        with pytest.raises(ValueError):
            resolution.check_thresholds(*bad)


def test_timing(spark):
    t = spark.createDataFrame([("a", 1, 10.0), ("b", 2, 20.0), ("c", 3, 40.0), ("d", 4, 80.0)], "component_id string, size int, elapsed_ms double")
    r = resolution.timing_summary(t).first()
    assert (r.p50_ms, r.p95_ms, r.max_ms, r.slowest) == (30.0, 74.0, 80.0, "d")


def test_metrics(spark):
    rows = [("1", "A", "x"), ("2", "A", "x"), ("3", "B", "x"), ("4", "B", "y")]
    r = evaluation.cluster_metrics(spark.createDataFrame(rows, "entity_id string, gold_group string, predicted_cluster string")).first()
    want = {"pairwise_precision": 1 / 3, "pairwise_recall": 1 / 2, "pairwise_f1": 0.4, "pairwise_f0_5": 5 / 14, "bcubed_precision": 2 / 3, "bcubed_recall": 3 / 4, "bcubed_f1": 12 / 17, "bcubed_f0_5": 15 / 22}
    for k, v in want.items():
        assert r[k] == pytest.approx(v, abs=1e-6), k
    same = evaluation.cluster_metrics(spark.createDataFrame([(str(i), "A", "x") for i in range(3)], "entity_id string, gold_group string, predicted_cluster string")).first()
    assert same.ari == same.nmi == same.bcubed_f1 == 1
    assert evaluation.cluster_metrics(spark.createDataFrame([], "entity_id string, gold_group string, predicted_cluster string")).first().ari == 0


def test_gold_groups_and_labels(spark):
    e = nodes(spark, "abc")
    g = evaluation.gold_groups(e, spark.createDataFrame([("a", "g1"), ("a", "g1"), ("b", "g1"), ("b", "g2")], "entity_id string, group_id string"))
    assert {r.entity_id: r.gold_group for r in g.collect()} == {"a": "g1", "b": "__ambiguous__:b", "c": "__fp__:c"}


def test_phonetic_needs_two_codes_and_skips_long_lists(spark):
    index = [("A", "1"), ("A", "2"), ("B", "1"), ("B", "2"), ("C", "3"), ("C", "1")]
    got = blocking.shared_code_pairs(spark.createDataFrame(index, "code string, entity_id string"))
    assert [(r.entity_id_a, r.entity_id_b) for r in got.collect()] == [("1", "2")]
    assert blocking.shared_code_pairs(spark.createDataFrame(index, "code string, entity_id string"), most=1).count() == 0


def test_buckets_beyond_the_cap_go_whole(spark):
    e = spark.createDataFrame([(str(i), "PER", "x") for i in range(4)] + [("8", "PER", "y"), ("9", "PER", "y"), ("a", "ORG", "y"), ("b", "PER", ""), ("c", "PER", "")], "entity_id string, type string, normalized string")
    assert {tuple(r) for r in blocking.exact_name_pairs(e, 3).collect()} == {("8", "9")}
    assert blocking.exact_name_pairs(e).count() == 7


def test_neighbours_match_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    v = rng.normal(size=(60, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "id int, v array<float>")
    got = {}
    for r in blocking.nearest_neighbours(df, "id", "v", 5, block=17).collect():
        got.setdefault(r["query"], {})[r["rank"]] = r.neighbour
    sims = np.round(v.astype(np.float32).astype(float) @ v.astype(np.float32).astype(float).T, 6)
    for i in range(60):
        want = sorted((j for j in range(60) if j != i), key=lambda j: (-sims[i, j], j))[:5]
        assert [got[i][k] for k in range(1, 6)] == want


def test_candidates(spark):
    s = "entity_id_a string, entity_id_b string"
    types = spark.createDataFrame([("1", "PER"), ("2", "PER"), ("3", "ORG")], "entity_id string, type string")
    got = blocking.union_candidates({"exact": spark.createDataFrame([("2", "1"), ("1", "1")], s), "faiss": spark.createDataFrame([("1", "2"), ("1", "3")], s)}, types).collect()
    assert [tuple(r) for r in got] == [("1", "2", ["exact", "faiss"], "multi", 2)]


def test_review(spark):
    c = spark.createDataFrame([("a", 3, 0.9, "auto_merge"), ("b", 2, 0.9, "auto_merge"), ("c", 2, 0.6, "defer"), ("d", 1, 0.0, "keep_separate")], "cluster_id string, cluster_size int, confidence double, quick_low_hitl string")
    assert tuple(review.bucket_summary(c, "quick_low_hitl", "auto_merge").first()) == (2, 5, 2.5, 3)
    assert tuple(review.bucket_summary(c, "quick_low_hitl", "review").first()) == (0, 0, 0.0, 0)
    with pytest.raises(ValueError):
        review.in_bucket(c, "nobody", "x")
    s = spark.createDataFrame([([("f", 0.1234), ("g", -2.0)],), ([],), (None,)], "x array<struct<feature:string,value:double>>").select(review.reasons(F.col("x")))
    assert [r[0] for r in s.collect()] == ["f +0.123, g -2.000", "-", "-"]
    m = spark.createDataFrame([("a", "x"), ("b", "x")], "entity_id string, cluster_id string")
    e = spark.createDataFrame([("a", 'q"q'), ("b", "n")], "entity_id string, normalized string")
    dot = review.graphs(m, e, spark.createDataFrame([("a", "b", 0.7)], "a string, b string, score double")).first().dot
    assert '"a" -- "b"' in dot and "dashed" in dot and '\\"' in dot
    label = spark.range(1).select(review.cluster_label(F.lit("N | m"), F.lit("id1"), F.lit(3)).alias("l"))
    assert label.select(review.label_id(F.col("l"))).first()[0] == "id1"


def test_regressions():
    assert evaluation.regression_checks({}) == ["no metrics"]
    assert evaluation.regression_checks({"ari": float("nan")})
    assert not evaluation.regression_checks({"ari": 0.8}, {"ari": 0.84}) and evaluation.regression_checks({"ari": 0.78}, {"ari": 0.84})


def test_gold_offsets(spark):
    text = "Kari met Per. Per met Kari."
    assert evaluation.place_in(text, [(0, 4, "Kari"), (8, 11, "Per"), (12, 15, "Per"), (99, 103, "Kari"), (0, 3, "Ola"), (0, 0, "")]) == [(0, 4), (9, 12), (14, 17), (22, 26), None, None]
    gold = spark.createDataFrame([("m1", "d", 5, 9, "Kari"), ("m2", "x", 0, 3, "Per")], "mention_id string, doc_id string, char_start int, char_end int, text string")
    got = {r.mention_id: (r.char_start, r.char_end) for r in evaluation.realigned(gold, spark.createDataFrame([("d", text), ("other", text)], "doc_id string, text string")).collect()}
    assert got == {"m1": (0, 4), "m2": (None, None)}


def test_documents_by_name_and_positions_in_them(spark):
    docs = spark.createDataFrame([("i1", "a/x.docx"), ("i2", "b/y.docx"), ("i3", "c/y.docx")], "doc_id string, path string")
    gold = lambda *rows: spark.createDataFrame(list(rows), "doc_id string, doc_name string")
    assert sorted(r.doc_id for r in evaluation.with_document_ids(gold(("i2", "?"), ("old", "x.docx")), docs).collect()) == ["i1", "i2"]
    for bad in ("y.docx", "none.docx"):
        with pytest.raises(Exception, match="no single document"):
            evaluation.with_document_ids(gold(("old", bad)), docs).collect()
    e = spark.createDataFrame([("d", "PER", "Per", "e1", [("c1", 5, 8), ("c2", 1, 4), ("c2", 7, 10)])], "doc_id string, type string, text string, entity_id string, positions array<struct<chunk_id:string,char_start:int,char_end:int>>")
    c = spark.createDataFrame([("c1", 0), ("c2", 4)], "chunk_id string, global_start int")
    assert sorted((r.char_start, r.char_end) for r in evaluation.predicted_mentions(e, c).collect()) == [(5, 8), (11, 14)]
