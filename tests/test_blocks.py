"""Products of blocks, forests, streamed clusters: against brute force, and without shuffles or gathering of what grows with the pairs."""

import contextlib
import io
import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinweave.operators import blocking, evaluation, graph, resolution, review
from kinweave.plans import inputs


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


@pytest.fixture(scope="module")
def vectors():
    x = np.random.default_rng(3).normal(size=(90, 5))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return [(f"n{i:02d}", row, f"g{i % 4}") for i, row in enumerate(x.astype(np.float32).astype(float).tolist())]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id string, v array<float>, g string")


@pytest.mark.parametrize("block", [11, 4096])
def test_similar_vectors(spark, vectors, block):
    rows = [*vectors, vectors[7], ("none", None, "g0"), ("torn", [1.0, None, 0.0, 0.0, 0.0], "g0"), ("short", [1.0], "g1")]
    got = blocking.similar_vectors(frame(spark, rows), "id", "v", 0.6, block=block, more=("g",)).collect()
    want = {(a, b, round(float(np.dot(x, y)), 6), g, h) for (a, x, g), (b, y, h) in combinations(vectors, 2) if round(float(np.dot(x, y)), 6) >= 0.6}
    assert len(want) > 100 and sorted((r.a, r.b, round(r.score, 6), r.g_a, r.g_b) for r in got) == sorted(want)


def test_nearest_neighbours_of_ties_and_missing_vectors(spark, vectors):
    rows = [*vectors, *((f"m{i}", vectors[i][1], "g0") for i in range(5)), ("none", None, "g0")]
    real = [r for r in rows if r[1]]
    for r in blocking.nearest_neighbours(frame(spark, rows), "id", "v", 4, block=9).groupBy("query").agg(F.sort_array(F.collect_list(F.struct("rank", "neighbour"))).alias("n")).collect():
        own = next(x for i, x, _ in real if i == r["query"])
        want = sorted((-round(float(np.dot(own, x)), 6), i) for i, x, _ in real if i != r["query"])[:4]
        assert [x.neighbour for x in r.n] == [i for _, i in want]


def test_group_cosines(spark, vectors):
    rows = [*vectors, ("none", None, "g0"), ("short", [1.0], "g1"), ("alone", [1.0] * 5, None)]
    got = {(r.a, r.b): r.cosine for r in blocking.group_cosines(frame(spark, rows), "id", "v", "g", block=7).collect()}
    want = {(min(a, b), max(a, b)): None if x is None or y is None or len(x) != len(y) else round(max(-1.0, min(1.0, float(np.dot(x, y)))), 5) for (a, x, g), (b, y, h) in combinations(rows, 2) if g == h and g}
    assert got.keys() == want.keys()
    assert all(got[k] is want[k] or abs(got[k] - want[k]) < 1e-9 for k in want)


def test_forest_connects_what_the_edges_do_with_fewer_rows_than_nodes(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(100) + 1000 * c, rng.randrange(100) + 1000 * c) for c in range(3) for _ in range(2000)]
    df = spark.createDataFrame(edges, "u bigint, v bigint").coalesce(1)
    assert graph.forest(df).count() <= 297
    for kind in ("bigint", "string"):
        typed = df.select(F.col("u").cast(kind).alias("u"), F.col("v").cast(kind).alias("v"))
        found = graph.connected_components(typed, "u", "v").groupBy("component").agg(F.count("*").alias("n"), F.min("node").alias("least")).collect()
        assert [r.n for r in found] == [100, 100, 100] and all(r.component == r.least for r in found)


def test_forest_of_edges_that_come_in_several_rounds(spark, monkeypatch):
    monkeypatch.setattr(graph, "TOGETHER", 50)
    df = spark.range(3000).select(F.col("id").alias("u"), ((F.col("id") * 7 + 1) % 3000).alias("v")).where("u <> v").coalesce(1)
    want = {(r.node, r.component) for r in graph.connected_components(df.select("u", F.col("v").cast("decimal(20,0)").cast("bigint").alias("v")), "u", "v").collect()}
    adjacent: dict = {}
    for u in range(3000):
        v = (u * 7 + 1) % 3000
        adjacent.setdefault(u, set()).add(v)
        adjacent.setdefault(v, set()).add(u)
    got, seen = set(), set()
    for n in range(3000):
        if n in seen:
            continue
        seen.add(n)
        todo, own = [n], []
        while todo:
            x = todo.pop()
            own.append(x)
            for y in adjacent[x] - seen:
                seen.add(y)
                todo.append(y)
        got |= {(x, n) for x in own if len(own) > 1}
    assert want == got


def test_pivot_clusters_equal_the_pivot_of_each_component_and_gather_no_component(spark):
    rng = random.Random(1)
    edges = {(f"{c}{i:02d}", f"{c}{j:02d}"): rng.choice([0.3, 0.7, 0.85, 0.9, 0.95, 1.0]) for c in "xy" for i, j in combinations(range(25), 2) if rng.random() < 0.3}
    ids = [f"{c}{i:02d}" for c in "xy" for i in range(25)]
    e = spark.createDataFrame([(b, a, w) if rng.random() < 0.5 else (a, b, w) for (a, b), w in edges.items() for _ in range(2)], "a string, b string, score double")
    comps = resolution.components(spark.createDataFrame([(i,) for i in ids], "entity_id string"), e)
    out = resolution.pivot_clusters(comps, e)
    assert "FlatMapGroups" not in plan(out)
    got, want = {}, set()
    for r in out.collect():
        got.setdefault((r.component_id, r.cluster_key), set()).add(r.entity_id)
    of = {r.entity_id: r.component_id for r in comps.collect()}
    for c in set(of.values()):
        own = sorted(i for i in ids if of[i] == c)
        weights = {k: 0.0 if abs(w - 0.8) <= 1e-6 else w - 0.8 for k, w in sorted(edges.items()) if k[0] in own}
        want |= {frozenset(x) for x in resolution.pivot(own, weights, c)[0]}
    assert {frozenset(x) for x in got.values()} == want


def test_graphs_gather_no_lines(spark):
    m = spark.createDataFrame([(i, "c" if i < 4 else "d") for i in range(5)], "entity_id int, cluster_id string")
    e = spark.createDataFrame([(0, 1, 0.9), (1, 2, 0.7), (2, 3, 0.8), (3, 4, 0.1)], "a int, b int, score double")
    out = review.graphs(m, m.select("entity_id", F.concat(F.lit('say "'), F.col("entity_id").cast("string")).alias("normalized")), e)
    assert "collect_list" not in plan(out)
    nodes = [f'  "{i}" [label="say \\"{i}"];' for i in range(5)]
    links = ['  "0" -- "1" [label="0.90"];', '  "1" -- "2" [label="0.70", color="red", style="dashed"];', '  "2" -- "3" [label="0.80"];']
    assert {r.cluster_id: r.dot for r in out.collect()} == {"c": "\n".join(["graph cluster {", *nodes[:4], *links, "}"]), "d": "\n".join(["graph cluster {", nodes[4], "}"])}


def test_evidence_of_placed_edges_joins_no_edge(spark):
    d = "/root/testdata/sf0.001"
    m = inputs.membership(spark, d).persist()
    e = inputs.placed_edges(spark, d, m).where("a < b")
    inside = review.within_pairs(m, e)
    assert plan(inside).split("MapInArrow", 1)[0].count("Join") == 0  # above the products
    plain = review.within_pairs(m, inputs.edges(spark, d))
    assert sorted(inside.collect()) == sorted(plain.collect()) and inside.count()
    key = lambda r: r.cluster_id
    assert sorted(resolution.cluster_evidence(m, e).drop("avg_edge_score", "confidence").collect(), key=key) == sorted(resolution.cluster_evidence(m, inputs.edges(spark, d)).drop("avg_edge_score", "confidence").collect(), key=key)


@pytest.mark.parametrize("more", [[], [("n00", "g1")]])
def test_group_recall_counts_pairs_from_sizes(spark, vectors, more):
    m = spark.createDataFrame([(i, g) for i, _, g in vectors] + more, "entity_id string, g string")
    c = blocking.similar_vectors(frame(spark, vectors), "id", "v", 0.6, more=("g",))
    got = evaluation.group_recall(m, "g", c)
    want = evaluation.blocking_recall(evaluation.positive_pairs(m, "g"), c)
    assert got.columns == want.columns and got.collect() == want.collect()
