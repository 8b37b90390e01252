"""Pairs of classes against pairs of entities, and the queries made of them on tables of large buckets and of repeated rows."""

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from kinweave.operators import blocking, contracts


def plain(v):
    return None if v is None or isinstance(v, float) and math.isnan(v) else f"{v:.9g}" if isinstance(v, float) else str(v)


def same_as_sql(spark, folder, name, **tables):
    con = duckdb.connect()
    for t, rows in tables.items():
        rows.write.parquet(f"{folder}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    df = __spark_entry__.queries()[name](spark, str(folder))
    cur = con.execute(__spark_entry__.oracle_sql()[name])
    columns = [c[0] for c in cur.description]
    want = sorted(str(tuple(plain(v) for v in r)) for r in cur.fetchall())
    got = sorted(str(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    assert got == want
    return len(got)


def parts(spark, rows):
    return spark.createDataFrame(rows, "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double")


def test_pairs_of_classes(spark):
    rng = random.Random(4)
    rows = [(f"e{i:04d}", rng.choice(["A", "A", "A", "B", None]), rng.choice(["x", "y", "z", "w", "", None]), rng.choice([1, 2, 2, None])) for i in range(900)]
    df = spark.createDataFrame(rows, "entity_id string, type string, name string, size int")
    got = blocking.expand(blocking.class_pairs(df, {"b": (["type", "name"], 90), "a": (["type", "size"], None)}, {"name": "n"}))
    n = {}
    for _, t, x, _ in rows:
        n[t, x] = n.get((t, x), 0) + 1
    want = set()
    for i, t, x, s in rows:
        for j, u, y, z in rows:
            methods = [m for m, on in (("a", t == u and s == z and s is not None), ("b", x == y and t == u and x is not None and 2 <= n[t, x] <= 90)) if on and t is not None]
            if i < j and methods:
                want.add((i, j, x, y, tuple(methods), methods[0] if len(methods) == 1 else "multi", len(methods)))
    assert max(n.values()) > 90 > min(n.values())
    found = [(r.entity_id_a, r.entity_id_b, r.n_a, r.n_b, tuple(r.blocking_methods), r.blocking_source, r.blocking_method_count) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == want


def test_names_of_more_than_500_parts_of_a_run_have_all_their_pairs(spark, tmp_path):
    rows = parts(spark, [(i, "large ring" if i % 9 else "hot bolt", "Brand#1", "SMALL", 20 + i % 12, 1.0) for i in range(700)])
    assert same_as_sql(spark, tmp_path, "pair_names_by_run", part=rows) > 622 * 621 // 2


@pytest.mark.parametrize("name", ["candidate_union", "pair_names_join", "string_features", "feature_diagnostics"])
@pytest.mark.parametrize("again", [0, 1])
def test_candidates_of_large_classes_and_of_repeated_parts(spark, tmp_path, name, again):
    rows = [(i, ["large ring", "hot bolt", "blue ring"][i % 3], f"Brand#{i % 2}", "SMALL", i % 5, 1.0) for i in range(60)]
    many = [(1000 + i, "red nut", "Brand#7", "LARGE", 3, 1.0) for i in range(0 if again else 300)]
    assert same_as_sql(spark, tmp_path, name, part=parts(spark, [*rows, *many, *rows[: 3 * again]]))


def test_candidates_need_no_join_of_pairs(spark):
    for name in ("pair_names_join", "pair_metadata_join", "string_features"):
        plan = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan.split("Generate", 1)[0]  # nothing shuffles once pairs of entities are made


@pytest.mark.parametrize("hashes", [1 << 20, 0])
def test_repeated_keys(spark, monkeypatch, hashes):
    monkeypatch.setattr(contracts, "HASHES", hashes)
    monkeypatch.setattr(contracts, "HASH_TASKS", 4)
    df = spark.createDataFrame([("r", 1, 2), ("r", 1, 2), ("r", 1, 3), ("s", 1, 2), ("s", None, 2), ("s", None, 2)], "run_id string, a int, b int")
    got = contracts.repeated(df, ["run_id", "a", "b"], "twice")
    want = df.withColumn("ok", contracts.unique("run_id", "a", "b")).where("not ok").select("run_id", F.col("a").cast("string"), F.col("b").cast("string"), F.lit("twice"))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, want.collect())))
