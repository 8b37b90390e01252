"""Pairs that are made where their ends meet: names, gold labels, training pairs; mentions placed without a frame for each document."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from kinweave.operators import blocking, evaluation, synthetic


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("again", [False, True])
def test_pairs_of_names_that_many_entities_have(spark, monkeypatch, again):
    monkeypatch.setattr(blocking, "NAME_IDS", 16)
    names = ["large ring"] * 70 + ["large rings"] * 40 + ["hot bolt"] * 5 + ["", None]
    rows = [(f"e{i:03d}", n) for i, n in enumerate(names)]
    df = spark.createDataFrame(rows + (rows[:2] if again else []), "entity_id string, normalized string")
    got = blocking.jaccard_pairs(df, 0.5).distinct().collect()
    near = {("large ring", "large rings"), ("large rings", "large ring"), *((n, n) for n in names if n)}
    assert {(r.entity_id_a, r.entity_id_b) for r in got} == {(a, b) for (a, x), (b, y) in combinations(rows, 2) if (x, y) in near}
    found = blocking.minhash_pairs(df)
    assert found.count() == found.distinct().count() == len(got)  # each pair once; here as many as are near
    if not again:
        assert "Exchange" not in plan(found).split("Generate", 1)[0]


def test_labels_within(spark):
    rng = random.Random(2)
    e = spark.createDataFrame([(i, rng.choice("xyz"), rng.choice([1, 2, None])) for i in range(120)], "entity_id int, s string, n int")
    groups = spark.createDataFrame([(i, rng.choice(["g", "h", f"{evaluation.NO_GROUP}{i}", f"{evaluation.MANY_GROUPS}{i}"])) for i in range(110)], "entity_id int, gold_group string")
    b = e.toDF("entity_id_b", "s", "n")
    pairs = e.toDF("entity_id_a", "s", "n").join(b, ["s", "n"]).where("entity_id_a < entity_id_b").select("entity_id_a", "entity_id_b")
    got, want = evaluation.labels_within(e, ["s", "n"], groups), evaluation.labels_from_gold(pairs, groups)
    assert got.columns == want.columns and sorted(got.collect()) == sorted(want.collect()) and want.count() > 50
    assert plan(got).count("Join") < plan(want).count("Join")


@pytest.mark.parametrize("again", [False, True])
def test_training_pairs_are_the_first_by_hash(spark, monkeypatch, again):
    monkeypatch.setattr(synthetic, "BLOCK", 7)
    rows = [("PER" if i % 3 else "ORG", f"e{i:03d}", f"{'p' if i % 3 else 'o'}{i % 10}") for i in range(150)]
    df = spark.createDataFrame(rows + (rows[:4] if again else []), "type string, entity_id string, group_id string")
    out = synthetic.training_pairs(df, most=90, rate=0.2)
    assert "Window" not in plan(out)
    a, b = (df.toDF("type", f"entity_id_{s}", f"g{s}") for s in "ab")
    every = a.join(b, "type").where("entity_id_a < entity_id_b").withColumn("label", (F.col("ga") == F.col("gb")).cast("int")).withColumn("h", F.xxhash64("entity_id_a", "entity_id_b", F.lit(synthetic.SEED)))
    want = sorted((r.h, r.entity_id_a, r.entity_id_b, r.label) for r in every.collect())
    one, none = [x[1:] for x in want if x[3] == 1][:18], [x[1:] for x in want if x[3] == 0][:72]
    assert sorted(map(tuple, out.collect())) == sorted(one + none)


def test_realigned_makes_no_frame_for_each_document(spark):
    gold = spark.createDataFrame([("d", "m1", 4, 7, "two"), ("d", "m2", 0, 3, "two"), ("e", "m3", 0, 3, "one"), (None, "m4", 0, 3, "one"), ("f", "m5", 2, 5, None)], "doc_id string, mention_id string, char_start int, char_end int, text string")
    out = evaluation.realigned(gold, spark.createDataFrame([("d", "two one two"), ("f", "abc"), ("g", "one")], "doc_id string, text string"))
    assert "CoGroups" not in plan(out) and out.schema == gold.schema
    assert {r.mention_id: (r.doc_id, r.char_start, r.char_end, r.text) for r in out.collect()} == {"m2": ("d", 0, 3, "two"), "m1": ("d", 8, 11, "two"), "m3": ("e", None, None, "one"), "m4": (None, None, None, "one"), "m5": ("f", None, None, None)}
