"""Training pairs from identity groups: entities, positives, sampled negatives, vectors, checks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from ..functions.names import hash_id
from .contracts import TYPES, missing_references

MOST, POSITIVE_RATE, SEED, DIM = 2500, 0.15, 7, 768
#: Members of a group that stand in a row, and tasks that make pairs.
BLOCK, TASKS = 2048, 256
GROUPS = "group_id string, entity_type string, doc_ids array<string>, variants array<struct<text:string,normalized:string,context:string>>"


def check_groups(groups: list[dict], hard_negatives: list[dict] = ()) -> None:
    """Raise on groups without variants, of unknown type, named twice, or hard negatives that name no two groups."""
    names = [g["group_id"] for g in groups]
    if not names or len(set(names)) < len(names):
        raise ValueError("groups must be there and named once each")
    for g in groups:
        if g["entity_type"] not in TYPES or not g["doc_ids"] or not g["variants"]:
            raise ValueError(f"group {g['group_id']} needs a known type, documents and variants")
        if any(not v.get("text") or not v.get("normalized") for v in g["variants"]):
            raise ValueError(f"group {g['group_id']} has an empty variant")
    for h in hard_negatives:
        if h["group_id_a"] == h["group_id_b"] or not {h["group_id_a"], h["group_id_b"]} <= set(names):
            raise ValueError("a hard negative must name two groups")


def group_entities(groups: DataFrame, run_id: str) -> DataFrame:
    """Entities of groups (columns GROUPS): one for each variant, the group's documents dealt out in turn."""
    rows = groups.select("group_id", F.col("entity_type").alias("type"), "doc_ids", F.posexplode("variants").alias("i", "v"))
    doc = F.element_at("doc_ids", (F.col("i") % F.size("doc_ids") + 1).cast("int"))
    return rows.select(F.lit(run_id).alias("run_id"), hash_id("group_id", F.col("i").cast("string"), "v.text").alias("entity_id"), doc.alias("doc_id"), "type", "v.text", "v.normalized", "v.context", "group_id", "i")


def training_pairs(entities: DataFrame, hard_negatives: DataFrame | None = None, most: int = MOST, rate: float = POSITIVE_RATE, seed: int = SEED) -> DataFrame:
    """entity_id_a, entity_id_b, label of pairs of one type: positives by a seeded hash, then negatives to a share of ``rate``
    positives, those of hard pairs of groups (group_id_a, group_id_b) first, ``most`` in all."""
    x = entities.select("type", "entity_id", "group_id")
    h = None
    if hard_negatives is not None:
        h = hard_negatives.select(F.least("group_id_a", "group_id_b").alias("lo"), F.greatest("group_id_a", "group_id_b").alias("hi")).distinct()
    of = x.groupBy("type", "group_id").agg(F.count(F.lit(1)).alias("n"))
    twice = not x.groupBy("type", "group_id", "entity_id").count().where("count > 1").isEmpty()
    # Each group beside each of its type, and blocks of their members by the hash of the ids: no type's members meet in one task.
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    members = x.join(of, ["type", "group_id"]).groupBy("type", "group_id", F.pmod(F.xxhash64("entity_id"), blocks).alias("i")).agg(F.collect_list("entity_id").alias("ids"))
    a = members.select("type", F.col("group_id").alias("ga"), F.col("ids").alias("ids_a"))
    b = members.select("type", F.col("group_id").alias("gb"), F.col("ids").alias("ids_b"))
    met = a.join(b, "type").withColumn("label", (F.col("ga") == F.col("gb")).cast("tinyint"))
    if h is not None:
        met = met.withColumns({"lo": F.least("ga", "gb"), "hi": F.greatest("ga", "gb")}).join(h.withColumn("is_hard", F.lit(True)), ["lo", "hi"], "left").withColumn("hard", F.coalesce("is_hard", F.lit(False)))
    else:
        met = met.withColumn("hard", F.lit(False))
    met = met.select("ids_a", "ids_b", "label", "hard").repartition(TASKS, F.xxhash64("ids_a", "ids_b"))
    pairs = met.select("*", F.explode("ids_a").alias("entity_id_a")).select("*", F.explode("ids_b").alias("entity_id_b")).where("entity_id_a < entity_id_b").select("entity_id_a", "entity_id_b", "label", "hard")
    order = [F.desc("hard"), F.xxhash64("entity_id_a", "entity_id_b", F.lit(seed)), "entity_id_a", "entity_id_b"]
    if twice:
        n, every = pairs.agg(F.coalesce(F.sum("label"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("every")).first()
    else:
        n, every = of.groupBy("type").agg(F.expr("sum(n * (n - 1) div 2)").alias("n"), F.sum("n").alias("t")).agg(F.expr("coalesce(sum(n), 0)"), F.expr("coalesce(sum(t * (t - 1) div 2), 0)")).first()
    positives = min(int(n), int(most * rate))
    negatives = min(most - positives, round(positives * (1 - rate) / rate))

    def first(label: int, k: int, among: int) -> DataFrame:
        """The first k of a label's pairs; only those of the smallest hashes are put in order, where these are k at least."""
        own = pairs.where(F.col("label") == label)
        share = (2 * k + 100) / max(among, 1)
        if h is None and share < 0.5:
            low = own.where(F.xxhash64("entity_id_a", "entity_id_b", F.lit(seed)) <= F.lit(-(1 << 63) + int(share * (1 << 64))))
            if low.limit(k).count() >= k:
                own = low
        return own.orderBy(*order).limit(k)

    return first(1, positives, int(n)).unionByName(first(0, negatives, int(every) - int(n))).select("entity_id_a", "entity_id_b", "label")


def group_vectors(entities: DataFrame, dim: int = DIM, noise: float = 0.35, seed: int = SEED) -> DataFrame:
    """entity_id, embedding, context_embedding: a unit vector near that of the entity's group, from seeded hashes alone."""

    @F.pandas_udf(ArrayType(FloatType()))
    def vector(group: pd.Series, own: pd.Series) -> pd.Series:
        out = []
        for g, o in zip(group, own):
            v = np.random.default_rng(g & ((1 << 63) - 1)).normal(size=dim) + noise * np.random.default_rng(o & ((1 << 63) - 1)).normal(size=dim)
            out.append((v / np.linalg.norm(v)).astype(np.float32))
        return pd.Series(out)

    of = lambda salt: vector(F.xxhash64("group_id", F.lit(seed)), F.xxhash64("entity_id", F.lit(seed + salt)))
    return entities.select("entity_id", of(1).alias("embedding"), of(2).alias("context_embedding"))


def check_pairs(entities: DataFrame, pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """rule, n: pairs of unknown entities, labels without pairs, pairs without labels."""
    keys = ["entity_id_a", "entity_id_b"]
    ends = pairs.select(F.explode(F.array(*keys)).alias("entity_id"))
    found = missing_references(ends, "entity_id", entities, "entity_id").select(F.lit("unknown entity").alias("rule"))
    for a, b, rule in ((labels, pairs, "label without pair"), (pairs, labels, "pair without label")):
        found = found.unionByName(a.select(keys).join(b.select(keys), keys, "left_anti").select(F.lit(rule).alias("rule")))
    return found.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def label_distribution(labels: DataFrame) -> DataFrame:
    return labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def quotas(groups: DataFrame, wanted: dict[str, int]) -> DataFrame:
    """entity_type, wanted, n of the types whose number of groups isn't the wanted one."""
    plan = groups.sparkSession.createDataFrame(list(wanted.items()), "entity_type string, wanted int")
    n = groups.groupBy("entity_type").agg(F.count(F.lit(1)).alias("n"))
    return plan.join(n, "entity_type", "full_outer").select("entity_type", F.coalesce("wanted", F.lit(0)).alias("wanted"), F.coalesce("n", F.lit(0)).alias("n")).where("wanted <> n")
