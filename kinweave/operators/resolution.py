"""From scored pairs to canonical entities: retained graph, correlation clustering, evidence, routing, canonical names."""

from __future__ import annotations

import hashlib
import random
import time
from bisect import bisect_left
from collections.abc import Iterator
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import connected_components

KEEP, NEUTRAL, LEAST_GAP, SNAP = 0.60, 0.80, 0.10, 1e-6
RUNS, PATIENCE, GAIN = 40, 5, 1e-6
GIANT_SIZE, GIANT_SHARE = 25, 0.15
AUTO_MERGE, REVIEW = 0.85, 0.50
PROFILES = dict(balanced_hitl="review", quick_low_hitl="defer")


def check_thresholds(keep: float, neutral: float) -> None:
    """Raise unless 0 <= keep, neutral <= 1 and neutral is at least LEAST_GAP above keep."""
    if not (0 <= keep <= 1 and 0 <= neutral <= 1):
        raise ValueError("thresholds lie between 0 and 1")
    if neutral - keep < LEAST_GAP - 1e-9:
        raise ValueError(f"neutral must be at least {LEAST_GAP} above keep")


def set_hash(members: Column) -> Column:
    return F.substring(F.sha2(F.array_join(F.array_sort(members), "|"), 256), 1, 32)


def set_hashes(rows: DataFrame) -> DataFrame:
    """root, component_id, component_size: as ``set_hash`` of each root's members (columns root, member), which stream by in order, so
    that a set may be of any size."""
    kind = rows.schema["root"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, current, digest, n = None, None, None, 0
        for batch in batches:
            done = []
            schema = pa.schema([("root", batch.schema.field(0).type), ("component_id", pa.string()), ("component_size", pa.int32())])
            for root, member in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if root != current or digest is None:
                    if digest is not None:
                        done.append((current, digest.hexdigest()[:32], n))
                    current, digest, n = root, hashlib.sha256(member.encode()), 1
                else:
                    digest.update(b"|" + member.encode())
                    n += 1
            yield pa.RecordBatch.from_pydict(dict(zip(schema.names, zip(*done))) if done else {k: [] for k in schema.names}, schema)
        if digest is not None:
            yield pa.RecordBatch.from_pydict({"root": [current], "component_id": [digest.hexdigest()[:32]], "component_size": [n]}, schema)

    return rows.repartition("root").sortWithinPartitions("root", "member").mapInArrow(run, f"root {kind}, component_id string, component_size int")


def retained_edges(scored: DataFrame, nodes: DataFrame | None = None, keep: float = KEEP) -> DataFrame:
    """Scored pairs (a, b, score) from ``keep`` on. With nodes (entity_id), an end that isn't one raises when the plan runs,
    whatever the pair's score."""
    strong = F.col("score") >= F.lit(keep).cast(scored.schema["score"].dataType)
    if nodes is not None:
        known = nodes.select(F.col("entity_id"), F.lit(True).alias("known"))
        for s in "ab":
            scored = scored.join(known.toDF(s, f"known_{s}"), s, "left")
        fine = F.col("known_a").isNotNull() & F.col("known_b").isNotNull()
        # One condition, so that no weak pair is dropped before its ends are looked at.
        strong = F.when(fine, strong).otherwise(F.raise_error(F.concat(F.lit("unknown entity in "), F.col("a"), F.lit(", "), F.col("b"))).cast("boolean"))
    return scored.where(strong).select("a", "b", "score")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """entity_id, component_id, component_size: every node, isolated ones too; the id is a hash of the sorted members."""
    joined = connected_components(edges, "a", "b")
    labelled = nodes.select("entity_id").join(joined.withColumnRenamed("node", "entity_id"), "entity_id", "left").withColumn("root", F.coalesce("component", "entity_id"))
    sets = set_hashes(labelled.select("root", F.col("entity_id").cast("string").alias("member")))
    return labelled.join(sets, "root").select("entity_id", "component_id", "component_size")


def objective_weight(score: Column, neutral: float = NEUTRAL) -> Column:
    """score - neutral, 0 within SNAP of it."""
    w = score.cast("double") - F.lit(neutral)
    return F.when(F.abs(w) <= SNAP, F.lit(0.0)).otherwise(w)


def placed(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """edges with cluster_a and cluster_b, the clusters (entity_id, cluster_id) of their ends; as they are if they have both already,
    as ``blocking.similar_vectors`` can make them: then no edge shuffles."""
    if {"cluster_a", "cluster_b"} <= set(edges.columns):
        return edges
    for s in "ab":
        edges = edges.join(membership.select(F.col("entity_id").alias(s), F.col("cluster_id").alias(f"cluster_{s}")), s)
    return edges


def correlation_objective(edges: DataFrame, membership: DataFrame, neutral: float = NEUTRAL) -> DataFrame:
    """objective: the weights of edges within clusters less those across. membership: entity_id, cluster_id."""
    signed = F.when(F.col("cluster_a") == F.col("cluster_b"), F.col("w")).otherwise(-F.col("w"))
    return placed(edges, membership).withColumn("w", objective_weight(F.col("score"), neutral)).agg(F.coalesce(F.sum(signed), F.lit(0.0)).alias("objective"))


def trivial_clusters(comps: DataFrame, edges: DataFrame, neutral: float = NEUTRAL) -> DataFrame:
    """entity_id, cluster_key, clustering_method of components of one or two nodes, all in SQL.

    A single node is its own cluster; a pair is merged if its weight isn't negative.
    """
    small = comps.where("component_size <= 2")
    weight = edges.select(F.explode(F.array("a", "b")).alias("entity_id"), objective_weight(F.col("score"), neutral).alias("w"))
    placed = small.join(weight, "entity_id", "left")
    key = F.when((F.col("component_size") == 2) & (F.col("w") >= 0), F.col("component_id")).otherwise(set_hash(F.array(F.col("entity_id").cast("string"))))
    return placed.select("entity_id", "component_id", key.alias("cluster_key"), F.when(F.col("component_size") == 1, "connected_component").otherwise("trivial_objective").alias("clustering_method"))


def _pivot(n: int, u: np.ndarray, v: np.ndarray, w: np.ndarray, seed: int, cap: int, patience: int) -> tuple[list[list[int]], float, int]:
    """``pivot`` of nodes 0 to n - 1, in order, with edges (u, v) of weight w, each once: a few numbers for each edge."""
    on = w > 0
    src, near = np.concatenate([u[on], v[on]]), np.concatenate([v[on], u[on]])
    order = np.argsort(src, kind="stable")
    near, first = near[order], np.searchsorted(src[order], np.arange(n + 1))
    best, best_score, stale, done = None, float("-inf"), 0, 0
    for run in range(min(cap, 2 + ceil(sqrt(len(w))))):
        draw = random.Random(seed + run)
        left, place, clusters = list(range(n)), np.full(n, -1, np.int32), []
        while left:
            centre = left[draw.randrange(len(left))] if run else left[0]
            place[centre] = len(clusters)
            own = near[first[centre] : first[centre + 1]]
            own = own[place[own] < 0]
            place[own] = len(clusters)
            clusters.append(sorted([centre, *own.tolist()]))
            for x in clusters[-1]:
                del left[bisect_left(left, x)]
        clusters.sort()
        score = float(np.where(place[u] == place[v], w, -w).sum())
        done += 1
        if best is None or score > best_score + GAIN or (abs(score - best_score) <= GAIN and clusters < best):
            best, best_score, stale = clusters, score, 0
        else:
            stale += 1
            if stale >= patience:
                break
    return best or [], best_score, done


def pivot(ids: list[str], weights: dict[tuple[str, str], float], component_id: str, cap: int = RUNS, patience: int = PATIENCE, base_seed: int = 0) -> tuple[list[list[str]], float, int]:
    """Best clustering of one component over several pivot orders: the sorted order first, then seeded random ones."""
    names = sorted(ids)
    place = {x: i for i, x in enumerate(names)}
    ends = np.array([[place[x] for x in pair] for pair in weights], np.int64).reshape(-1, 2)
    found, score, done = _pivot(len(names), ends[:, 0], ends[:, 1], np.array(list(weights.values()), float), int(component_id[:16], 16) ^ base_seed, cap, patience)
    return [[names[i] for i in c] for c in found], score, done


def _key(members: list[str]) -> str:
    return hashlib.sha256("|".join(sorted(members)).encode()).hexdigest()[:32]


DIAGNOSTICS = "objective double, runs int, early_stopped boolean, elapsed_ms double"


def pivot_clusters(comps: DataFrame, edges: DataFrame, neutral: float = NEUTRAL, base_seed: int = 0, diagnostics: bool = False) -> DataFrame:
    """As ``trivial_clusters`` for components of more than two nodes. With ``diagnostics``, each row also tells its component's
    objective, pivot runs, whether they ended early, and the time they took.

    A component's nodes and then its edges stream by in order, and are held as numbers: 16 bytes for each edge.
    """
    text = lambda c: F.col(c).cast("string")
    large = comps.where("component_size > 2").select(text("entity_id").alias("a"), "component_id")
    weighted = edges.select(text("a").alias("a"), text("b").alias("b"), objective_weight(F.col("score"), neutral).alias("w"))
    inside = weighted.join(large, "a").select("component_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w")
    alone = large.select("component_id", "a", F.lit(None).cast("string").alias("b"), F.lit(None).cast("double").alias("w"))
    schema = "entity_id string, component_id string, cluster_key string, clustering_method string" + (f", {DIAGNOSTICS}" if diagnostics else "")
    kinds = {"string": pa.string(), "double": pa.float64(), "int": pa.int32(), "boolean": pa.bool_()}
    arrow = pa.schema([(n, kinds[t]) for n, t in (f.split() for f in schema.split(", "))])

    def solve(component: str, ids: list[str], parts: list) -> Iterator[pa.RecordBatch]:
        u, v, w = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0))
        parts.clear()
        if len(u):  # of an edge that is there more than once the last one counts
            last = np.append((u[1:] != u[:-1]) | (v[1:] != v[:-1]), True)
            u, v, w = u[last], v[last], w[last]
        began = time.perf_counter()
        found, objective, runs = _pivot(len(ids), u, v, w, int(component[:16], 16) ^ base_seed, RUNS, PATIENCE)
        told = (objective, runs, runs < min(RUNS, 2 + ceil(sqrt(len(w)))), (time.perf_counter() - began) * 1000) if diagnostics else ()
        rows = [(x, component, key, "pivot_correlation", *told) for own in ([ids[i] for i in c] for c in found) for key in (_key(own),) for x in own]
        for at in range(0, len(rows), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 10_000]), arrow.types)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, ids, place, parts = None, [], {}, []
        for batch in batches:
            components = batch.column(0).dictionary_encode()
            codes, names = components.indices.to_numpy(), components.dictionary.to_pylist()
            edge = batch.column(2).is_valid().to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.diff(codes)) + 1
            for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(codes)]):
                if low == high:
                    continue
                if names[codes[low]] != current:
                    if ids:
                        yield from solve(current, ids, parts)
                    current, ids, place, parts = names[codes[low]], [], {}, []
                middle = low + int((~edge[low:high]).sum())  # a component's nodes come first
                ids += batch.column(1).slice(low, middle - low).to_pylist()
                if middle < high:
                    place = place or {x: i for i, x in enumerate(ids)}
                    ends = [np.fromiter(map(place.__getitem__, batch.column(c).slice(middle, high - middle).to_pylist()), np.int32, high - middle) for c in (1, 2)]
                    parts.append((*ends, batch.column(3).slice(middle, high - middle).to_numpy(zero_copy_only=False)))
        if ids:
            yield from solve(current, ids, parts)

    rows = inside.unionByName(alone).repartition("component_id").sortWithinPartitions("component_id", F.col("b").isNotNull(), "a", "b", "w")
    kind = comps.schema["entity_id"].dataType.simpleString()
    return rows.mapInArrow(run, schema).withColumn("entity_id", F.col("entity_id").cast(kind))


def resolve(nodes: DataFrame, edges: DataFrame, neutral: float = NEUTRAL, diagnostics: bool = False) -> DataFrame:
    """entity_id, component_id, cluster_id, clustering_method of all nodes. Only components of three and more leave SQL."""
    comps = components(nodes, edges).checkpoint()
    every = trivial_clusters(comps, edges, neutral).unionByName(pivot_clusters(comps, edges, neutral, diagnostics=diagnostics), allowMissingColumns=True)
    return every.withColumnRenamed("cluster_key", "cluster_id")


def component_summaries(solved: DataFrame, edges: DataFrame, neutral: float = NEUTRAL) -> DataFrame:
    """component_id, size, n_edges, n_clusters, is_trivial, clustering_method, objective, runs, early_stopped, elapsed_ms of each
    component; solved is what ``resolve`` gives with ``diagnostics``. A trivial component took no runs and no time."""
    place = solved.select("entity_id", "component_id", "cluster_id")
    a, b = (place.select(F.col("entity_id").alias(s), F.col("component_id").alias(f"c{s}"), F.col("cluster_id").alias(f"k{s}")) for s in "ab")
    w = objective_weight(F.col("score"), neutral)
    inside = edges.join(a, "a").join(b, "b").groupBy(F.col("ca").alias("component_id")).agg(F.count(F.lit(1)).alias("n_edges"), F.sum(F.when(F.col("ka") == F.col("kb"), w).otherwise(-w)).alias("w"))
    rows = solved.groupBy("component_id").agg(F.count(F.lit(1)).alias("size"), F.count_distinct("cluster_id").alias("n_clusters"), F.min("clustering_method").alias("clustering_method"), *[F.max(c).alias(c) for c in ("runs", "early_stopped", "elapsed_ms")])
    zero = lambda c, v: F.coalesce(F.col(c), F.lit(v)).alias(c)
    return rows.join(inside, "component_id", "left").select(
        "component_id", "size", zero("n_edges", 0), "n_clusters", (F.col("clustering_method") != "pivot_correlation").alias("is_trivial"), "clustering_method", F.round(F.coalesce("w", F.lit(0.0)), 6).alias("objective"),
        zero("runs", 0), zero("early_stopped", False), F.round(zero("elapsed_ms", 0.0), 3).alias("elapsed_ms"),
    )


def route(confidence: Column, size: Column, profile: str = "quick_low_hitl") -> Column:
    """auto_merge above AUTO_MERGE, the profile's middle way from REVIEW on, else keep_separate; single nodes stay separate."""
    if profile not in PROFILES:
        raise ValueError(f"unknown profile {profile}")
    return F.when((size > 1) & (confidence > AUTO_MERGE), "auto_merge").when((size > 1) & (confidence >= REVIEW), PROFILES[profile]).otherwise("keep_separate")


def cluster_evidence(membership: DataFrame, edges: DataFrame, neutral: float = NEUTRAL) -> DataFrame:
    """One row for each cluster: size, edges present and possible, density, least and mean score, confidence, suspicion, routes.

    confidence is (0.6 min + 0.4 avg) times the share of possible edges that are there, between 0 and 1; 0 for a single node.
    """
    inside = placed(edges, membership).where("cluster_a = cluster_b").groupBy(F.col("cluster_a").alias("cluster_id")).agg(F.count(F.lit(1)).alias("n_edges"), F.min(F.col("score").cast("double")).alias("min_edge_score"), F.avg(F.col("score").cast("double")).alias("avg_edge_score"))
    sizes = membership.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("cluster_size"))
    n = F.col("cluster_size")
    possible = (n * (n - 1) / 2).cast("bigint")
    rows = sizes.join(inside, "cluster_id", "left").withColumns({"n_edges": F.coalesce("n_edges", F.lit(0)), "min_edge_score": F.coalesce("min_edge_score", F.lit(0.0)), "avg_edge_score": F.coalesce("avg_edge_score", F.lit(0.0)), "possible_edges": possible})
    rows = rows.withColumn("density", F.when(n == 1, 1.0).otherwise(F.col("n_edges") / F.col("possible_edges")))
    strength = (0.6 * F.col("min_edge_score") + 0.4 * F.col("avg_edge_score")) * F.col("density")
    rows = rows.withColumn("confidence", F.when(n == 1, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), strength))))
    rows = rows.withColumn("suspicious_merge", (n > 1) & ((F.col("min_edge_score") < neutral) | (F.col("density") < 1)))
    # Routed by the value that is stored (six digits, float), so that the stored row agrees with its route.
    stored = F.round("confidence", 6).cast("float").cast("double")
    routed = rows.withColumns({p: route(stored, n, p) for p in PROFILES})
    return routed.withColumns({c: F.round(c, 6) for c in ("density", "min_edge_score", "avg_edge_score", "confidence")})


def missed_merges(membership: DataFrame, edges: DataFrame, neutral: float = NEUTRAL, limit: int = 10) -> DataFrame:
    """Edges of positive weight between clusters, the strongest ``limit`` of them."""
    a, b = membership.select(F.col("entity_id").alias("a"), F.col("cluster_id").alias("cluster_a")), membership.select(F.col("entity_id").alias("b"), F.col("cluster_id").alias("cluster_b"))
    across = edges.withColumn("weight", F.round(objective_weight(F.col("score"), neutral), 6)).where("weight > 0").join(a, "a").join(b, "b").where("cluster_a <> cluster_b")
    return across.orderBy(F.desc("weight"), "a", "b").limit(limit)


def merged_above_neutral(membership: DataFrame, edges: DataFrame, neutral: float = NEUTRAL) -> DataFrame:
    return placed(edges, membership).agg(F.count_if((F.col("cluster_a") == F.col("cluster_b")) & (objective_weight(F.col("score"), neutral) > 0)).alias("n_merged"))


def size_bucket(size: Column) -> Column:
    return F.when(size <= 1, "1").when(size == 2, "2").when(size <= 5, "3-5").when(size <= 10, "6-10").otherwise("11+")


def graph_diagnostics(comps: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, components, single nodes and their share, largest component, components that look too large."""
    sizes = comps.groupBy("component_id").agg(F.first("component_size").alias("size"))
    total = comps.agg(F.count(F.lit(1)).alias("n_nodes")).crossJoin(edges.agg(F.count(F.lit(1)).alias("n_edges")))
    one = sizes.agg(F.count(F.lit(1)).alias("n_components"), F.count_if(F.col("size") == 1).alias("n_singletons"), F.max("size").cast("bigint").alias("largest"), F.count_if(F.col("size") >= GIANT_SIZE).alias("n_giant"))
    share = F.col("largest") / F.col("n_nodes")
    return total.crossJoin(one).select("*", F.round(F.col("n_singletons") / F.col("n_components"), 6).alias("singleton_rate"), ((F.col("n_nodes") >= GIANT_SIZE) & (share >= GIANT_SHARE)).alias("giant_share"))


def component_sizes(comps: DataFrame) -> DataFrame:
    return comps.groupBy("component_id").agg(F.first("component_size").alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("n_components"))


def timing_summary(timing: DataFrame) -> DataFrame:
    """p50, p95, max of elapsed_ms and the slowest component (ties by size, then id). timing: component_id, size, elapsed_ms."""
    p = F.percentile("elapsed_ms", F.array(F.lit(0.5), F.lit(0.95)))
    return timing.agg(p.alias("p"), F.max("elapsed_ms").alias("max_ms"), F.max_by("component_id", F.struct("elapsed_ms", "size", "component_id")).alias("slowest")).select(F.round(F.col("p")[0], 6).alias("p50_ms"), F.round(F.col("p")[1], 6).alias("p95_ms"), "max_ms", "slowest")


def timing_by_bucket(timing: DataFrame) -> DataFrame:
    return timing.groupBy(size_bucket(F.col("size")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("elapsed_ms"), 6).alias("avg_ms"), F.max("elapsed_ms").alias("max_ms"), F.round(F.sum("elapsed_ms"), 6).alias("sum_ms"))


def canonical_names(membership: DataFrame, entities: DataFrame) -> DataFrame:
    """cluster_id, canonical_name, canonical_type: the longest name, then the most mentions, the first place, the name itself.

    entities: entity_id, normalized, type, count, chunk_id, char_start. A cluster of several types raises when the plan runs.
    """
    rows = membership.join(entities, "entity_id")
    names = rows.groupBy("cluster_id", "normalized").agg(F.sum("count").alias("n"), F.min(F.struct("chunk_id", "char_start")).alias("place"), F.min("type").alias("low"), F.max("type").alias("high"))
    rank = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc(F.length("normalized")), F.desc("n"), "place", "normalized"))
    types = Window.partitionBy("cluster_id")
    best = names.withColumns({"rank": rank, "low": F.min("low").over(types), "high": F.max("high").over(types)}).where("rank = 1")
    kind = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.raise_error(F.concat(F.lit("several types in cluster "), F.col("cluster_id"))))
    return best.select("cluster_id", F.col("normalized").alias("canonical_name"), kind.alias("canonical_type"))


def cluster_attributes(membership: DataFrame, entities: DataFrame) -> DataFrame:
    """doc_ids and the map of chunk_ids, normalized_variants and text_variants of each cluster, all sorted and distinct."""
    every = lambda c: F.array_sort(F.collect_set(c))
    rows = membership.join(entities, "entity_id").groupBy("cluster_id").agg(every("doc_id").alias("doc_ids"), every("chunk_id").alias("chunk_ids"), every("normalized").alias("normalized_variants"), every("text").alias("text_variants"))
    return rows.select("cluster_id", "doc_ids", F.create_map(*[x for n in ("chunk_ids", "normalized_variants", "text_variants") for x in (F.lit(n), F.col(n))]).alias("attributes"))


def most_recent_document(membership: DataFrame, entities: DataFrame, dates: DataFrame) -> DataFrame:
    """cluster_id, most_recent_doc_id, most_recent_doc_date; ties go to the larger id. dates: doc_id, doc_date."""
    rows = membership.join(entities.select("entity_id", "doc_id"), "entity_id").join(dates, "doc_id")
    best = rows.groupBy("cluster_id").agg(F.max(F.struct("doc_date", "doc_id")).alias("m"))
    return best.select("cluster_id", F.col("m.doc_id").alias("most_recent_doc_id"), F.col("m.doc_date").alias("most_recent_doc_date"))


LINEAGE = ("blocking_methods", "blocking_source", "blocking_method_count", "shap_top5")


def cluster_records(membership: DataFrame, entities: DataFrame, evidence: DataFrame, edges: DataFrame) -> DataFrame:
    """One nested row for each cluster: evidence, canonical name and type, attributes, members, scored edges (with the blocking
    columns and shap_top5 that edges has)."""
    members = membership.join(entities, "entity_id").groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("entity_id", "doc_id", "normalized", "text"))).alias("members"))
    inside = placed(edges, membership).where("cluster_a = cluster_b").groupBy(F.col("cluster_a").alias("cluster_id")).agg(F.array_sort(F.collect_list(F.struct("a", "b", "score", *[c for c in LINEAGE if c in edges.columns]))).alias("edges"))
    return evidence.join(canonical_names(membership, entities), "cluster_id").join(cluster_attributes(membership, entities), "cluster_id").join(members, "cluster_id").join(inside, "cluster_id", "left")


def resolved_entities(records: DataFrame, profile: str = "quick_low_hitl") -> DataFrame:
    """One row for each member of each record, routed by a profile."""
    rows = records.select("*", F.explode("members").alias("m"))
    return rows.select("cluster_id", F.col("m.entity_id").alias("entity_id"), F.col("m.doc_id").alias("doc_id"), F.col("canonical_type").alias("entity_type"), "canonical_name", "canonical_type", "cluster_size", "confidence", (F.col(profile) == "review").alias("needs_review"), F.col(profile).alias("route_action"), "doc_ids", "attributes")


def resolved_members(membership: DataFrame, entities: DataFrame, evidence: DataFrame, profile: str = "quick_low_hitl") -> DataFrame:
    """The rows of ``resolved_entities`` without doc_ids and attributes, for clusters of any size: no cluster's members or edges are
    gathered in a row."""
    rows = membership.join(entities.select("entity_id", "doc_id"), "entity_id").join(canonical_names(membership, entities), "cluster_id").join(evidence, "cluster_id")
    return rows.select("cluster_id", "entity_id", "doc_id", F.col("canonical_type").alias("entity_type"), "canonical_name", "canonical_type", "cluster_size", "confidence", (F.col(profile) == "review").alias("needs_review"), F.col(profile).alias("route_action"))


def routing_counts(evidence: DataFrame) -> DataFrame:
    pairs = F.explode(F.array(*[F.struct(F.lit(p).alias("profile"), F.col(p).alias("action")) for p in PROFILES]))
    return evidence.select(pairs.alias("x")).groupBy("x.profile", "x.action").agg(F.count(F.lit(1)).alias("n"))
