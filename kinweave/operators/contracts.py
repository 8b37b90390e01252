"""Contracts of the tables: schema, values, keys, references. A violation is a row (table key, rule); no rows means valid.

Value rules are columns of one pass; key rules are window counts; references are anti joins. Nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .graph import ensure_checkpoints
from .resolution import route

TYPES = ["COMM", "FIN", "ITEM", "LOC", "ORG", "PER", "VEH"]
METHODS = ["exact", "faiss", "minhash", "phonetic", "structured"]
ACTIONS = ["auto_merge", "defer", "keep_separate", "review"]
UNIT_KINDS = ["docx_paragraph", "pdf_page"]
SCHEMAS = {
    "docs": "run_id string, doc_id string, path string, mime_type string, source_unit_kind string, page_count int, file_size bigint, extracted_at timestamp",
    "chunks": "run_id string, chunk_id string, doc_id string, chunk_index int, text string, source_unit_kind string, page_num int",
    "entities": "run_id string, entity_id string, doc_id string, chunk_id string, text string, normalized string, type string, char_start int, char_end int, context string, count int, positions array<struct<chunk_id:string,char_start:int,char_end:int,page_num:int,source_unit_kind:string>>",
    "candidate_pairs": "run_id string, entity_id_a string, entity_id_b string, blocking_methods array<string>, blocking_source string, blocking_method_count tinyint",
    "scored_pairs": "run_id string, entity_id_a string, entity_id_b string, score float, model_version string, scored_at timestamp, blocking_methods array<string>, blocking_source string, blocking_method_count tinyint, shap_top5 array<struct<feature:string,value:float>>",
    "resolved_entities": "run_id string, cluster_id string, entity_id string, doc_id string, entity_type string, canonical_name string, canonical_type string, cluster_size int, confidence float, needs_review boolean, route_action string, clustering_method string, component_id string, doc_ids array<string>, most_recent_doc_id string, most_recent_doc_date date, attributes map<string,array<string>>",
    "labels": "run_id string, entity_id_a string, entity_id_b string, label tinyint",
}
Rules = dict[str, Column]


def schema_errors(df: DataFrame, table: str) -> list[str]:
    """Columns that are missing or of another type; more columns than needed are fine."""
    have = {f.name: f.dataType for f in df.schema.fields}
    out = []
    for f in StructType.fromDDL(SCHEMAS[table]).fields:
        if f.name not in have:
            out.append(f"{table} lacks {f.name}")
        elif have[f.name].simpleString() != f.dataType.simpleString():
            out.append(f"{table}.{f.name} is {have[f.name].simpleString()}, not {f.dataType.simpleString()}")
    return out


def is_hex32(c: str) -> Column:
    return F.coalesce(F.col(c).rlike("^[0-9a-f]{32}$"), F.lit(False))


def is_plain(c: str) -> Column:
    """Lower case, trimmed, not empty."""
    return F.coalesce((F.col(c) != "") & (F.col(c) == F.lower(F.trim(c))), F.lit(False))


def is_filled(c: Column) -> Column:
    return F.coalesce(c != "", F.lit(False))


def is_sorted_set(c: Column) -> Column:
    return F.coalesce((F.size(c) > 0) & (c == F.array_sort(F.array_distinct(c))) & F.forall(c, lambda x: F.coalesce(x != "", F.lit(False))), F.lit(False))


def is_fraction(c: str) -> Column:
    return F.coalesce(F.col(c).between(0, 1) & ~F.isnan(c), F.lit(False))


def one_of(c: str, values: list[str]) -> Column:
    return F.coalesce(F.col(c).isin(values), F.lit(False))


def violations(df: DataFrame, keys: list[str], rules: Rules) -> DataFrame:
    """keys (as strings), rule: one row for each rule that a row breaks. Rules are columns that must be true."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return df.select(*[F.col(k).cast("string").alias(k) for k in keys], broken.alias("broken")).select(*keys, F.explode("broken").alias("rule"))


def unique(*keys: str) -> Column:
    return F.count(F.lit(1)).over(Window.partitionBy(*keys)) == 1


#: Tasks that look for hashes that repeat, so that the rows of one fit its memory, and hashes that are broadcast at most (8 MB).
HASH_TASKS, HASHES = 960, 1 << 20


def repeated(df: DataFrame, keys: list[str], rule: str) -> DataFrame:
    """keys (as strings), rule for each row whose keys another row has: as ``unique``, but only 8 bytes of each row shuffle, in a
    job of its own; rows whose hash comes once, as nearly all do where keys are unique, never meet."""
    ensure_checkpoints(df.sparkSession)
    hashed = df.select(*keys, F.xxhash64(*keys).alias("h"))
    again = hashed.select("h").repartition(HASH_TASKS, "h").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h").checkpoint()
    few = again.count() <= HASHES
    suspects = hashed.join(F.broadcast(again) if few else again, "h", "left_semi").withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    return suspects.where("n > 1").select(*[F.col(k).cast("string").alias(k) for k in keys], F.lit(rule).alias("rule"))


def check_docs(df: DataFrame) -> DataFrame:
    pages = F.col("page_count").isNull() | (F.col("page_count") >= 0)
    return violations(df, ["run_id", "doc_id", "path"], {
        "run_id": is_plain("run_id"), "doc_id": is_hex32("doc_id"), "path": is_filled(F.col("path")), "mime_type": is_filled(F.col("mime_type")), "source_unit_kind": one_of("source_unit_kind", UNIT_KINDS),
        "page_count": pages, "file_size": F.col("file_size") > 0, "extracted_at": F.col("extracted_at").isNotNull(), "unique doc_id": unique("run_id", "doc_id"), "unique path": unique("run_id", "path"),
    })


def check_chunks(df: DataFrame) -> DataFrame:
    return violations(df, ["run_id", "chunk_id"], {
        "run_id": is_plain("run_id"), "chunk_id": is_hex32("chunk_id"), "doc_id": is_hex32("doc_id"), "chunk_index": F.col("chunk_index") >= 0, "text": is_filled(F.col("text")),
        "source_unit_kind": one_of("source_unit_kind", UNIT_KINDS), "page_num": F.col("page_num") >= 0, "unique chunk_id": unique("run_id", "chunk_id"), "unique chunk_index": unique("run_id", "doc_id", "chunk_index"),
    })


def check_entities(df: DataFrame) -> DataFrame:
    return violations(df, ["run_id", "entity_id"], {
        "run_id": is_plain("run_id"), "entity_id": is_hex32("entity_id"), "doc_id": is_hex32("doc_id"), "chunk_id": is_hex32("chunk_id"), "text": is_filled(F.col("text")), "normalized": is_filled(F.col("normalized")),
        "type": one_of("type", TYPES), "span": (F.col("char_start") >= 0) & (F.col("char_end") > F.col("char_start")), "context": F.col("context").isNotNull(), "count": F.col("count") == F.size("positions"),
        "positions": (F.size("positions") > 0) & F.forall("positions", lambda p: (p["char_start"] >= 0) & (p["char_end"] > p["char_start"])), "unique entity_id": unique("run_id", "entity_id"),
    })


def check_candidate_pairs(df: DataFrame) -> DataFrame:
    m, n = F.col("blocking_methods"), F.col("blocking_method_count")
    keys = ["run_id", "entity_id_a", "entity_id_b"]
    return repeated(df, keys, "unique pair").unionByName(violations(df, keys, {
        "run_id": is_plain("run_id"), "entity_id_a": is_hex32("entity_id_a"), "entity_id_b": is_hex32("entity_id_b"), "order": F.col("entity_id_a") < F.col("entity_id_b"),
        "sorted methods": is_sorted_set(m), "known methods": F.forall(m, lambda x: x.isin(METHODS)), "source": one_of("blocking_source", [*METHODS, "multi"]), "count range": n.between(1, 5),
        "count": n == F.size(m), "source of methods": F.when(F.size(m) > 1, F.col("blocking_source") == "multi").otherwise(F.col("blocking_source") == F.get(m, 0)),
    }))


def shap_rules(c: str = "shap_top5") -> Rules:
    x = F.col(c)
    sizes = F.transform(x, lambda e: F.abs(e["value"]))
    return {
        "shap size": F.size(x).between(0, 5), "shap names": F.forall(x, lambda e: F.coalesce(e["feature"] != "", F.lit(False))), "shap distinct": F.size(F.array_distinct(x["feature"])) == F.size(x),
        "shap finite": F.forall(x, lambda e: e["value"].isNotNull() & ~F.isnan(e["value"]) & (F.abs(e["value"]) < float("inf"))), "shap order": sizes == F.reverse(F.array_sort(sizes)),
    }


def check_scored_pairs(df: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """Value rules and, with candidates, that both tables have the same pairs and blocking columns."""
    keys = ["run_id", "entity_id_a", "entity_id_b"]
    out = violations(df, keys, {
        "run_id": is_plain("run_id"), "entity_id_a": is_hex32("entity_id_a"), "entity_id_b": is_hex32("entity_id_b"), "order": F.col("entity_id_a") < F.col("entity_id_b"), "score": is_fraction("score"),
        "model_version": is_filled(F.col("model_version")), "scored_at": F.col("scored_at").isNotNull(), "unique pair": unique(*keys), **shap_rules(),
    })
    if candidates is None:
        return out
    only = lambda a, b, rule: a.select(keys).distinct().join(b.select(keys).distinct(), keys, "left_anti").withColumn("rule", F.lit(rule))
    same = ["blocking_methods", "blocking_source", "blocking_method_count"]
    other = candidates.select(*keys, *[F.col(c).alias(f"c_{c}") for c in same])
    moved = df.join(other, keys).where(~(F.struct(*same) == F.struct(*[F.col(f"c_{c}") for c in same]))).select(*keys, F.lit("blocking columns").alias("rule"))
    return out.unionByName(only(df, candidates, "no candidate")).unionByName(only(candidates, df, "not scored")).unionByName(moved)


def check_resolved_entities(df: DataFrame, profile: str = "quick_low_hitl") -> DataFrame:
    """Value rules, and those of a cluster: constant columns, size, one type, the route that its confidence asks for."""
    cluster = Window.partitionBy("run_id", "cluster_id")
    constant = "canonical_name canonical_type cluster_size clustering_method component_id confidence doc_ids most_recent_doc_date most_recent_doc_id needs_review route_action".split()
    same = F.size(F.collect_set(F.to_json(F.struct(*constant, F.map_entries("attributes")))).over(cluster)) == 1
    types = F.size(F.collect_set("entity_type").over(cluster)) == 1
    expected = route(F.col("confidence").cast("double"), F.col("cluster_size"), profile)
    recent = F.col("most_recent_doc_id")
    return violations(df, ["run_id", "cluster_id", "entity_id"], {
        "run_id": is_plain("run_id"), "cluster_id": is_hex32("cluster_id"), "entity_id": is_hex32("entity_id"), "doc_id": is_hex32("doc_id"), "component_id": is_hex32("component_id"),
        "entity_type": one_of("entity_type", TYPES), "canonical_type": one_of("canonical_type", TYPES), "canonical_name": is_filled(F.col("canonical_name")), "clustering_method": is_filled(F.col("clustering_method")),
        "confidence": is_fraction("confidence"), "route_action": one_of("route_action", ACTIONS), "doc_ids": is_sorted_set(F.col("doc_ids")), "doc_id in doc_ids": F.array_contains("doc_ids", F.col("doc_id")),
        "most_recent_doc_id": recent.isNull() | F.array_contains("doc_ids", recent), "most_recent_doc_date": F.col("most_recent_doc_date").isNull() | recent.isNotNull(),
        "attributes": F.forall(F.map_entries("attributes"), lambda e: F.coalesce(e["key"] != "", F.lit(False)) & is_sorted_set(e["value"])), "route": F.col("route_action") == expected,
        "needs_review": F.col("needs_review") == (expected == "review"), "constant in cluster": same, "cluster_size": F.size(F.collect_set("entity_id").over(cluster)) == F.col("cluster_size"),
        "one type": types, "type of members": F.col("canonical_type") == F.col("entity_type"), "unique member": unique("run_id", "cluster_id", "entity_id"),
    })


def check_labels(df: DataFrame, features: DataFrame | None = None) -> DataFrame:
    """Values, keys and, with features, that every labelled pair has some."""
    keys = ["run_id", "entity_id_a", "entity_id_b"]
    out = violations(df, keys, {"run_id": is_plain("run_id"), "order": F.col("entity_id_a") < F.col("entity_id_b"), "label": F.col("label").isin(0, 1), "unique pair": unique(*keys)})
    if features is not None:
        out = out.unionByName(df.join(features.select(keys), keys, "left_anti").select(*keys, F.lit("no features").alias("rule")))
    return out


def missing_references(rows: DataFrame, key: str, others: DataFrame, other: str) -> DataFrame:
    """Values of rows.key that others.other lacks."""
    return rows.select(F.col(key).alias("missing")).where("missing is not null").distinct().join(others.select(F.col(other).alias("missing")).distinct(), "missing", "left_anti")


def check_embeddings(vectors: DataFrame, entities: DataFrame, vector: str = "embedding", dim: int | None = None, slack: float = 1e-3) -> DataFrame:
    """entity_id, rule: vectors of another length or norm, entities without one and vectors without an entity."""
    norm = F.sqrt(F.aggregate(F.transform(vector, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x))
    size = F.size(vector) == dim if dim else F.size(vector) > 0
    out = violations(vectors, ["entity_id"], {"dimension": size, "norm": F.abs(norm - 1) <= slack, "unique entity_id": unique("entity_id")})
    for a, b, rule in ((entities, vectors, "no vector"), (vectors, entities, "no entity")):
        out = out.unionByName(missing_references(a, "entity_id", b, "entity_id").select(F.col("missing").cast("string").alias("entity_id"), F.lit(rule).alias("rule")))
    return out


def require(found: DataFrame, table: str, most: int = 10) -> None:
    """Raise if there are violations, telling some."""
    rows = found.orderBy(*found.columns).take(most)
    if rows:
        raise ValueError(f"{table}: " + "; ".join(", ".join(f"{k}={v}" for k, v in r.asDict().items()) for r in rows))
