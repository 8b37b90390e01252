"""Evaluation: mention, pair and cluster metrics, gold groups, labels, error analysis, regression checks."""

from __future__ import annotations

from collections.abc import Iterator
from math import isfinite

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .graph import ensure_checkpoints

NO_GROUP, MANY_GROUPS = "__fp__:", "__ambiguous__:"
DRIFT = dict.fromkeys(("bcubed_f0_5", "bcubed_f1", "pairwise_f0_5", "pairwise_f1"), 0.03) | dict.fromkeys(("nmi", "ari"), 0.05)
#: Tasks of a join that makes pairs of what agrees.
WITHIN_TASKS = 256
SPAN = "doc_id entity_type char_start char_end".split()


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def f_beta(p: Column, r: Column, beta: float) -> Column:
    return ratio((1 + beta * beta) * p * r, beta * beta * p + r)


def set_metrics(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """true_positives, n_gold, n_predicted, precision, recall, f1, f0_5 of two tables of keys with the same columns."""
    gold, predicted = gold.distinct(), predicted.select(*gold.columns).distinct()
    flags = gold.withColumns({"g": F.lit(1), "p": F.lit(0)}).unionByName(predicted.withColumns({"g": F.lit(0), "p": F.lit(1)}))
    rows = flags.groupBy(*gold.columns).agg(F.max("g").alias("g"), F.max("p").alias("p"))
    n = rows.agg(*[F.coalesce(F.sum(e), F.lit(0)).cast("bigint").alias(a) for a, e in (("true_positives", F.col("g") * F.col("p")), ("n_gold", F.col("g")), ("n_predicted", F.col("p")))])
    p, r = ratio(F.col("true_positives"), F.col("n_predicted")), ratio(F.col("true_positives"), F.col("n_gold"))
    return n.select("*", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f_beta(p, r, 1), 6).alias("f1"), F.round(f_beta(p, r, 0.5), 6).alias("f0_5"))


def positive_pairs(membership: DataFrame, group: str) -> DataFrame:
    """Pairs a < b of entities of the same group. Where only their number matters, see ``cluster_metrics``."""
    x = membership.select(F.col("entity_id").alias("a"), group)
    return x.join(x.withColumnRenamed("a", "b"), group).where("a < b").select("a", "b")


def cluster_metrics(membership: DataFrame, gold: str = "gold_group", predicted: str = "predicted_cluster") -> DataFrame:
    """One row of pairwise, ARI, NMI and B-cubed metrics, from the contingency table alone; zeros for no rows.

    NMI is normalised by the mean of both entropies. Both are 1 where each side has one cluster, or every row one of its own.
    """
    cells = membership.groupBy(F.col(gold).alias("g"), F.col(predicted).alias("c")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    cells = cells.withColumns({"ng": F.sum("n").over(Window.partitionBy("g")), "nc": F.sum("n").over(Window.partitionBy("c"))})
    pairs = lambda x: x * (x - 1) / 2
    total = membership.agg(F.count(F.lit(1)).cast("double").alias("total"))
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    # A group's own sums, spread over its cells, so that one pass has everything.
    sums = cells.crossJoin(total).agg(
        zero(F.first("total")).alias("total"),
        zero(F.sum(pairs(F.col("n")))).alias("both"),
        zero(F.sum((F.col("ng") - 1) / 2 * F.col("n"))).alias("in_gold"),
        zero(F.sum((F.col("nc") - 1) / 2 * F.col("n"))).alias("in_predicted"),
        zero(F.sum(F.col("n") * F.col("n") / F.col("nc"))).alias("bp"),
        zero(F.sum(F.col("n") * F.col("n") / F.col("ng"))).alias("br"),
        zero(F.sum(-F.col("n") / F.col("total") * F.ln(F.col("ng") / F.col("total")))).alias("hg"),
        zero(F.sum(-F.col("n") / F.col("total") * F.ln(F.col("nc") / F.col("total")))).alias("hc"),
        zero(F.sum(F.col("n") / F.col("total") * F.ln(F.col("n") * F.col("total") / (F.col("ng") * F.col("nc"))))).alias("mi"),
    )
    c = F.col
    p, r = ratio(c("both"), c("in_predicted")), ratio(c("both"), c("in_gold"))
    every = pairs(c("total"))
    expected = ratio(c("in_gold") * c("in_predicted"), every)
    most = (c("in_gold") + c("in_predicted")) / 2
    ari = F.when(c("total") == 0, 0.0).when(F.abs(most - expected) < 1e-12, 1.0).otherwise((c("both") - expected) / (most - expected))
    mean = (c("hg") + c("hc")) / 2
    nmi = F.when(c("total") == 0, 0.0).when(mean < 1e-12, 1.0).otherwise(F.greatest(F.lit(0.0), c("mi")) / mean)
    bp, br = ratio(c("bp"), c("total")), ratio(c("br"), c("total"))
    made = {
        "pairwise_precision": p, "pairwise_recall": r, "pairwise_f1": f_beta(p, r, 1), "pairwise_f0_5": f_beta(p, r, 0.5), "ari": ari, "nmi": nmi,
        "bcubed_precision": bp, "bcubed_recall": br, "bcubed_f1": f_beta(bp, br, 1), "bcubed_f0_5": f_beta(bp, br, 0.5),
    }
    return sums.select(c("total").cast("bigint").alias("n"), *[F.round(v, 6).alias(k) for k, v in made.items()])


def gold_groups(entities: DataFrame, matches: DataFrame) -> DataFrame:
    """entity_id, gold_group: the entity's one group, or a marker for none or for several. matches: entity_id, group_id."""
    found = matches.groupBy("entity_id").agg(F.array_sort(F.collect_set("group_id")).alias("g"))
    g = F.col("g")
    group = F.when(F.coalesce(F.size(g), F.lit(0)) <= 0, F.concat(F.lit(NO_GROUP), "entity_id")).when(F.size(g) == 1, g[0]).otherwise(F.concat(F.lit(MANY_GROUPS), "entity_id"))
    return entities.select("entity_id").join(found, "entity_id", "left").select("entity_id", group.alias("gold_group"))


def labelable(group: Column) -> Column:
    return ~F.startswith(group, F.lit(NO_GROUP)) & ~F.startswith(group, F.lit(MANY_GROUPS))


def labels_from_gold(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """entity_id_a, entity_id_b, label of the pairs both of whose entities have one group."""
    fine = groups.where(labelable(F.col("gold_group")))
    out = pairs.join(fine.toDF("entity_id_a", "ga"), "entity_id_a").join(fine.toDF("entity_id_b", "gb"), "entity_id_b")
    return out.select("entity_id_a", "entity_id_b", (F.col("ga") == F.col("gb")).cast("tinyint").alias("label"))


def labels_within(entities: DataFrame, on: list[str], groups: DataFrame) -> DataFrame:
    """``labels_from_gold`` of all pairs a < b that agree in the columns ``on``: entities without one group are left out and the others
    get theirs before pairs are made, so that no pair is looked up."""
    fine = entities.join(groups.where(labelable(F.col("gold_group"))), "entity_id").repartition(WITHIN_TASKS, *on)
    side = lambda s: fine.select(*on, F.col("entity_id").alias(f"entity_id_{s}"), F.col("gold_group").alias(f"g{s}"))
    out = side("a").join(side("b"), on).where("entity_id_a < entity_id_b")
    return out.select("entity_id_a", "entity_id_b", (F.col("ga") == F.col("gb")).cast("tinyint").alias("label"))


def blocking_recall(gold_pairs: DataFrame, candidates: DataFrame) -> DataFrame:
    hit = candidates.select("a", "b").distinct().withColumn("hit", F.lit(1))
    n = gold_pairs.distinct().join(hit, ["a", "b"], "left").agg(F.count(F.lit(1)).alias("n_gold"), F.coalesce(F.sum("hit"), F.lit(0)).alias("n_found"))
    return n.select("*", F.round(ratio(F.col("n_found"), F.col("n_gold")), 6).alias("recall"))


def group_recall(membership: DataFrame, group: str, candidates: DataFrame) -> DataFrame:
    """``blocking_recall`` of all pairs of a group, counted from the groups' sizes: pairs aren't made. candidates: a < b, with the
    groups of both ends as group_a and group_b. Entities of several groups, whose pairs could count twice, go by the pairs."""
    own = membership.select("entity_id", group).dropna().distinct()
    if not own.groupBy("entity_id").count().where("count > 1").isEmpty():
        return blocking_recall(positive_pairs(own, group), candidates)
    n = own.groupBy(group).agg(F.count(F.lit(1)).alias("n")).agg(F.expr("coalesce(sum(n * (n - 1) div 2), 0)").alias("n_gold"))
    found = candidates.where(F.col(f"{group}_a") == F.col(f"{group}_b")).select("a", "b").distinct().agg(F.count(F.lit(1)).alias("n_found"))
    return n.crossJoin(found).select("*", F.round(ratio(F.col("n_found"), F.col("n_gold")), 6).alias("recall"))


def running_sums(rows: DataFrame, order: str, sums: dict[str, str]) -> DataFrame:
    """rows with running sums (new column: summed column) from the largest ``order`` on, whose values are distinct.

    Ranges of ``order`` are summed for themselves; each then gets the totals of the ranges before it, one row for each.
    """
    ensure_checkpoints(rows.sparkSession)
    ranged = rows.repartitionByRange(F.desc(order)).withColumn("_range", F.spark_partition_id()).checkpoint()
    totals = ranged.groupBy("_range").agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as partitions
    offsets = totals.select("_range", *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0.0)).alias(f"_{n}") for n in sums])
    own = Window.partitionBy("_range").orderBy(F.desc(order))
    return ranged.join(F.broadcast(offsets), "_range").withColumns({n: F.sum(c).over(own) + F.col(f"_{n}") for n, c in sums.items()}).drop("_range", *[f"_{n}" for n in sums])


def threshold_metrics(scored: DataFrame, threshold: float = 0.5, beta: float = 0.5) -> DataFrame:
    """Precision, recall, F and average precision of scores against labels (columns score, label).

    Average precision is the sum over distinct scores of the gain in recall times the precision there.
    """
    hit = (F.col("score") >= threshold).cast("int")
    n = scored.agg(*[F.coalesce(F.sum(e), F.lit(0)).cast("double").alias(a) for a, e in (("tp", hit * F.col("label")), ("fp", hit * (1 - F.col("label"))), ("fn", (1 - hit) * F.col("label")))])
    steps = scored.groupBy("score").agg(F.sum("label").cast("double").alias("pos"), F.count(F.lit(1)).cast("double").alias("all"))
    steps = running_sums(steps, "score", {"tp": "pos", "seen": "all"})
    ap = steps.agg(ratio(F.sum(F.col("pos") * F.col("tp") / F.col("seen")), F.sum("pos")).alias("ap"))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return n.crossJoin(ap).select(F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f_beta(p, r, beta), 6).alias("f_beta"), F.round(F.coalesce("ap", F.lit(0.0)), 6).alias("average_precision"))


def missing_and_spurious(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Mentions by type that only one side has: entity_type, kind, n. Keys: doc_id, entity_type, char_start, char_end."""
    keys = SPAN
    only = lambda x, y, kind: x.select(keys).distinct().join(y.select(keys).distinct(), keys, "left_anti").groupBy("entity_type").agg(F.count(F.lit(1)).alias("n")).select("entity_type", F.lit(kind).alias("kind"), "n")
    return only(gold, predicted, "missing").unionByName(only(predicted, gold, "spurious"))


def false_merges(membership: DataFrame) -> DataFrame:
    """predicted_cluster, n_pairs: pairs of one cluster with different groups, counted from group sizes."""
    n = membership.groupBy("predicted_cluster", "gold_group").agg(F.count(F.lit(1)).alias("n"))
    c = n.groupBy("predicted_cluster").agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.col("n")).alias("s"))
    return c.select("predicted_cluster", ((F.col("t") * F.col("t") - F.col("s")) / 2).cast("bigint").alias("n_pairs")).where("n_pairs > 0")


def false_splits(membership: DataFrame) -> DataFrame:
    """gold_group, n_clusters of groups that several clusters share."""
    return membership.groupBy("gold_group").agg(F.count_distinct("predicted_cluster").alias("n_clusters")).where("n_clusters > 1")


def two_phase_match(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """mention_id, entity_id, phase: gold mentions and predicted ones (doc_id, entity_type, char_start, char_end, text).

    First by exact span where one predicted row has it; what is left is paired in order within (document, type, text).
    """
    span = SPAN
    single = predicted.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*span))).where("n = 1").select(*span, "pred_id", "entity_id")
    exact = gold.join(single, span).select("mention_id", "entity_id", "pred_id", F.lit("span").alias("phase"))
    order = Window.partitionBy("doc_id", "entity_type", "text").orderBy("char_start", "char_end", "id")
    number = lambda rows, i: rows.withColumn("id", F.col(i)).withColumn("k", F.row_number().over(order)).select("doc_id", "entity_type", "text", "k", *[c for c in ("mention_id", "pred_id", "entity_id") if c in rows.columns])
    g = number(gold.join(exact, "mention_id", "left_anti"), "mention_id")
    p = number(predicted.join(exact, "pred_id", "left_anti"), "pred_id")
    rest = g.join(p, ["doc_id", "entity_type", "text", "k"]).select("mention_id", "entity_id", F.lit("order").alias("phase"))
    return exact.drop("pred_id").unionByName(rest)


def predicted_mentions(entities: DataFrame, chunks: DataFrame) -> DataFrame:
    """doc_id, entity_type, char_start, char_end, text, entity_id, pred_id: every position of every entity in its document's text.

    chunks need chunk_id and global_start; a position that the overlap of two chunks gives twice counts once.
    """
    rows = entities.select("doc_id", F.col("type").alias("entity_type"), "text", "entity_id", F.explode("positions").alias("p"))
    rows = rows.select("doc_id", "entity_type", "text", "entity_id", F.col("p.chunk_id").alias("chunk_id"), F.col("p.char_start").alias("s"), F.col("p.char_end").alias("e"))
    at = F.col("global_start")
    placed = rows.join(chunks.select("chunk_id", "global_start"), "chunk_id").select("doc_id", "entity_type", (F.col("s") + at).alias("char_start"), (F.col("e") + at).alias("char_end"), "text", "entity_id")
    return placed.dropDuplicates(["entity_id", "char_start", "char_end"]).withColumn("pred_id", F.concat_ws(":", "entity_id", F.col("char_start").cast("string"), F.col("char_end").cast("string")))


def with_document_ids(gold: DataFrame, docs: DataFrame) -> DataFrame:
    """gold (doc_id, doc_name, ...) with ids of docs (doc_id, path): an id that docs has stays, others are looked up by file name.

    A name that several documents have, or none, raises when the plan runs.
    """
    known = docs.select(F.col("doc_id").alias("known_id")).distinct()
    names = docs.groupBy(F.element_at(F.split("path", "/"), -1).alias("file_name")).agg(F.min("doc_id").alias("named_id"), F.count_distinct("doc_id").alias("n_named"))
    rows = gold.join(known, F.col("doc_id") == F.col("known_id"), "left").join(names, F.element_at(F.split("doc_name", "/"), -1) == F.col("file_name"), "left")
    wrong = F.raise_error(F.concat(F.lit("no single document is named "), F.coalesce("doc_name", F.lit("?"))))
    found = F.coalesce("known_id", F.when(F.col("n_named") == 1, F.col("named_id")).otherwise(wrong))
    return rows.withColumn("doc_id", found).select(*gold.columns)


def place_in(text: str, mentions: list[tuple[int, int, str]], back: int = 256) -> list[tuple[int, int] | None]:
    """Where each mention (start, end, its text), in order, lies in a text: where it says if the text agrees; else the first place
    after the last one found, else the first from ``back`` characters before its start, else anywhere, else None."""
    out: list[tuple[int, int] | None] = []
    last = 0
    for start, end, own in mentions:
        at = start if own and text[start:end] == own else -1
        for low in (last, max(start - back, 0), 0) if own and at < 0 else ():
            at = text.find(own, low)
            if at >= 0:
                break
        out.append((at, at + len(own)) if at >= 0 else None)
        last = at + len(own) if at >= 0 else last
    return out


def realigned(gold: DataFrame, texts: DataFrame) -> DataFrame:
    """gold with char_start and char_end in the documents' own texts (doc_id, text); null where a mention isn't found."""

    arrow = to_arrow_schema(gold.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for mentions, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = place_in(text or "", [(int(m["m"]["char_start"]), int(m["m"]["char_end"]), m["m"]["text"] or "") for m in mentions])
                out += [m["m"] | {"char_start": f and f[0], "char_end": f and f[1]} for m, f in zip(mentions, found)]
            yield pa.RecordBatch.from_pylist(out, arrow)

    order = F.struct("char_start", "char_end", "mention_id", F.struct(*gold.columns).alias("m"))
    own = gold.groupBy(F.col("doc_id").alias("own_id")).agg(F.array_sort(F.collect_list(order)).alias("mentions"))
    text = texts.groupBy("doc_id").agg(F.first("text").alias("text"))
    return own.join(text, F.col("own_id").eqNullSafe(F.col("doc_id")), "left").select("mentions", "text").mapInArrow(run, gold.schema)


def macro_average(folds: DataFrame, metrics: list[str]) -> DataFrame:
    return folds.agg(*[F.round(F.avg(m), 6).alias(m) for m in metrics])


def geometric_mean(values: DataFrame, column: str) -> DataFrame:
    """The geometric mean of a column, 0 if any value isn't positive or there is none."""
    return values.agg(F.when((F.count(column) == 0) | (F.min(column) <= 0), 0.0).otherwise(F.round(F.exp(F.avg(F.ln(F.when(F.col(column) > 0, F.col(column))))), 6)).alias("objective"))


def regression_checks(metrics: dict[str, float], baseline: dict[str, float] | None = None, drift: dict[str, float] = DRIFT) -> list[str]:
    """What is wrong with a run's metrics: none at all, a value that isn't finite, or a fall below the baseline beyond drift."""
    if not metrics:
        return ["no metrics"]
    out = [f"{k} is not finite" for k, v in metrics.items() if not isfinite(v)]
    for k, allowed in drift.items():
        if baseline and k in baseline and k in metrics and baseline[k] - metrics[k] > allowed + 1e-12:
            out.append(f"{k} fell from {baseline[k]:.3f} to {metrics[k]:.3f}")
    return out
