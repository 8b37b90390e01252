"""Gold mentions from a labelling tool's export, and suggestions for annotators."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .contracts import TYPES

PRIORITY = ["PER", "ORG", "LOC", "VEH", "COMM", "FIN", "ITEM"]
EXPORT = """id bigint, data struct<case_id:string,doc_id:string,doc_name:string,text:string>,
    annotations array<struct<was_cancelled:boolean,result:array<struct<id:string,type:string,value:struct<start:int,end:int,text:string,labels:array<string>>,meta:struct<text:array<string>>>>>>"""


def read_export(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EXPORT).option("multiLine", True).option("mode", "FAILFAST").json(path)


def labelled_spans(tasks: DataFrame) -> DataFrame:
    """One row for each labelled span of the tasks' active annotations, with how many of those the task has (n_active)."""
    active = F.filter("annotations", lambda a: ~F.coalesce(a["was_cancelled"], F.lit(False)))
    flat = tasks.select("data.case_id", "data.doc_id", "data.doc_name", "data.text", F.size(active).alias("n_active"), F.coalesce(F.get(active, 0)["result"], F.array()).alias("results"))
    rows = flat.select("*", F.explode_outer("results").alias("r")).drop("results").where("r is null or r.type = 'labels'")
    v = F.col("r.value")
    return rows.select("case_id", "doc_id", "doc_name", F.col("text").alias("doc_text"), "n_active", v["start"].alias("char_start"), v["end"].alias("char_end"), v["text"].alias("text"), v["labels"].alias("labels"), F.element_at("r.meta.text", 1).alias("group_id"))


def without_empty_spans(spans: DataFrame) -> DataFrame:
    """Less the spans of no length that have no label."""
    return spans.where(~((F.col("char_start") == F.col("char_end")) & (F.coalesce(F.size("labels"), F.lit(0)) <= 0)) | F.col("char_start").isNull())


def export_errors(spans: DataFrame) -> DataFrame:
    """doc_id, char_start, char_end, rule: tasks without exactly one active annotation, offsets that don't give the text, spans
    without exactly one known label, repeated or overlapping spans, several cases in one export."""
    order = Window.partitionBy("doc_id").orderBy("char_start", "char_end")
    there = F.col("char_start").isNotNull()
    own = F.substring(F.col("doc_text"), F.col("char_start") + 1, F.col("char_end") - F.col("char_start"))
    one = (F.size("labels") == 1) & F.get("labels", 0).isin(TYPES)
    lap = F.coalesce(F.lag("char_end").over(order) > F.col("char_start"), F.lit(False))
    several = spans.agg((F.count_distinct("case_id") > 1).alias("several"))
    rules = {"annotations": F.col("n_active") != 1, "offsets": there & ~F.coalesce(own == F.col("text"), F.lit(False)), "label": there & ~F.coalesce(one, F.lit(False)), "overlap": there & lap, "cases": F.col("several")}
    found = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()]))
    return spans.crossJoin(several).select("doc_id", "char_start", "char_end", found.alias("rules")).select("doc_id", "char_start", "char_end", F.explode("rules").alias("rule")).distinct()


def gold_mentions(spans: DataFrame) -> DataFrame:
    """The gold table; a span without a group is a group of its own."""
    there = spans.where("char_start is not null")
    kind = F.get("labels", 0)
    mention = F.concat(F.lit("m_"), F.substring(F.sha1(F.concat_ws("\x1f", "case_id", "doc_id", F.col("char_start").cast("string"), F.col("char_end").cast("string"), kind)), 1, 20))
    return there.select("case_id", "doc_id", "doc_name", mention.alias("mention_id"), "char_start", "char_end", "text", kind.alias("entity_type"), F.coalesce("group_id", mention).alias("group_id"), F.col("text").alias("canonical_text"), F.lit(None).cast("string").alias("notes"))


def overlapping(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Spans that begin before the one before them ends."""
    return spans.withColumn("before_end", F.lag("char_end").over(Window.partitionBy(*keys).orderBy("char_start", "char_end"))).where("before_end > char_start")


def phrase_pattern(phrases: list[str]) -> re.Pattern[str] | None:
    """Any of the phrases as whole words, the longest first."""
    found = sorted({p.strip() for p in phrases if p and p.strip()}, key=lambda p: (-len(p), p))
    return re.compile(r"(?<!\w)(?:" + "|".join(r"\s+".join(map(re.escape, p.split())) for p in found) + r")(?!\w)", re.I) if found else None


def best_spans(spans: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """Spans (start, end, type, text) without overlap: by start, then the longest, then by type, then by text."""
    out: list[tuple[int, int, str, str]] = []
    for s in sorted(set(spans), key=lambda s: (s[0], s[0] - s[1], PRIORITY.index(s[2]) if s[2] in PRIORITY else len(PRIORITY), s[3])):
        if not out or s[0] >= out[-1][1]:
            out.append(s)
    return out


def suggest(docs: DataFrame, seeds: dict[str, list[str]]) -> DataFrame:
    """doc_id, char_start, char_end, type, text: where the seed phrases of each type occur in docs (doc_id, text)."""
    patterns = [(t, p) for t, p in ((t, phrase_pattern(ps)) for t, ps in seeds.items()) if p]

    @F.pandas_udf("array<struct<char_start:int,char_end:int,type:string,text:string>>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda x: [dict(zip(("char_start", "char_end", "type", "text"), s)) for s in best_spans([(m.start(), m.end(), t, m.group()) for t, p in patterns for m in p.finditer(x or "")])])

    return docs.select("doc_id", F.explode(find("text")).alias("m")).select("doc_id", "m.*")


def tasks(docs: DataFrame, found: DataFrame, model: str = "seeds") -> DataFrame:
    """doc_id, task: each document (doc_id, doc_name, text) as a labelling task in JSON, with the suggestions (see ``suggest``) as its
    prediction; documents without any have an empty one."""
    value = F.struct(F.col("char_start").alias("start"), F.col("char_end").alias("end"), F.col("s.text").alias("text"), F.array(F.col("s.type")).alias("labels"))
    result = F.struct(F.lit("label").alias("from_name"), F.lit("text").alias("to_name"), F.lit("labels").alias("type"), value.alias("value"))
    lists = found.alias("s").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("char_start", "char_end", result.alias("r"))))["r"].alias("result"))
    rows = docs.join(lists, "doc_id", "left")
    none = F.array().cast(lists.schema["result"].dataType)
    prediction = F.struct(F.lit(model).alias("model_version"), F.coalesce("result", none).alias("result"))
    return rows.select("doc_id", F.to_json(F.struct(F.struct("doc_id", "doc_name", "text").alias("data"), F.array(prediction).alias("predictions"))).alias("task"))


def task_manifest(docs: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, doc_name, n_chars, n_suggestions, by_type (a map) of each task."""
    n = found.groupBy("doc_id", "type").agg(F.count(F.lit(1)).alias("n")).groupBy("doc_id").agg(F.sum("n").alias("n"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("m"))
    return docs.join(n, "doc_id", "left").select("doc_id", "doc_name", F.length("text").alias("n_chars"), F.coalesce("n", F.lit(0)).alias("n_suggestions"), F.coalesce("m", F.create_map().cast("map<string,bigint>")).alias("by_type"))


def read_brief(text: str) -> dict:
    """A brief: lines of ``key: value``, lists in brackets or as dashed lines below; '#' begins a comment."""
    out: dict = {}
    key = None
    for raw in text.splitlines():
        line = re.sub(r"(^|\s)#.*$", "", raw).rstrip()
        if not line.strip():
            continue
        if (item := re.match(r"\s*-\s+(.*)", line)) and key is not None:
            out[key] = (out[key] if isinstance(out[key], list) else []) + [_bare(item[1])]
        elif m := re.match(r"\s*([\w-]+)\s*:\s*(.*)$", line):
            key = m[1]
            out[key] = read_list(m[2]) if m[2].startswith("[") else _bare(m[2])
        else:
            raise ValueError(f"can't read line: {raw}")
    return out


def _bare(text: str) -> str:
    text = text.strip()
    return text[1:-1] if len(text) > 1 and text[0] == text[-1] and text[0] in "'\"" else text


def read_list(text: str) -> list[str]:
    """The items of a bracketed list; commas within quotes part nothing."""
    if not (text.startswith("[") and text.rstrip().endswith("]")):
        raise ValueError(f"no list: {text}")
    return [_bare(x) for x in re.findall(r"\"[^\"]*\"|'[^']*'|[^,\s][^,]*", text.strip()[1:-1])]
