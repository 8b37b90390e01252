"""Every operator on nulls in any column, empty and very long texts, ties, repeated rows, clashing names, and no rows at all."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kinweave.llm import exact_dedup, fingerprints, language_id, line_dedup, merge_replay, near_dedup, packing, queries, simple8b, suffix_dedup, token_counts

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, h string, __h int, Key string, again_id int, `a.b` string, size int, part string, t array<string>, m map<string,int>"
LONG = "the quick brown fox jumps over a lazy dog near the river bank " * 5000
LINES = "\n".join(f"a line of its own, number {i} of many" for i in range(40))
EXTRA = ("x", 1, None, 2, "y", 3, "p", ["q"], {"k": 1})
NONE = (None,) * len(EXTRA)


def rows():
    texts = [LONG, LONG, LINES, LINES + "\nand one more", "short", "", "", None, None, "\n\n \t", "é" * 3000, "no spaces" + "x" * 200_000, "a\x00b", "🙂 emoji 🙂"]
    out = [(i, t, "en", "s", len(t) if t else None, *EXTRA) for i, t in enumerate(texts)]
    out += [(None, LONG, None, None, None, *NONE), (None, None, None, None, None, *NONE), (0, LONG, "en", "s", len(LONG), *EXTRA), (2, "another text under a taken id", "de", None, None, *NONE), (3, LINES, "fr", "s", 1, *NONE)]
    return out


OPERATORS = {
    "1": simple8b.encode_documents, "2": fingerprints.containments, "2c": fingerprints.links, "2b": fingerprints.fingerprints, "3": suffix_dedup.repeated_spans, "3b": suffix_dedup.suffix_dedup, "4": near_dedup.near_dedup, "4b": near_dedup.groups,
    "5": line_dedup.line_dedup, "6": merge_replay.encode_documents, "7": exact_dedup.exact_dedup, "8": packing.best_fit_packing, "9": token_counts.section_tokens, "10": lambda d: language_id.identify(d, language_id.fit(d)),
    "10b": lambda d: language_id.accept(d, language_id.fit(d)),
}
#: Rows of operators that keep or describe rows.
N = len(rows())
COUNTS = {"1": N, "6": N, "10": N}
KEEP_COLUMNS = ("3b", "4", "5", "7", "10b")


@pytest.mark.parametrize("ids", [int, "url-{:03}".format])
@pytest.mark.parametrize("name", OPERATORS)
def test_operator(spark, name, ids):
    """With numbers and with strings as ids."""
    docs = spark.createDataFrame([(r[0] if r[0] is None else ids(r[0]), *r[1:]) for r in rows()], COLUMNS if ids is int else COLUMNS.replace("doc_id bigint", "doc_id string"))
    got = OPERATORS[name](docs)
    found = got.collect()
    assert name not in COUNTS or len(found) == COUNTS[name]
    if name in KEEP_COLUMNS:
        assert got.dtypes == docs.dtypes
    if name == "7":
        texts = [r.text for r in found]
        assert texts.count(None) == 3 and len([t for t in texts if t is not None]) == len({r[1] for r in rows() if r[1] is not None})
        assert [r.doc_id for r in found if r.text == LONG] == [ids(0)] and [r.doc_id for r in found if r.text == LINES] == [ids(2)]
    if name in ("3b", "4", "5"):
        assert [r.text for r in found].count(None) == 3, "a null text is never dropped"
    if name == "4":
        assert [r.doc_id for r in found if r.text == LONG] == [ids(0)]
    if name == "2":
        pairs = {(r.doc_id, r.in_doc_id) for r in found}
        assert {(ids(1), ids(0)), (ids(0), ids(1)), (None, ids(0)), (ids(0), None), (ids(2), ids(3))} <= pairs and not {ids(k) for k in (4, 5, 6, 7, 8, 11, 12, 13)} & {x for p in pairs for x in p}
    if name == "2b":
        assert [r.digests for r in found if r.doc_id == ids(7)] == [None] and [r.digests for r in found if r.doc_id == ids(5)] == [[]] and len(found) == N
    if name == "3":
        marked = {(r.doc_id, r.n_words) for r in found}
        assert {(ids(1), 65_000), (None, 65_000), (ids(0), 64_987)} <= marked and not any(r.doc_id in (ids(4), ids(5), ids(7)) for r in found)
    if name == "4b":
        sizes = {(r.doc_id, r.group_size, r.copies) for r in found}
        assert {(ids(0), 3, 2), (ids(1), 3, 1), (None, 3, 1)} <= sizes
    if name == "9":
        assert {r.doc_id for r in found} >= {None, ids(0), ids(12)} and not {ids(5), ids(7)} & {r.doc_id for r in found}
        assert len([r for r in found if r.doc_id == ids(0)]) == 2 and len([r for r in found if r.doc_id == ids(2)]) == 41
    if name == "10b":
        assert not {None, ""} & {r.text for r in found}
    if name == "8":
        used = {}
        for r in found:
            used[r.sequence] = used.get(r.sequence, 0) + r["size"]
        assert max(used.values()) <= packing.CAPACITY


@pytest.mark.parametrize("name", OPERATORS)
def test_no_rows(spark, name):
    docs = spark.createDataFrame([], COLUMNS)
    got = OPERATORS[name](docs)
    assert got.count() == 0
    assert got.columns == OPERATORS[name](spark.createDataFrame(rows()[4:5], COLUMNS)).columns


@pytest.mark.parametrize("name", ["3b", "4", "5", "7"])
def test_only_nulls(spark, name):
    docs = spark.createDataFrame([(None, None, None, None, None, *NONE)] * 3, COLUMNS)
    assert OPERATORS[name](docs).count() == 3


@pytest.mark.parametrize("ids", [int, "url-{:03}".format])
def test_stages(spark, tmp_path, ids):
    """The pipeline's stages take the same rows."""
    docs = spark.createDataFrame([(r[0] if r[0] is None else ids(r[0]), *r[1:]) for r in rows()], COLUMNS if ids is int else COLUMNS.replace("doc_id bigint", "doc_id string"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, "unused")
        if k < 4:
            assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert docs.agg(F.sum("size")).first()[0] > 0


def test_every_operator_has_one_query():
    assert sorted(queries.QUERIES) == sorted(q for q in queries.QUERIES if q.split("_")[0] in {f"op{n}" for n in range(1, 11)}) and len({q.split("_")[0] for q in queries.QUERIES}) == 10


def test_stages_of_nothing(spark, tmp_path):
    docs = spark.createDataFrame([], COLUMNS)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "unused")
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.schema(out.schema).parquet(str(tmp_path / name))
        assert docs.count() == 0
