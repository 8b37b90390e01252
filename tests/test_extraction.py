from pyspark.sql import functions as F

from kinweave.operators import extraction as X
from kinweave.operators import ingestion as G

TEXT = "Ring 912 34 567 eller +47 22 33 44 55, mail a.b_c@x.no, alfred_1212, 010190-12345 AB 12345 1234.56.78901 NO93 8601 1117 947 til Storgata 12, 0155 Oslo. Karl Johans gate 5B."


def test_patterns():
    got = [(k, TEXT[s:e]) for s, e, k in X.pattern_spans(TEXT)]
    assert got == [
        ("COMM", "912 34 567"), ("COMM", "+47 22 33 44 55"), ("COMM", "a.b_c@x.no"), ("COMM", "alfred_1212"), ("PER", "010190-12345"), ("VEH", "AB 12345"),
        ("FIN", "1234.56.78901"), ("FIN", "NO93 8601 1117 947"), ("LOC", "Storgata 12, 0155 Oslo"), ("LOC", "Karl Johans gate 5B"),
    ]
    assert X.pattern_spans("12345678 and 123456789") == [(0, 8, "COMM")] and X.pattern_spans("") == []


def test_greedy_overlaps():
    assert X.without_overlaps([(0, 5, "A"), (0, 7, "B"), (6, 9, "C"), (7, 8, "D")]) == [(0, 7, "B"), (7, 8, "D")]


def test_span_repairs():
    assert X.join_fragments([(0, 3, "PER"), (3, 5, "PER"), (6, 9, "PER"), (11, 12, "PER"), (12, 13, "ORG")]) == [(0, 9, "PER"), (11, 12, "PER"), (12, 13, "ORG")]
    t = "Skogsstua, Hammerfest"
    assert X.join_localities([(0, 9, "LOC"), (11, 21, "LOC")], t) == [(0, 21, "LOC")]
    t = "Oslo, Bergen"
    assert len(X.join_localities([(0, 4, "LOC"), (6, 12, "LOC")], t)) == 2
    t = "Parkveien 3, Essex Police"
    assert len(X.join_localities([(0, 11, "LOC"), (13, 25, "LOC")], t)) == 2


def test_types_and_plausibility(spark):
    rows = [("Essex Constabulary", "LOC"), ("Storgata 5", "ORG"), ("Styles Court", "LOC"), ("A", "PER"), ("kb", "ORG"), ("Kb", "ORG"), ("KB", "ORG"), ("Interpol", "ORG"), ("kb as", "ORG"), ("Åas", "ORG")]
    got = spark.createDataFrame(rows, "text string, kind string").select("text", X.type_of(F.col("text"), F.col("kind")).alias("type"), X.is_plausible(F.col("text"), F.col("kind")).alias("fine")).collect()
    assert [r.type for r in got[:3]] == ["ORG", "LOC", "LOC"] and [r.fine for r in got[3:]] == [False, False, False, True, True, True, True]


def test_tagger_is_pluggable():
    tagger = lambda t: [(0, 3, "PER"), (4, 10, "PER"), (11, 15, "GPE_LOC"), (16, 18, "DRV")]
    assert X.tagged_spans("Per Hansen Oslo no", tagger) == [(0, 10, "PER"), (11, 15, "LOC")]


def test_patterns_against_tags(spark):
    s = "chunk_id string, char_start int, char_end int, type string"
    r = spark.createDataFrame([("c", 0, 10, "LOC"), ("c", 20, 25, "LOC"), ("c", 30, 40, "LOC"), ("d", 0, 9, "PER")], s)
    n = spark.createDataFrame([("c", 2, 6, "LOC"), ("c", 22, 28, "LOC"), ("c", 31, 33, "LOC"), ("c", 34, 39, "PER")], s)
    got = {tuple(x) for x in X.merge_patterns_with_tags(r, n).collect()}
    assert got == {("c", 0, 10, "LOC"), ("c", 22, 28, "LOC"), ("c", 31, 33, "LOC"), ("c", 34, 39, "PER"), ("d", 0, 9, "PER")}
    assert {tuple(x) for x in X.patterns_off_tags(r, n).collect()} == {("d", 0, 9, "PER")}


def test_chunks_to_entities(spark):
    chunks = spark.createDataFrame([("d1", "c1", 0, "pdf_page", "Per Hansen called a_b1. Per Hansen left."), ("d1", "c2", 1, "pdf_page", "per hansen? Per  Hansen and A_B1"), ("d2", "c3", 0, "pdf_page", None), ("d2", "c4", 0, "pdf_page", "")], "doc_id string, chunk_id string, page_num int, source_unit_kind string, text string")
    got = {(r.doc_id, r.type, r.normalized): r for r in X.extract_entities(chunks).collect()}
    assert set(got) == {("d1", "PER", "Per Hansen"), ("d1", "COMM", "a_b1")}
    r = got["d1", "PER", "Per Hansen"]
    assert r["count"] == len(r.positions) == 2 and (r.chunk_id, r.char_start, r.text) == ("c1", 0, "Per Hansen") and r.context.startswith("Per Hansen called")
    assert got["d1", "COMM", "a_b1"]["count"] == 2 and len(r.entity_id) == 32


def test_splitting():
    text = "\n\n".join(f"Paragraph {i}. " + "word " * 60 for i in range(12))
    parts = G.split_text(text)
    assert all(0 < len(p) <= 512 and p == p.strip() for p in parts)
    assert set(" ".join(parts).split()) == set(text.split())
    assert G.split_text("x" * 2000) == ["x" * 2000] and G.split_text("") == [] and G.split_text("  \n\n ") == []
    words = " ".join(f"w{i}" for i in range(400))
    parts = G.split_text(words)
    assert all(set(a.split()[-3:]) & set(b.split()) for a, b in zip(parts, parts[1:])), "neighbours overlap"


def test_chunks_know_their_page():
    units = [(0, "a " * 300), (1, ""), (2, "b " * 300)]
    found = G.chunk_units([(p, t.strip()) for p, t in units])
    assert [p for _, t, p, _ in found] == [0 if "a" in t else 2 for _, t, _, _ in found] and [i for i, *_ in found] == list(range(len(found)))
    assert G.chunk_units([]) == [] and G.chunk_units([(0, "")]) == []


def test_chunk_documents_and_rebuild(spark):
    rows = [("r", "d1", "pdf_page", i, f"Page {i}. " + "some words here " * 50) for i in range(3)] + [("r", "d2", "pdf_page", 0, None)]
    units = spark.createDataFrame(rows, "run_id string, doc_id string, source_unit_kind string, page_num int, text string")
    chunks = G.chunk_documents(units).cache()
    assert {r.doc_id for r in chunks.collect()} == {"d1"} and {r.page_num for r in chunks.collect()} == {0, 1, 2}
    text = G.rebuild_text(chunks).first().text
    assert text.split() == " ".join(t for *_, t in rows[:3]).split()


def test_registration(spark):
    s = "run_id string, doc_id string, path string"
    docs = spark.createDataFrame([("r", "x", "b"), ("r", "x", "a"), ("r", "y", "c"), ("r", "z", "d")], s)
    assert {(r.doc_id, r.path) for r in G.register_documents(docs).collect()} == {("x", "a"), ("y", "c"), ("z", "d")}
    known = spark.createDataFrame([("r", "y", "old"), ("r", "q", "d")], s)
    assert {(r.doc_id, r.path) for r in G.register_documents(docs, known).collect()} == {("x", "a")}
