import pytest
from pyspark.sql import functions as F

from kinweave.functions import metaphone, names, pairs

NAMES = [
    # a, b, token jaccard, containment, trigram jaccard, exact, abbreviation
    ("per hansen", "per johansen", 1 / 3, 1 / 2, None, 0, 0),
    ("ab", "ab", 1.0, 1.0, 0.0, 1, 1),
    ("dnb asa", "den norske bank", 0.0, 0.0, 0.0, 0, 1),
    ("p hansen", "per hansen", 1 / 3, 1 / 2, None, 0, 1),
    ("", "x", 0.0, 0.0, 0.0, 0, 0),
    (None, None, 0.0, 0.0, 0.0, 0, 0),
    ("Straße", "STRASSE", 0.0, 0.0, 0.0, 1, None),
    ("Åse", "Åse", 0.0, 0.0, None, 1, None),
]


def frame(spark, rows):
    full = [("r", str(i), str(i) + "b", a, b, "01019012345 x", "y 01019012345", "PER", "PER", "d", "d", 2) for i, (a, b, *_) in enumerate(rows)]
    return spark.createDataFrame(full, "run_id string, entity_id_a string, entity_id_b string, name_a string, name_b string, context_a string, context_b string, entity_type_a string, entity_type_b string, doc_id_a string, doc_id_b string, blocking_method_count int")


def test_pair_features(spark):
    got = {int(r.entity_id_a): r for r in pairs.add_features(frame(spark, NAMES)).collect()}
    for i, (a, b, jaccard, inside, tri, exact, short) in enumerate(NAMES):
        r = got[i]
        assert r.token_jaccard_similarity == pytest.approx(jaccard) and r.token_containment_ratio == pytest.approx(inside), (a, b)
        assert tri is None or r.char_trigram_jaccard_similarity == tri
        assert r.exact_canonical_name_match == exact and (short is None or r.abbreviation_match_flag == short), (a, b)
        assert r.norwegian_id_match == 1 and r.shared_doc_count == 1 and r.blocking_method_count == 2 and r.cosine_sim_entity is None
    assert got[0].first_name_match == 1 and got[0].last_name_match == 0 and got[4].first_name_match == 0


def test_jaro_winkler():
    assert pairs.jaro_winkler("MARTHA", "MARHTA") == pytest.approx(0.961111, abs=1e-6)
    assert pairs.jaro_winkler("ab", "ac") == pytest.approx(2 / 3)  # not boosted below 0.7
    assert pairs.jaro_winkler("", "a") == 0 and pairs.jaro_winkler("same", "same") == 1


def test_cosine(spark):
    rows = spark.createDataFrame([(x, y) for x in ([1.0, 0.0],) for y in (x, [0.0, 1.0], [-1.0, 0.0])] + [(None, [1.0, 0.0])], "u array<float>, v array<float>")
    assert [r[0] for r in rows.select(pairs.cosine(F.col("u"), F.col("v"))).collect()] == [1.0, 0.0, -1.0, None]


def test_no_evidence_is_capped_and_any_evidence_is_not(spark):
    base = dict(token_jaccard_similarity=0.0, jaro_winkler_similarity=0.1, levenshtein_ratio_similarity=0.1, char_trigram_jaccard_similarity=0.0, abbreviation_match_flag=0, double_metaphone_overlap_flag=0, first_name_match=0, last_name_match=0, norwegian_id_match=0, exact_canonical_name_match=0)
    rows = [base | {"score": 0.9}] + [base | {k: 1 if isinstance(v, int) else 0.9, "score": 0.9} for k, v in base.items()] + [base | {"score": 0.2}]
    got = [r.score for r in pairs.cap_scores(spark.createDataFrame([tuple(r.values()) for r in rows], list(rows[0]))).collect()]
    assert got[0] == 0.49 and got[1:-1] == [0.9] * len(base) and got[-1] == 0.2


def test_metaphone():
    assert metaphone.double_metaphone("Smith") == ("SM0", "XMT") and metaphone.double_metaphone("Schmidt")[0] in ("XMT", "SMT")
    assert metaphone.double_metaphone("Thomas")[0] == "TMS" and metaphone.double_metaphone("") == ("", "")
    assert metaphone.codes("Catherine") & metaphone.codes("Katherine")


def test_normalization(spark):
    assert names.clean_text("a\tb\r\nc \x00 d") == "a b\nc d" and names.clean_text(None) == "" and names.clean_text("Å") == "Å"
    assert names.clean_text("KÃ¸benhavn") == "København" and names.clean_text("café") == "café"
    rows = [("hr. karl-johan  o'brien", "PER", "Karl-Johan O'Brien"), ("fru", "PER", "Fru"), ("Equinor ASA", "ORG", "Equinor"), ("Oslo Kommune", "LOC", "Oslo"), ("ab 1234", "VEH", "AB 1234"), ("X Y", "ITEM", "x y"), ("12 34-5", "FIN", "12345"), ("+47 22", "COMM", "4722"), ("A@b.no", "COMM", "a@b.no"), (None, "PER", "")]
    df = spark.createDataFrame(rows, "t string, k string, want string")
    assert all(r.got == r.want for r in df.select("want", names.normalize_name(F.col("t"), F.col("k")).alias("got")).collect())


def test_phonetic_forms_differ_in_case_and_order(spark):
    r = spark.createDataFrame([("Kjær",)], "t string").select(names.phonetic_blocking_form(F.col("t")), names.phonetic_feature_form(F.col("t"))).first()
    assert tuple(r) == ("kaer", "Kjaer")


def test_ids(spark):
    import hashlib

    r = spark.createDataFrame([("a", 1)], "x string, y int").select(names.hash_id("x", F.col("y").cast("string"))).first()
    assert r[0] == hashlib.sha256(b"a|1").hexdigest()[:32]
