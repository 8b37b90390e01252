from collections import Counter

from pyspark.sql import functions as F

from kinweave.llm import language_id as L

DOCS = "/root/testdata/sf0.001/documents.parquet"


def brute_profile(texts):
    n = Counter()
    for t in texts:
        plain = " " + " ".join("".join(c if c.isalpha() else " " for c in t.lower()).split()) + " "
        if plain.strip():
            n.update(plain[i : i + k] for k in L.ORDERS for i in range(len(plain) - k + 1) if plain[i : i + k] != " ")
    return [g for g, _ in sorted(n.items(), key=lambda x: (-x[1], sum(ord(c) << 21 * (len(x[0]) - 1 - i) for i, c in enumerate(x[0]))))][: L.PROFILE]


def brute_distance(own, other):
    rank = {g: i for i, g in enumerate(other)}
    return sum(abs(i - rank[g]) if g in rank else L.PROFILE for i, g in enumerate(own)) / (L.PROFILE * len(own))


def test_distances_are_those_of_brute_force(spark):
    texts = {"en": ["the cat sat on the mat", "this is the way"], "de": ["der Hund und die Katze", "das ist nicht gut"], "xx": ["日本語 テスト"]}
    docs = spark.createDataFrame([(i, t, k) for i, (k, t) in enumerate((k, t) for k, ts in texts.items() for t in ts)], "doc_id bigint, text string, lang string")
    model = L.fit(docs)
    assert model.languages == sorted(texts)
    profiles = {k: brute_profile(ts) for k, ts in texts.items()}
    for t in ("the dog and the cat", "die Katze", "Ünïcode", "日本"):
        own = brute_profile([t])
        want = {k: brute_distance(own, p) for k, p in profiles.items()}
        best, distance, margin, _ = model.classify(t)
        assert abs(distance - min(want.values())) < 1e-12 and best == min(want, key=lambda k: (want[k], k))
        assert abs(margin - (sorted(want.values())[1] - distance)) < 1e-12


def test_held_out_accuracy_and_clean_documents_stay(spark):
    docs = spark.read.parquet(DOCS)
    held = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    found = L.identify(docs.where(held), L.fit(docs.where(~held)))
    long = found.where("predicted is not null").collect()
    assert sum(r.predicted == r.lang for r in long) >= 0.95 * len(long) and len(long) > 40
    assert sum(r.rejected for r in long) <= 0.02 * len(long)


def test_rejects(spark):
    model = L.fit(spark.read.parquet(DOCS))
    assert model.classify(None)[3] and model.classify("")[3] and model.classify("12 34 !!")[3]
    assert model.classify("zxq wvk jjq xzz qqk vvw zzx kkq wwx jzq xvk qzj " * 5)[3]
    assert not model.classify("ok")[3]


def test_profiles_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet(DOCS)
    a, b = L.fit(docs.repartition(7), sample=5), L.fit(docs.repartition(2), sample=5)
    assert a.languages == b.languages and all((x == y).all() for x, y in zip(a.profiles, b.profiles))


def test_the_sample_is_that_of_all_rows(spark):
    """The rows with the smallest hashes, found in a part of the range or, where that has too few, among all."""
    docs = spark.read.parquet(DOCS)
    for rows in (docs, docs.withColumn("text", F.when(F.col("doc_id") % 40 == 0, F.col("text")))):
        by = {}
        for r in rows.where("text is not null").select("lang", "text", F.xxhash64("doc_id", "text").alias("h")).collect():
            by.setdefault(r.lang, []).append((r.h, r.text))
        model = L.fit(rows, sample=3)
        want = {k: L.fit(spark.createDataFrame([(i, t, k) for i, (_, t) in enumerate(sorted(v)[:3])], "doc_id bigint, text string, lang string")).profiles[0] for k, v in by.items()}
        assert model.languages == sorted(want) and all((p == want[k]).all() for k, p in zip(model.languages, model.profiles))
