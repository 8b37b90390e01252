"""The pipeline on a small fixture against plain Python, stage by stage."""

import random

import corpus_pipeline
from kinweave.llm import language_id, near_dedup, packing, suffix_dedup
from kinweave.llm.bpe import encoder

from test_near_dedup import components, exact_similarities

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def corpus(spark):
    """Test documents with copies, near copies, shared passages and junk put in."""
    rng = random.Random(8)
    base = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect() if 1000 < r.n_chars < 6000][:40]
    passage = " ".join(rng.choice(base)[1].split()[:70])
    out, n = list(base), 1000
    for r in base[:6]:
        out.append((n, r[1], *r[2:]))  # exact copy
        words = r[1].split()
        words[len(words) // 2] = "changed"
        out.append((n + 1, " ".join(words), *r[2:]))  # near copy
        out.append((n + 2, f"{base[20 + n % 7][1]} {passage} {n}", *r[2:]))  # near copy with a passage
        n += 3
    for _ in range(4):
        filler = " ".join("".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 9))) for _ in range(200))
        out.append((n, f"{filler} {passage} {filler[::-1]}", "en", "s", 0))
        n += 1
    out += [(n, "zxq wvk jjq xzz qqk vvw zzx kkq wwx jzq xvk qzj " * 9, "en", "s", 0), (n + 1, "", "en", "s", 0), (n + 2, None, "en", "s", 0), (n + 3, "1234 !!", "en", "s", 0)]
    return spark.createDataFrame(out, SCHEMA)


def test_stages_against_plain_python(spark, tmp_path):
    stage = dict(corpus_pipeline.STAGES)
    docs = corpus(spark)
    rows = {r.doc_id: r.text for r in docs.collect()}

    def run(name, df):
        stage[name](spark, df, "unused").write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    # Language: what the model rejects goes, and only that.
    model = language_id.fit(docs)
    one = run("language", docs)
    want = {i: t for i, t in rows.items() if not model.classify(t)[3]}
    assert {r.doc_id: r.text for r in one.collect()} == want and 4 <= len(rows) - len(want) <= 8
    # Exact copies.
    two = run("exact", one)
    first = {}
    for i, t in sorted(want.items()):
        first.setdefault(t, i)
    want = {i: t for t, i in first.items()}
    assert {r.doc_id: r.text for r in two.collect()} == want
    # Near copies, against all pairs, with exact document frequencies.
    keys, similar = exact_similarities(list(want.items()))
    assert all(abs(x - near_dedup.THRESHOLD) > 0.005 for x in similar.values())
    roots = components(len(keys), [p for p, x in similar.items() if x >= near_dedup.THRESHOLD])
    first = {keys[k][1]: keys[r][1] for k, r in enumerate(roots)}
    n = len(want)
    three = run("near", two)
    want = {i: t for i, t in want.items() if first.get(i, i) == i}
    assert {r.doc_id: r.text for r in three.collect()} == want and len(want) < n - 5
    # Repeated passages, word by word.
    four = run("repeats", three)
    seen, left = set(), {}
    for i in sorted(want):
        words = want[i].split()
        runs = [tuple(words[k : k + suffix_dedup.LENGTH]) for k in range(len(words) - suffix_dedup.LENGTH + 1)]
        gone = set()
        for k, r in enumerate(runs):
            if r in seen:
                gone |= set(range(k, k + suffix_dedup.LENGTH))
            seen.add(r)
        left[i] = [x for k, x in enumerate(words) if k not in gone]
    got = {r.doc_id: r for r in four.collect()}
    assert {i: r.text.split() for i, r in got.items()} == {i: x for i, x in left.items() if x}
    assert sum(len(x) for x in left.values()) < sum(len(t.split()) for t in want.values()) and all(r.n_chars == len(r.text) for i, r in got.items() if len(left[i]) < len(want[i].split()))
    # Packing: every token once, no sequence too long, no fewer sequences than the bound.
    five = stage["packing"](spark, four, "unused").collect()
    sizes, used = {}, {}
    for r in five:
        sizes[r.doc_id] = sizes.get(r.doc_id, 0) + r["size"]
        used[r.sequence] = used.get(r.sequence, 0) + r["size"]
    assert sizes == {i: len(encoder().encoding.encode_ordinary(r.text)) for i, r in got.items()}
    assert max(used.values()) <= packing.CAPACITY and len(used) >= -(-sum(sizes.values()) // packing.CAPACITY)


def test_run_is_its_stages(spark, tmp_path):
    import os

    os.makedirs(tmp_path / "sf")
    docs = corpus(spark)
    docs.write.parquet(str(tmp_path / "sf" / "documents.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "exact", "near", "repeats", "packing"]
    whole = corpus_pipeline.run(spark, str(tmp_path / "sf"))
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "unused")
    key = lambda df: sorted((r.doc_id, r.piece, r["size"], r.used) for r in df.collect())
    assert key(whole) == key(docs)
