import itertools
import math
import random
import re
from collections import Counter

import numpy as np

from kinweave.llm import near_dedup as N

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, again_id string"


def corpus(seed=5):
    rng = random.Random(seed)
    vocab = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8))) for _ in range(3000)]
    rows, n = [], 0
    for base in range(60):
        words = rng.choices(vocab, k=rng.randint(30, 200))
        for copy in range(rng.choice([1, 1, 2, 5, 9])):
            rate = rng.choice([0.0, 0.01, 0.03, 0.08, 0.2, 0.5])
            rows.append((n, " ".join(rng.choice(vocab) if rng.random() < rate else w for w in words)))
            n += 1
    return rows + [(n, None), (n + 1, ""), (n + 2, "?! ..."), (n + 3, "one"), (n + 4, "One."), (None, rows[0][1]), (0, rows[0][1]), (n + 5, "x" * 300000)]


def exact_similarities(rows):
    """Keys of the documents and the weighted Jaccard similarity of all pairs, with exact document frequencies, in plain Python."""

    def bag(text):
        words = re.findall("[0-9a-z\u0080-\U0010ffff]+", text.lower())
        return Counter(tuple(words[i : i + N.SHINGLE]) for i in range(max(1, len(words) - N.SHINGLE + 1))) if words else Counter()

    bags = {t: bag(t) for _, t in rows if t is not None}
    df = Counter(g for _, t in rows if t is not None for g in bags[t])
    n = sum(1 for _, t in rows if t is not None and bags[t])
    idf = {g: math.log(1 + n / max(d, n * N.LEAST_SHARE)) for g, d in df.items()}
    keys = sorted({(i is None, i or 0, t) for i, t in rows if t is not None and bags[t]}, key=lambda k: (k[0], k[1]))
    out = {}
    for a, b in itertools.combinations(range(len(keys)), 2):
        x, y = bags[keys[a][2]], bags[keys[b][2]]
        both = sum(min(c, y[g]) * idf[g] for g, c in x.items() if g in y)
        if both:
            out[a, b] = both / (sum(c * idf[g] for g, c in x.items()) + sum(c * idf[g] for g, c in y.items()) - both)
    return keys, out


def components(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(n)]


def test_groups_have_the_recall_of_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "x") for i, t in rows], SCHEMA)
    got = {(r.doc_id is None, r.doc_id or 0, r.h): (r.keep_id, r.keep_h) for r in N.groups(docs).collect()}
    keys, similar = exact_similarities(rows)
    hashes = {r.text: r.h for r in docs.select("text", N.text_hash("text").alias("h")).distinct().collect()}
    label = [got.get((k[0], k[1], hashes[k[2]]), i) for i, k in enumerate(keys)]
    sure = [p for p, s in similar.items() if s >= N.THRESHOLD + 0.01]
    assert sum(label[a] == label[b] for a, b in sure) >= 0.97 * len(sure) and len(sure) > 100
    roots = components(len(keys), [p for p, s in similar.items() if s >= N.THRESHOLD - 0.01])
    assert not [(a, b) for a, b in itertools.combinations(range(len(keys)), 2) if label[a] == label[b] and roots[a] != roots[b]]
    kept = N.near_dedup(docs)
    assert kept.columns == docs.columns
    left = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(left) == len(set(left))
    wordless = {(i, t) for i, t in rows if t is None or t in ("", "?! ...")}
    assert wordless <= set(left) and len(left) == len(set(label)) + len(wordless)


def test_large_buckets_give_the_same_groups(spark):
    """Documents that share half of their text are in each other's buckets without being near copies; prefixes find the pairs that are."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    common = [word() for _ in range(60)]
    rows = []
    for n in range(120):
        own = [word() for _ in range(45)]
        rows.append((2 * n, " ".join(common + own)))
        if n % 4 == 0:
            rows.append((2 * n + 1, " ".join(common + own[:-1] + [word()])))
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "x") for i, t in rows], SCHEMA)
    key = lambda small: sorted((r.doc_id, r.keep_id, r.group_size) for r in N.groups(docs, small=small).collect())
    direct = key(10**6)
    assert key(2) == direct == [(2 * n + k, 2 * n, 2) for n in range(0, 120, 4) for k in (0, 1)]


def test_counters_give_document_frequencies():
    """Of far more shingles than counters, and of few: the weights are those of exact counts but for a small error."""
    rng = np.random.default_rng(1)
    width = 1 << N.DF_BITS
    for n, rare, times in ((100_000, 6_000_000, 5), (300, 20_000, 1)):
        counts = np.concatenate([np.full(rare, times), rng.integers(n // 100, n, 500)])
        ids = rng.choice(1 << 44, len(counts), replace=False).astype(np.uint64)
        df = np.bincount(N.slots(ids).ravel(), np.tile(counts, N.DF_ROWS), N.DF_ROWS * width).astype(np.int64)
        got = N.weights(ids, np.ones(len(ids)), N.inverse_frequencies(df, n))
        want = np.log1p(n / np.maximum(counts, n * N.LEAST_SHARE))
        error = np.abs(got / want - 1)
        assert np.quantile(error, 0.99) < 0.1 and error[-500:].max() < 0.1


def test_samples_estimate_weighted_jaccard():
    rng = np.random.default_rng(3)
    ids = np.sort(rng.choice(1 << 44, 400, replace=False).astype(np.uint64))
    w = rng.random(400) * 5 + 0.1
    a, b = (ids[:300], w[:300]), (ids[60:], np.where(rng.random(340) < 0.5, w[60:], w[60:] * 1.5))
    x, y = N.samples(*a), N.samples(*b)
    share = ((x[0] == y[0]) & (x[1] == y[1])).mean()
    assert abs(share - N.similarity(a, b)) < 0.2


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert N.near_dedup(docs).count() == 0 and N.groups(docs).count() == 0
