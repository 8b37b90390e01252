import random

import numpy as np
import pytest

from kinweave.llm import suffix_dedup as S
from kinweave.llm.common import text_hash

SCHEMA = "doc_id bigint, text string, n_chars bigint, hits string"


def corpus(seed=1, vocab=400):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(vocab)}"
    passages = [[word() for _ in range(rng.randint(45, 90))] for _ in range(8)]
    rows = []
    for n in range(60):
        words = [word() for _ in range(rng.randint(0, 150))]
        for _ in range(rng.choice([0, 0, 1, 2])):
            p, at = rng.choice(passages), rng.randint(0, len(words))
            words[at:at] = p[rng.choice([0, 0, 3]) :]
        rows.append((n, rng.choice([" ", "  ", "\n"]).join(words)))
    rows += [(60, None), (61, ""), (62, "a " * 500), (None, rows[5][1]), (5, rows[5][1]), (63, rows[7][1]), (64, "é " * 60 + "q"), (65, "é " * 60 + "r")]
    return rows


def brute(rows, hashes, length=S.LENGTH):
    """Word positions of each document that lie in a run of words that occurs before."""
    docs = sorted({(i is None, i or 0, hashes[t], t) for i, t in rows if t is not None})
    first, marked = {}, {}
    for none, i, h, t in docs:
        words = t.split()
        for w in range(len(words) - length + 1):
            run = tuple(words[w : w + length])
            if run in first:
                marked.setdefault((None if none else i, h), set()).update(range(w, w + length))
            else:
                first[run] = (i, w)
    return marked


@pytest.mark.parametrize("group", [S.GROUP, 400, 0])
def test_spans_are_those_of_brute_force(spark, group):
    """With a small group, anchors are lengthened step by step; the result is the same."""
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], SCHEMA)
    hashes = {r.text: r.h for r in docs.select("text", text_hash("text").alias("h")).collect()}
    got = {}
    for r in S.repeated_spans(docs, group=group).collect():
        assert r.n_words == r.end_word - r.first_word >= S.LENGTH
        got.setdefault((r.doc_id, r.h), set()).update(range(r.first_word, r.end_word))
    assert got == brute(rows, hashes) and len(got) > 20


def test_deletion(spark):
    rows = corpus(2)
    docs = spark.createDataFrame([(i, t, -1, "x") for i, t in rows], SCHEMA)
    hashes = {r.text: r.h for r in docs.select("text", text_hash("text").alias("h")).collect()}
    marked = brute(rows, hashes)
    left = S.suffix_dedup(docs)
    assert left.columns == docs.columns
    want = []
    for i, t in rows:
        gone = marked.get((i, hashes[t]), set())
        if not gone:
            want.append((i, t))
        elif kept := [w for k, w in enumerate(t.split()) if k not in gone]:
            want.append((i, " ".join(kept)))
    key = lambda x: (x[0] is None, x[0] or 0, x[1] or "")
    got = left.collect()
    norm = lambda t: t if t is None else " ".join(t.split())
    assert sorted(((r.doc_id, norm(r.text)) for r in got), key=key) == sorted(((i, norm(t)) for i, t in want), key=key)
    assert all(r.n_chars in (-1, len(r.text)) for r in got if r.text is not None)


def test_expansion_gives_common_prefixes():
    rng = np.random.default_rng(0)
    for _ in range(20):
        s = np.concatenate([rng.integers(1, 4, rng.integers(5, 60)), [0]])
        order = S.suffix_array(s, 64)
        assert [tuple(s[i:]) for i in order] == sorted(tuple(s[i:]) for i in range(len(s)))
        for depth in (1, 3, 5):
            want = [False] + [tuple(s[a : a + depth]) == tuple(s[b : b + depth]) and max(a, b) + depth <= len(s) for a, b in zip(order[:-1], order[1:])]
            assert S.expand(s, order, depth).tolist() == want


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert S.suffix_dedup(docs).count() == 0
