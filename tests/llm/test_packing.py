import itertools
import random

import numpy as np

from kinweave.llm import packing as P
from kinweave.llm.bpe import encoder
from kinweave.llm.common import bytes_of

SCHEMA = "doc_id bigint, text string, size string, h int"


def fewest(sizes, capacity):
    """Bins of an optimal packing, by search."""
    best = len(sizes)
    sizes = sorted(sizes, reverse=True)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for j in sorted(range(len(bins)), key=lambda j: bins[j]):
            if bins[j] >= sizes[i]:
                bins[j] -= sizes[i]
                go(i + 1, bins)
                bins[j] += sizes[i]
        bins.append(capacity - sizes[i])
        go(i + 1, bins)
        bins.pop()

    go(0, [])
    return best


def plain_bfd(sizes, capacity):
    rooms, out = [], {}
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fit = [j for j, r in enumerate(rooms) if r >= sizes[i]]
        if fit:
            j = min(fit, key=lambda j: rooms[j])
        else:
            j = len(rooms)
            rooms.append(capacity)
        rooms[j] -= sizes[i]
        out[i] = j
    return len(rooms)


def test_bounds_hold_and_best_fit_is_best_fit():
    rng = random.Random(3)
    for _ in range(150):
        sizes = [rng.randint(1, 30) for _ in range(rng.randint(1, 9))]
        bins = P.best_fit_decreasing(np.array(sizes), 30)
        used = np.bincount(bins, weights=sizes)
        assert used.max() <= 30 and len(used) == plain_bfd(sizes, 30)
        assert P.lower_bound(np.array(sizes), 30) <= fewest(sizes, 30) <= len(used)
    assert P.lower_bound(np.array([16] * 5), 30) == 5  # the identity alone gives 3


def test_packing(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices(["alpha", "beta", "gamma", "x"], k=rng.randint(1, 400))), "x", 1) for i in range(300)]
    rows += [(300, None, "x", 1), (301, "", "x", 1), (302, "word " * 5000, "x", 1), (302, "word " * 5000, "x", 1), (None, "lost one", None, None), rows[0]]
    docs = spark.createDataFrame(rows, SCHEMA)
    packed = P.best_fit_packing(docs, capacity=512, partition_pieces=40)
    got = packed.collect()
    buf, offs = bytes_of(__import__("pyarrow").array([r[1] for r in rows]))
    n = np.diff(encoder().encode(buf, offs)[1])
    assert sum(r["size"] for r in got) == n.sum()
    want = {}
    for r, k in zip(rows, n):
        want[r[0]] = want.get(r[0], 0) + int(k)
    have = {}
    for r in got:
        have[r.doc_id] = have.get(r.doc_id, 0) + r["size"]
    assert have == {k: v for k, v in want.items() if v}
    for _, group in itertools.groupby(sorted(got, key=lambda r: (r.sequence, r.position)), key=lambda r: r.sequence):
        at = 0
        for r in group:
            assert r.position == at
            at += r["size"]
        assert at == r.used <= 512
    c = P.certify(docs, packed, 512).first()
    parts = -(-int(sum(k // 512 * 0 + (k % 512 > 0) for k in n)) // 40)
    assert c.bound <= c.sequences <= c.bound + parts  # each part may be certified and still end with a sequence half full
    assert all(r.bins == r.bound for r in got if r.certified)


def test_parts_with_a_gap_exchange_documents(spark, monkeypatch):
    """With a bound that no part meets, all parts are dealt together step by step, and never to more sequences."""
    rng = random.Random(4)
    docs = spark.createDataFrame([(i, "x " * rng.randint(10, 250), "x", 1) for i in range(200)], SCHEMA)
    count = lambda rounds: P.best_fit_packing(docs, capacity=512, partition_pieces=25, rounds=rounds).select("sequence").distinct().count()
    monkeypatch.setattr(P, "lower_bound", lambda sizes, capacity: 0)
    before, after = count(0), count(3)
    assert after < before


def test_empty(spark):
    assert P.best_fit_packing(spark.createDataFrame([], SCHEMA)).count() == 0


def test_the_result_does_not_depend_on_the_order_of_rows(spark):
    """A null id and id 0 have the same text; ids may be strings."""
    rng = random.Random(7)
    rows = [(None, "one two three", "x", 1), (0, "one two three", "x", 1), *[(i, "x " * rng.randint(1, 90), "x", 1) for i in range(1, 60)]]
    key = lambda r: tuple((x is None, x) for x in r)
    for ids, schema in ((lambda i: i, SCHEMA), (lambda i: None if i is None else f"id{i}", SCHEMA.replace("bigint", "string"))):
        own = [(ids(r[0]), *r[1:]) for r in rows]
        one, two = (sorted(map(tuple, P.best_fit_packing(spark.createDataFrame(r, schema), capacity=128).collect()), key=key) for r in (own, own[::-1]))
        assert one == two


def test_exchange_of_real_gaps(spark):
    """Small parts don't all meet their bounds; dealt together, their documents need fewer sequences."""
    rng = random.Random(12)
    docs = spark.createDataFrame([(i, " ".join(["x"] * rng.choice([45, 35, 20])), "x", 1) for i in range(300)], SCHEMA)
    pack = lambda rounds: P.best_fit_packing(docs, capacity=100, partition_pieces=6, rounds=rounds).collect()
    alone, got = pack(0), pack(3)
    used = {}
    for r in got:
        used[r.sequence] = used.get(r.sequence, 0) + r["size"]
    assert max(used.values()) <= 100 and sorted((r.doc_id, r["size"]) for r in got) == sorted((r.doc_id, r["size"]) for r in alone)
    assert not all(r.certified for r in alone) and len(used) < len({r.sequence for r in alone}) and any(r.sequence.startswith("r") for r in got)


def test_bounds_of_a_histogram():
    """Of any number of items, and with whole numbers beyond 64 bits."""
    count = np.zeros(2049, np.int64)
    for n in (9_999_999, 10_000_000, 10**15):
        count[1100] = n
        assert P.lower_bound_of_histogram(count, 2048) == n
