import random

import numpy as np
import pyarrow as pa

from kinweave.llm import fingerprints as C
from kinweave.llm.common import bytes_of

SCHEMA = "doc_id bigint, text string, h string, digest string"


def slow_ends(data: bytes) -> list[int]:
    """Byte by byte, one text alone."""
    ends, at, h = [], 0, 0
    hashes = []
    for b in data:
        h = ((h << 1) + int(C.GEAR[b])) & (1 << 64) - 1
        hashes.append(h)
    while at < len(data):
        end = min(at + C.MOST, len(data))
        if len(data) - at > C.LEAST:
            for e in range(at + C.LEAST, end):
                mask = int(C.STRICT) if e < at + C.NORMAL else int(C.LOOSE)
                if hashes[e - 1] & mask == 0:
                    end = e
                    break
        else:
            end = len(data)
        ends.append(end)
        at = end
    return ends


def corpus(seed=9):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghé ", k=rng.randint(1, 9)))
    rows = []
    for n in range(40):
        rows.append((n, " ".join(word() for _ in range(rng.randint(0, 900)))))
    for n in range(40, 80):
        base = rng.choice(rows)[1]
        cut = rng.randint(0, len(base))
        rows.append((n, base[:cut] + " inserted words " * rng.choice([0, 1, 20]) + base[cut : cut + rng.choice([300, 10**6])]))
    return rows + [(80, None), (81, ""), (82, "short"), (83, "short"), (None, rows[3][1]), (3, rows[3][1]), (84, "x" * 200000)]


def test_boundaries_are_those_of_the_byte_loop():
    texts = [t for _, t in corpus() if t is not None]
    buf, offs = bytes_of(pa.array(texts))
    ends, until = C.chunk_ends(buf, offs)
    for i, t in enumerate(texts):
        assert (ends[until[i] : until[i + 1]] - offs[i]).tolist() == slow_ends(t.encode())


def test_an_insertion_changes_few_chunks():
    rng = random.Random(0)
    text = " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(5000))
    cut = lambda t: {t.encode()[a:b] for e in [slow_ends(t.encode())] for a, b in zip([0, *e], e)}
    a, b = cut(text), cut(text[:9000] + "something new" + text[9000:])
    assert len(a - b) <= 3


def test_pairs_are_those_of_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)
    prints = C.fingerprints(docs)
    sets = {}
    for r in prints.collect():
        assert (r.n_bytes is None) == (r.digests is None)
        if r.digests:
            assert sum(r.sizes) == r.n_bytes
            sets[(r.doc_id is None, r.doc_id, r.h)] = dict(zip(r.digests, r.sizes))
    order = sorted(sets, key=lambda k: (k[0], k[1] or 0, k[2]))
    rep = {}
    for k in order:
        rep.setdefault(tuple(sorted(sets[k].items())), k)
    want, between = set(), []
    for a in order:
        for b in order:
            if a == b:
                continue
            ra, rb = rep[tuple(sorted(sets[a].items()))], rep[tuple(sorted(sets[b].items()))]
            shared, total = sum(w for d, w in sets[a].items() if d in sets[b]), sum(sets[a].values())
            if ra != rb and (ra, rb) == (a, b) and shared >= C.THRESHOLD * total:
                between.append((a, b, shared, total))
            if (ra == rb and ra in (a, b)) or (ra != rb and (ra, rb) == (a, b) and shared >= C.THRESHOLD * total):
                want.add((a[1], b[1], shared, total))
    for options in ({}, {"limit": 16, "block": 5}):  # with filters that tell nothing, and blocks that are split
        got = C.containments(docs, **options).collect()
        assert {(r.doc_id, r.in_doc_id, r.shared_bytes, r.n_bytes) for r in got} == want and len(got) == len(want) > 50
    # The numbers of each document's links, those between representatives counted for all members.
    of = {k: rep[tuple(sorted(sets[k].items()))] for k in order}
    into = {k: [(w, b) for a, b, w, _ in between if a == k] for k in rep.values()}
    out = {k: sum(b == k for _, b, _, _ in between) for k in rep.values()}
    for options in ({}, {"block": 3}):
        rows_ = C.links(docs, **options).collect()
        assert len(rows_) == len(order)
        told = {(r.doc_id, r.class_id, r.class_size, r.n_containing, r.n_contained, None if r.containment is None else round(r.containment, 9)) for r in rows_}
        best = lambda k: round(max(w for w, _ in into[of[k]]) / sum(sets[k].values()), 9) if into[of[k]] else None
        assert told == {(k[1], of[k][1], sum(x == of[k] for x in of.values()), len(into[of[k]]), out[of[k]], best(k)) for k in order}


def test_near_copies_are_found(spark):
    """Copies with every 30th word changed, which are known without any chunk."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9)))
    rows, want = [], set()
    for n in range(0, 60, 2):
        words = [word() for _ in range(250)]
        rows.append((n, " ".join(words)))
        for at in range(rng.randrange(30), 250, 30):
            words[at] = word()
        rows.append((n + 1, " ".join(words)))
        want |= {(n, n + 1), (n + 1, n)}
    got = C.containments(spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA))
    assert {(r.doc_id, r.in_doc_id) for r in got.collect()} == want


def test_a_crowd_sends_only_what_is_asked_for(spark, monkeypatch):
    """Few short texts look up parts of a passage that 200 documents have and don't look up."""
    rng = random.Random(6)
    text = lambda n: " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(n))
    shared = text(300)
    part = shared[:600]
    rows = [(n, text(700) + " " + (shared if n % 2 else shared[500:])) for n in range(200)]
    rows += [(200, part + " " + text(20)), (201, part[:500] + " " + text(20)), (202, text(30)), (203, "short"), (None, "short")]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)
    sets = {i: dict(zip(r.digests, r.sizes)) for r in C.fingerprints(docs).collect() for i in [r.doc_id] if i is not None}
    inside = lambda a, b: a != b and sum(w for d, w in sets[a].items() if d in sets[b]) >= C.THRESHOLD * sum(sets[a].values())
    met, frame = [], type(docs)
    sort = frame.sortWithinPartitions
    monkeypatch.setattr(frame, "sortWithinPartitions", lambda self, *by, **how: met.append(self) or sort(self, *by, **how))
    for options in ({}, {"limit": 16, "block": 7}):
        got = {r.doc_id: r for r in C.links(docs, **options).collect() if r.doc_id is not None}
        for i in sets:
            assert (got[i].n_containing, got[i].n_contained) == (sum(inside(i, x) for x in sets), sum(inside(x, i) for x in sets))
        assert got[200].n_containing == got[201].n_containing == 101
    sent = met[0].selectExpr("count(*) AS n", "sum(length(k) + length(w)) AS size").first()
    assert sent.n < 300 and sent.size < 60_000  # whole documents to each: 367 and 184,702


def test_empty(spark):
    assert C.containments(spark.createDataFrame([], SCHEMA)).count() == 0
    assert not len(C.gear(np.zeros(0, np.uint8)))
