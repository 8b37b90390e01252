import random
from collections import Counter

from kinweave.llm import line_dedup as L
from kinweave.llm.common import text_hash

SCHEMA = "doc_id bigint, text string, n_chars int, lines string"


def corpus(seed=2):
    rng = random.Random(seed)
    line = lambda: " ".join(f"w{rng.randrange(5000)}" for _ in range(rng.randint(1, 6)))
    shared = [[line() for _ in range(rng.randint(1, 5))] for _ in range(12)]
    rows = []
    for n in range(80):
        lines = ["All rights reserved"] * (n % 3 > 0) + [line() for _ in range(rng.randint(0, 8))]
        for _ in range(rng.choice([0, 1, 2])):
            at = rng.randint(0, len(lines))
            lines[at:at] = rng.choice(shared)
        rows.append((n, rng.choice(["\n", "\n\n", " \n"]).join(lines)))
    return rows + [(80, None), (81, ""), (82, "\n\n"), (83, rows[4][1]), (None, rows[9][1]), (4, rows[4][1]), (84, rows[20][1] + "\n"), (85, rows[21][1] + "\nnew")]


def matched(a, b):
    """Patience diff by its definition: equal ends, then the longest increasing run of lines that occur once in either, then the gaps."""
    if not a or not b:
        return []
    if a[0] == b[0]:
        return [(0, 0), *((i + 1, j + 1) for i, j in matched(a[1:], b[1:]))]
    if a[-1] == b[-1]:
        return [*matched(a[:-1], b[:-1]), (len(a) - 1, len(b) - 1)]
    once = [(a.index(x), j) for j, x in enumerate(b) if x and a.count(x) == b.count(x) == 1]
    best = {}  # longest chain that ends with each pair, by plain dynamic programming
    for i, j in sorted(once):
        best[i, j] = max((best[p] for p in best if p[0] < i and p[1] < j), key=len, default=[]) + [(i, j)]
    if not best:
        return []
    size = max(map(len, best.values()))
    chains = [c for c in best.values() if len(c) == size]
    chain = min(chains, key=lambda c: [j for _, j in reversed(c)])  # of equals, the one that patience sorting leaves: smallest ends
    out, at = [], (0, 0)
    for i, j in [*chain, (len(a), len(b))]:
        out += [(at[0] + x, at[1] + y) for x, y in matched(a[at[0] : i], b[at[1] : j])]
        if i < len(a):
            out.append((i, j))
        at = (i + 1, j + 1)
    return out


def common_blocks(a, b, rare):
    pairs, gone = set(matched(a, b)), set()
    for i, j in pairs:
        if (i - 1, j - 1) in pairs:
            continue
        block = [j]
        while (i + len(block), j + len(block)) in pairs:
            block.append(j + len(block))
        if any(b[k] in rare for k in block) or sum(b[k] != "" for k in block) >= L.RUN:
            gone.update(block)
    return gone


def brute(rows, hashes):
    """Deletions over all pairs of documents."""
    key = lambda i, t: (i is None, i or 0, hashes[t])
    docs = {key(i, t): [x.strip() for x in (t[:-1] if t.endswith("\n") else t).split("\n")] for i, t in rows if t}
    lists = {tuple(d) for d in docs.values()}
    df = Counter(x for d in lists for x in set(d) - {""})
    rare = {x for x, n in df.items() if n <= L.RARE}
    out = {}
    for k, b in docs.items():
        gone = set()
        for f, a in docs.items():
            if f < k and set(a) & set(b):
                gone |= set(range(len(b))) if a == b and (set(b) & rare or sum(x != "" for x in b) >= L.RUN) else common_blocks(a, b, rare)
        if gone:
            out[k] = sorted(gone)
    return out


def test_deletions_are_those_of_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, -1, "x") for i, t in rows], SCHEMA)
    hashes = {r.text: r.h for r in docs.select("text", text_hash("text").alias("h")).collect()}
    want = brute(rows, hashes)
    got = {(r.doc_id is None, r.doc_id or 0, r.h): list(r.lines) for r in L.deletions(docs).collect()}
    assert got == want and len(got) > 20
    left = L.line_dedup(docs)
    assert left.columns == docs.columns
    expected = []
    for i, t in rows:
        gone = want.get((i is None, i or 0, hashes[t]))
        kept = t if not gone else L.delete_lines(t, gone)
        if not gone or kept.strip():
            expected.append((i, kept))
    order = lambda x: (x[0] is None, x[0] or 0, x[1] or "")
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=order) == sorted(expected, key=order)
    texts = [r.text for r in left.collect()]
    assert any("All rights reserved" in (t or "") for t in texts)


def test_patience():
    assert L.patience([1, 2, 3, 9, 4], [7, 1, 2, 3, 8, 4]) == [(0, 1), (1, 2), (2, 3), (4, 5)]
    assert L.patience([1, 1, 1], [1, 1]) == [(0, 0), (1, 1)]
    assert L.patience([5, 1, 2], [1, 2, 5]) == [(1, 0), (2, 1)]
    assert L.patience([], [1]) == []


def test_empty(spark):
    assert L.line_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def left_of(spark, texts):
    docs = spark.createDataFrame([(i, t, -1, "x") for i, t in enumerate(texts)], SCHEMA)
    return {r.doc_id: r.text for r in L.line_dedup(docs).collect()}


def test_a_document_is_aligned_with_all_earlier_ones(spark):
    p, q = ["p one", "p two", "p three"], ["q one", "q two"]
    texts = ["\n".join(x) for x in (p + q, q + p, ["new", *q, *p])]
    assert left_of(spark, texts) == {0: texts[0], 1: "\n".join(q), 2: "new"}


def test_deletions_are_those_of_all_pairs(spark):
    rng = random.Random(6)
    pool = [f"line {i}" for i in range(60)]
    rows = []
    for n in range(150):
        lines = [x for at in rng.choices(range(60), k=rng.randint(1, 4)) for x in pool[at : at + rng.randint(1, 4)]]
        for _ in range(rng.randint(0, 3)):
            lines.insert(rng.randint(0, len(lines)), rng.choice(["", "common", f"own {n}"]))
        rows.append((n, "\n".join(["start", *lines])))
    docs = spark.createDataFrame([(i, t, -1, "x") for i, t in rows], SCHEMA)
    want = brute(rows, {t: 0 for _, t in rows})
    got = {(False, r.doc_id, 0): list(r.lines) for r in L.deletions(docs).collect()}
    assert got == want and len(want) > 100


def test_large_groups_of_copies_go(spark):
    """More than RARE copies and near copies; single boilerplate lines stay."""
    copy = "\n".join(f"c {i}" for i in range(5))
    near = [f"n 0\nn 1\nn 2\nedit {i}\nn 3\nn 4\nn 5" for i in range(30)]
    short = ["All rights reserved\nown " + str(i) for i in range(30)] + ["All rights reserved"] * 2
    texts = [copy] * 30 + near + short
    want = {0: copy, 30: near[0]} | {30 + i: f"edit {i}" for i in range(1, 30)} | {60 + i: t for i, t in enumerate(short)}
    assert left_of(spark, texts) == want
