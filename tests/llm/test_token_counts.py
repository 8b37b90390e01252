import random

import pytest

from kinweave.llm import token_counts as T
from kinweave.llm.bpe import encoder


def brute(text, rule):
    """Sections (char start, end, tokens, crossing) by going through the bytes of each token."""
    raw = text.encode()
    starts = [0, *(i + 1 for i, b in enumerate(raw) if b == 10)] if raw else []
    starts = [s for s in starts if s < len(raw)]
    section = lambda b: max(i for i, s in enumerate(starts) if s <= b)
    n, crossing, at = [0] * len(starts), [0] * len(starts), 0
    for i in encoder().encoding.encode_ordinary(text):
        size = int(encoder().byte_length[i])
        held = [section(b) for b in range(at, at + size)]
        own = held[0] if rule == "start" else held[-1] if rule == "end" else max(sorted(set(held)), key=held.count)
        n[own] += 1
        crossing[own] += len(set(held)) > 1
        at += size
    ends = [*starts[1:], len(raw)]
    chars = lambda b: len(raw[:b].decode())
    return [(i, chars(s), chars(e), n[i], crossing[i]) for i, (s, e) in enumerate(zip(starts, ends))]


@pytest.mark.parametrize("rule", T.RULES)
def test_sections_are_those_of_brute_force(spark, rule):
    rng = random.Random(2)
    texts = ["".join(rng.choice(["word", " ", "\n", "\n\n", "\n\n\n  ", "é", "🙂", ".", "x1"]) for _ in range(rng.randint(0, 60))) for _ in range(60)] + ["", None, "\n", "\n\n\n\n", "a\n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {}
    for r in T.section_tokens(docs, rule=rule).collect():
        got.setdefault(r.doc_id, []).append((r.section, r.char_start, r.char_end, r.n_tokens, r.n_crossing))
    for i, t in enumerate(texts):
        assert sorted(got.get(i, [])) == (brute(t, rule) if t else [])
        assert sum(x[3] for x in got.get(i, [])) == (len(encoder().encoding.encode_ordinary(t)) if t else 0)


def test_unknown_rule(spark):
    with pytest.raises(ValueError):
        T.section_tokens(spark.createDataFrame([], "doc_id bigint, text string"), rule="x")


def test_fields_against_brute_force(spark):
    """Sections with gaps, touching ones, empty ones and ones beyond the text, by every rule."""
    rng = random.Random(3)
    rows = [(n, "".join(rng.choices(["word ", "é", "🙂", "longerword", "\n", "12345"], k=rng.randint(0, 60))), "x") for n in range(40)] + [(None, "text of a null id", "x"), (0, "another row of id 0", "x"), (41, None, "x")]
    sections = []
    for i, t, _ in rows[:41] + [rows[42]]:
        cuts = sorted(rng.choices(range((len(t or "") or 1) + 5), k=8))
        sections += [(i, f"s{k}", a, b) for k, (a, b) in enumerate(zip(cuts[::2], cuts[1::2]))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, section string")
    table = spark.createDataFrame([*sections, (999, "no document", 0, 3)], "doc_id bigint, section string, char_start int, char_end int")
    enc = encoder().encoding
    for rule in T.RULES:
        want = []
        for i, t, _ in rows:
            t = t or ""
            own = [(n, min(a, len(t)), min(b, len(t))) for d, n, a, b in sections if d == i]
            spans = [(n, len(t[:a].encode()), len(t[:b].encode())) for n, a, b in own]
            parts, at = [], 0
            for n, a, b in sorted((x for x in spans if x[2] > x[1]), key=lambda x: x[1:]):
                if a > at:
                    parts.append((None, at, a))
                parts.append((n, a, b))
                at = b
            parts.append((None, at, len(t.encode()))) if len(t.encode()) > at else None
            counts, place = {n: [0, 0] for n, _, _ in own}, 0
            for token in enc.encode_ordinary(t):
                end = place + len(enc.decode_single_token_bytes(token))
                over = [(min(b, end) - max(a, place), -k, n) for k, (n, a, b) in enumerate(parts) if a < end and place < b]
                best = max(over) if rule == "majority" else over[0 if rule == "start" else -1]
                if best[2] is not None:
                    counts[best[2]][0] += 1
                    counts[best[2]][1] += len(over) > 1
                place = end
            want += [(i, n, a, max(a, b), *counts[n]) for n, a, b in own]
        got = [tuple(r) for r in T.field_tokens(docs, table, rule=rule).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert T.field_tokens(docs, table.limit(0)).count() == 0
