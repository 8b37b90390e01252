import random

from kinweave.llm.exact_dedup import exact_dedup

SCHEMA = "doc_id bigint, text string, lang string"


def test_one_row_of_each_text_by_either_way(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, *range(30)]), rng.choice([None, "", *"abcdefgh"]), rng.choice(["x", "y", None])) for _ in range(300)] + [(1000 + i, f"only {i}", "z") for i in range(200)]
    docs = spark.createDataFrame(rows, SCHEMA)
    order = lambda r: (r[0] is None, r[0] or 0, r[2] is not None, r[2] or "")
    want = sorted([min((r for r in rows if r[1] == t), key=order) for t in {r[1] for r in rows} - {None}] + [r for r in rows if r[1] is None], key=str)
    for limit in (1 << 20, 0):
        assert sorted((tuple(r) for r in exact_dedup(docs, limit=limit).collect()), key=str) == want
