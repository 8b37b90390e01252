"""The registered queries against their SQL on the smallest tables, and what the driver asks of the entry module."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from kinweave.plans import audit_queries

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = [
    "exact_name_pairs", "shared_code_pairs", "jaccard_pairs", "knn_pairs", "candidate_union", "string_features", "name_flags", "threshold_metrics", "components", "trivial_clusters", "cluster_evidence", "canonical_names",
    "cluster_metrics", "two_phase_match", "contract_candidate_pairs", "entity_resolution", "doc_register_incremental", "text_normalize_ws", "unit_of_position", "mention_dedup", "context_window", "entity_normalize", "interval_regex_over_ner", "span_islands", "windowed_counts", *audit_queries.ORACLE,
]


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{DIR}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else f"{v:.9g}"
    return None if v is None else str(getattr(v, "replace", lambda **k: v)(tzinfo=None)) if hasattr(v, "tzinfo") else str(v)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sql, name):
    df = __spark_entry__.queries()[name](spark, DIR)
    cur = sql.execute(__spark_entry__.oracle_sql()[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    want = [tuple(plain(r[columns.index(c)]) for c in sorted(columns)) for r in cur.fetchall()]
    got = [tuple(plain(r[c]) for c in sorted(columns)) for r in df.collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["route_action", "n_clusters", "n_entities"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_imports_without_a_session_and_without_the_training_data_operators(tmp_path):
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(root, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and 'entity_resolution' in q and not any(n.startswith('op') for n in q), list(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True, env={**os.environ, "PYTHONPATH": ""})
