import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kinweave.llm import merge_replay as M

SCHEMA = "doc_id bigint, text string, ids string, exact int"
TEXTS = ["", "hello world", "aaaaaaaaaaaaa", "It's  the \n\n end\t.", "naïve café — 東京 🎉", "abababab ababab", " <|endoftext|> x", "1234567 89", "x" * 5000, "   a b", "   lead", "trail   "]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(M.DEFAULT_MERGES)
    t.encode_special_tokens = True
    return t


def encode(texts):
    corpus = M.Corpus(M.merges())
    corpus.add(pa.RecordBatch.from_pydict({"t": pa.array(texts, pa.string())}), 0)
    (_, ids, at, same), = corpus.encode()
    assert same.all()
    return [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])]


def test_ids_are_the_librarys(library):
    assert encode(TEXTS) == [library.encode(t, add_special_tokens=False).ids for t in TEXTS]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("aabbc  \n'st1é"), st.characters(exclude_categories=["Cs"])), max_size=40), min_size=1, max_size=6))
def test_any_text(library, texts):
    got = encode(texts)
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]
    for t, ids in zip(texts, got):
        assert M.merges().decode(np.array(ids, np.int64)).tobytes().decode() == t


@pytest.mark.parametrize("known", [0, M.KNOWN_BYTES])
def test_rows(spark, known):
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(99, None, "x", 1), (None, "hello world", None, None), (1, "hello world", "x", 1)]
    out = M.encode_documents(spark.createDataFrame(rows, SCHEMA), corpus_bytes=100, known_bytes=known)
    got = out.select("doc_id", "ids", "n_tokens", "exact", M.decode(out.ids).alias("back")).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id == 99:
            assert r.ids is None and r.n_tokens is None and r.exact is None and r.back is None
        else:
            assert r.exact and r.n_tokens == len(r.ids)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.back) for r in got if r.doc_id != 99) == sorted((i if i is not None else -1, t) for i, t, *_ in rows if i != 99)


def test_empty(spark):
    assert M.encode_documents(spark.createDataFrame([], SCHEMA)).count() == 0
