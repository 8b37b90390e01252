import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from kinweave.llm import simple8b as S
from kinweave.llm.bpe import encoder
from kinweave.llm.common import bytes_of

VALUE = st.one_of(st.just(0), st.integers(0, 3), st.integers(0, 50000), st.integers(0, (1 << 64) - 1))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(VALUE, max_size=700), min_size=1, max_size=5))
def test_round_trip_of_all_and_of_single_blocks(texts):
    values = np.array([v for t in texts for v in t], np.uint64)
    offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    words, word_offs, starts, blocks = S.pack(values, offs)
    assert word_offs[-1] == len(words)
    for i, t in enumerate(texts):
        own, own_starts = words[word_offs[i] : word_offs[i + 1]], starts[blocks[i] : blocks[i + 1]]
        assert S.unpack(own, own_starts, len(t)).tolist() == t
        for b, at in enumerate(own_starts):  # a block decodes from its own offset alone
            part = t[b * S.BLOCK : (b + 1) * S.BLOCK]
            assert S.unpack(own[at:], np.zeros(1, np.int64), len(part)).tolist() == part


def test_dense_and_sparse_words():
    pack = lambda v: S.pack(np.array(v, np.uint64), np.array([0, len(v)]))[0]
    assert len(pack([0] * 240)) == 1 and len(pack([1] * 60)) == 1 and len(pack([1 << 59])) == 1 and len(pack([1 << 63])) == 2
    assert len(pack([50000] * 3)) == 1 and len(pack([30000] * 4)) == 1


def test_documents_decode_to_their_ids(spark):
    texts = ["some plain text, twice some plain text", "", None, "é🙂\n" * 500, "word " * 5000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in S.encode_documents(docs).collect()}
    for i, t in enumerate(texts):
        if t is None:
            assert got[i].words is None and got[i].n_tokens is None and got[i].block_offsets is None
            continue
        buf, offs = bytes_of(pa.array([t]))
        ids = encoder().encoding.encode_ordinary(t)
        assert S.decode(got[i].words, got[i].block_offsets, got[i].n_tokens).tolist() == ids == encoder().encode(buf, offs)[0].tolist()
    assert S.total_bytes(S.encode_documents(docs)).first().n_bytes < 3 * sum(r.n_tokens or 0 for r in got.values())


def plain(values):
    """Value by value: the densest selector that holds the next values of the block; at a block's end it may hold fewer."""
    modes = [(0, 240, 0), (2, 60, 1), (3, 30, 2), (4, 20, 3), (5, 15, 4), (6, 12, 5), (7, 10, 6), (8, 8, 7), (9, 7, 8), (10, 6, 10), (11, 5, 12), (12, 4, 15), (13, 3, 20), (14, 2, 30), (15, 1, 60)]
    words, starts = [], []
    for at in range(0, len(values), 240):
        block = values[at : at + 240]
        starts.append(len(words))
        while block:
            for selector, count, width in modes:
                own = block[:count]
                if all(v < 1 << width for v in own):
                    words.append(selector << 60 | sum(v << width * j for j, v in enumerate(own)))
                    break
            else:
                own = block[:1]
                words += [1 << 60, own[0]]
            block = block[len(own) :]
    return words, starts


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(VALUE, st.integers(0, 300), st.just(1)), max_size=600))
def test_words_are_those_of_a_plain_encoder(values):
    words, _, starts, _ = S.pack(np.array(values, np.uint64), np.array([0, len(values)]))
    assert (words.tolist(), starts.tolist()) == plain(values)
