import random

import numpy as np
import pytest

from folioflow.llm import sentence_pieces as S


@pytest.fixture(scope="module")
def encoder():
    return S.Encoder(S.Vocabulary.load())


def test_whole_table_as_the_library(documents):
    assert S.mismatches(documents).count() == 0


def test_odd_texts_as_the_library(encoder):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=S.DEFAULT_MODEL)
    r = random.Random(3)
    texts = ["", " ", "  a  b\tc\n\n", "▁a ▁▁ b", "<s>hi</s> <0x0A>", "日本🎉", "a\x00b", "a" * 5000, "ﬁé"] + ["".join(r.choice("abe ▁\nthé🎉l") for _ in range(r.randint(1, 50))) for _ in range(500)]
    for t in texts:
        assert encoder.encode(t).tolist() == lib.encode(t)
        assert encoder.decode(encoder.encode(t)) == lib.decode(lib.encode(t))
    for _ in range(300):
        ids = [r.randrange(32000) if r.random() < 0.3 else r.randrange(259) for _ in range(8)]
        assert encoder.decode(np.array(ids)) == lib.decode(ids)


def test_cache_changes_nothing():
    v = S.Vocabulary.load()
    small, large = S.Encoder(v, cache=2), S.Encoder(v)
    t = "some words and some more words and some other words " * 5
    assert (small.encode(t) == large.encode(t)).all()


def test_round_trip_and_odd_rows(odd_docs, no_docs, documents):
    assert S.encode(documents).where("not round_trip").count() == 0
    rows = S.encode(odd_docs)
    got = {r.doc_id: r for r in rows.collect()}
    assert got[3].ids is None and got[3].n_tokens is None and got[4].ids == []
    assert rows.count() == odd_docs.count() and S.encode(no_docs).count() == 0
    texts = {r.doc_id: r.text for r in S.decode(rows).collect()}
    assert texts == {r.doc_id: r.text for r in odd_docs.collect()}
