import dataclasses
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioflow.llm import token_blocks as T


@given(st.lists(st.lists(st.integers(0, 300), max_size=200), max_size=4))
@settings(max_examples=25, deadline=None)
def test_blocks_round_trip(lists):
    blocks = [np.array(x, np.uint16) for x in lists]
    for b, p in zip(blocks, T.encode_blocks(blocks, 301)):
        assert (T.decode_block(p, len(b), 301) == b).all()


def test_counts_before_each_place():
    r = np.random.default_rng(0)
    x = (r.zipf(1.3, (3, 200)) % 40).astype(np.uint16)
    for c in (None, *T.contexts(x)):
        less, same, count = (T.seen(x, c).view(np.int16).reshape(3, 200, 4)[..., k] for k in range(3))
        for i in range(3):
            for t in range(200):
                before = [x[i, q] for q in range(t) if c is None or c[i, q] == c[i, t]]
                assert (less[i, t], same[i, t], count[i, t]) == (sum(b < x[i, t] for b in before), sum(b == x[i, t] for b in before), len(before))


def test_ids_beyond_the_vocabulary_are_refused():
    for ids, vocabulary in (([70000, 1], 100000), ([300], 300)):
        with pytest.raises(ValueError):
            T.encode_blocks([np.array(ids)], vocabulary)


def test_ids_are_those_of_ordinary_text(documents):
    import tiktoken

    ranks = T.load_ranks(T.DEFAULT_RANKS)
    plain, encode = tiktoken.Encoding("plain", pat_str=T.PATTERN, mergeable_ranks=ranks, special_tokens={}), T.tokenizer(ranks)
    for text in ["", "<|endoftext|> and <|endoftext|>", "a  b \n\n c\u00a0d 漢字 \U0001f600 it's", *(r.text for r in documents.limit(100).collect() if r.text)]:
        ids = encode(text)
        assert ids.dtype == np.uint16 and ids.tolist() == plain.encode_ordinary(text)
    with pytest.raises(ValueError):
        T.tokenizer({bytes([i]): i for i in range(255)} | {b"\xff": 1 << 16})


_ODD_TEXT = st.text(st.sampled_from("  \n\n\t\r\x0b\x0c\x1c\x85\xa0\u1680\u2003\u2028\u202f\u205f\u3000\u200bab's1.\u2026\u00e9\u0301\u6f22\U0001f600"), max_size=12)


@pytest.fixture(scope="module")
def encoders():
    import tiktoken

    ranks = T.load_ranks(T.DEFAULT_RANKS)
    return T.tokenizer(ranks), tiktoken.Encoding("plain", pat_str=T.PATTERN, mergeable_ranks=ranks, special_tokens={})


@given(_ODD_TEXT)
@settings(max_examples=500, deadline=None)
def test_texts_split_without_looking_ahead_have_the_same_ids(encoders, text):
    encode, plain = encoders
    white = [c.isspace() and c != "\x1c" for c in text]
    if any(a and b for a, b in zip(white, white[1:])):
        assert not T.single_spaced(text)
    assert encode(text).tolist() == plain.encode_ordinary(text)


def test_which_texts_are_split_without_looking_ahead():
    assert all(map(T.single_spaced, ["", " ", "a b\nc d", "\u00e9t\u00e9 \u00e0 Z\u00fcrich", "\u6f22 \u5b57 \U0001f600"]))
    assert not any(map(T.single_spaced, ["a  b", "a \n", "\t\tx", "a \u00a0b", "\u3000\u3000"]))


def test_counts_in_the_longest_blocks():
    r = np.random.default_rng(1)
    x = np.stack([r.integers(0, 50257, 32767), r.zipf(1.3, 32767) % 50, np.arange(32767), np.zeros(32767)]).astype(np.uint16)
    for c in (None, x % 2, x // 3):
        less, same, count = (T.seen(x, c).view(np.int16).reshape(*x.shape, 4)[..., k] for k in range(3))
        for i in range(4):
            for t in (0, 1, 63, 64, 8191, 8192, 20000, 32766):
                before = x[i, :t] if c is None else x[i, :t][c[i, :t] == c[i, t]]
                assert (less[i, t], same[i, t], count[i, t]) == ((before < x[i, t]).sum(), (before == x[i, t]).sum(), len(before))


def test_smaller_than_general_compressors(documents):
    import lzma

    import tiktoken

    e = tiktoken.Encoding("x", pat_str=T.PATTERN, mergeable_ranks=T.load_ranks(T.DEFAULT_RANKS), special_tokens={})
    ids = np.array(e.encode_ordinary("\n".join(r.text for r in documents.collect())), np.uint16)
    blocks = [ids[i : i + 8192] for i in range(0, len(ids) - 8192, 8192)]
    assert sum(map(len, T.encode_blocks(blocks, 50257))) < 0.95 * sum(len(lzma.compress(b.tobytes(), preset=9)) for b in blocks)


@pytest.mark.parametrize("n", [1, 64, 65, 5000])
def test_extreme_blocks(n):
    r = np.random.default_rng(n)
    blocks = [np.zeros(n), np.full(n, 50256), r.integers(0, 50257, n), np.tile(np.arange(9), n)[:n], r.zipf(1.2, n) % 50257]
    blocks = [b.astype(np.uint16) for b in blocks]
    payloads = T.encode_blocks(blocks, 50257)
    for b, p in zip(blocks, payloads):
        assert (T.decode_block(p, n, 50257) == b).all()
    if n == 5000:
        assert len(payloads[0]) < 40 and len(payloads[3]) < 150


def test_documents_round_trip_exactly(spark, documents):
    import tiktoken

    p = dataclasses.replace(T.Params(), block=2048, lanes=16)
    blocks = T.to_blocks(documents, p)
    rows = T.from_blocks(blocks, p).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.part, r.block, r.first)):
        assert r.first == len(got.setdefault(r.doc_id, []))
        got[r.doc_id] += r.ids
    e = tiktoken.Encoding("x", pat_str=T.PATTERN, mergeable_ranks=T.load_ranks(p.ranks), special_tokens={})
    for d in documents.collect():
        assert e.decode(got[d.doc_id]) == d.text


def test_checksum_is_of_the_ids(spark, documents):
    p = T.Params()
    r = T.to_blocks(documents.limit(20).coalesce(1), p).first()
    x = T.decode_block(bytes(r.payload), r.n_tokens, p.vocabulary)
    assert zlib.crc32(x.astype("<u2").tobytes()) == r.crc32
    broken = spark.createDataFrame([r.asDict() | {"crc32": r.crc32 ^ 1}], T.to_blocks(documents, p).schema)
    with pytest.raises(Exception, match="checksum"):
        T.from_blocks(broken, p).collect()


def test_odd_rows(odd_docs, no_docs):
    rows = T.to_blocks(odd_docs.coalesce(1)).collect()
    ids = [d.doc_id for r in rows for d in r.docs if d.first == 0]
    assert sorted(i for i in ids if i is not None) == [1, 2, 2, 3, 4, 5, 6, 7] and ids.count(None) == 1
    assert {d.n for r in rows for d in r.docs if d.doc_id in (3, 4)} == {0}
    assert T.to_blocks(no_docs).count() == 0
