import dataclasses
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioflow.llm import suffix_dedup as S


def check(t, memory, folder):
    position, lcp = [], []
    for a, b in S.induced(t, memory, folder):
        position += a.tolist()
        lcp += b.tolist()
    assert sorted(position) == [i for i in range(len(t)) if t[i]]
    zeros = np.flatnonzero(t == 0)
    suffix = [tuple(t[i : zeros[np.searchsorted(zeros, i)]][:56].tolist()) for i in position]
    assert suffix == sorted(suffix, reverse=True)
    for k in range(1, len(suffix)):
        n = next((i for i, (x, y) in enumerate(zip(suffix[k - 1], suffix[k])) if x != y), min(len(suffix[k - 1]), len(suffix[k])))
        assert min(lcp[k], 50) == min(n, 50)


@given(st.integers(1, 5), st.lists(st.integers(1, 80), min_size=1, max_size=6), st.integers(0, 10**6))
@settings(max_examples=60, deadline=None)
def test_induced_order_and_prefixes(alphabet, lengths, seed):
    r = np.random.default_rng(seed)
    parts = []
    for n in lengths:
        x = r.integers(1, alphabet + 1, n)
        parts += [*x, 0] + ([*x[n // 2 :], 0] if n > 1 else [])
    check(np.array(parts, np.uint8), 1 << 20, None)


def test_queues_on_disk(tmp_path):
    r = np.random.default_rng(0)
    parts = []
    for _ in range(40):
        parts += [*r.integers(1, 4, 60), 0]
    check(np.array(parts, np.uint8), 300, f"file://{tmp_path}/q")


def brute(docs, n):
    first, gone = {}, {}
    for i, t in sorted({(i, t) for i, t in docs if i is not None and t}):
        w = re.findall(r"[^\W_]+", t.lower())
        for k in range(len(w) - n + 1):
            key = tuple(w[k : k + n])
            if first.setdefault(key, (i, k)) != (i, k):
                gone.setdefault(i, set()).update(range(k, k + n))
    return gone


def words_of(rows):
    out = {}
    for r in rows:
        out.setdefault(r.doc_id, set()).update(range(r.start_word, r.stop_word))
    return out


def test_against_brute_force(spark, documents):
    docs = [(r.doc_id, r.text) for r in documents.collect()]
    assert words_of(S.spans(documents).collect()) == brute(docs, 50)


def test_small_shards_change_nothing(spark, documents):
    p = dataclasses.replace(S.Params(), shard=3000, memory=2000)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(S.spans(documents, p)) == key(S.spans(documents))


def test_other_lengths_of_passages(spark):
    """Passages of any length, also beyond those of the query."""
    r = np.random.default_rng(1)
    passage = " ".join(f"p{i}" for i in range(330))
    rows = [(i, " ".join(f"w{x}" for x in r.integers(0, 9999, 40)) + " " + " ".join(passage.split()[: (330 if i < 3 else 120)]) + " " + " ".join(f"w{x}" for x in r.integers(0, 9999, 40))) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    for n in (30, 64, 80, 300):
        assert words_of(S.spans(docs, S.Params(min_words=n)).collect()) == brute(rows, n), n


def test_parameters_are_checked():
    for bad in (dict(min_words=19), dict(gram=0), dict(min_words=70_000)):
        with pytest.raises(ValueError):
            S.Params(**bad)


def test_hot_owners_are_split(spark, documents, monkeypatch):
    """Windows of owners of many tiles take the other way, and nothing changes."""
    passage = " ".join(f"p{i}" for i in range(70))
    rows = [(i, f"start{i} of it {passage} end{i} of it {'' if i % 2 else 'more'} {passage}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    p = S.Params(hot=200)
    assert len(S._hot_owners(S.K.narrow(docs), p)) > 0
    assert words_of(S.spans(docs, p).collect()) == brute(rows, 50)
    few = dataclasses.replace(p, hot=3)
    assert words_of(S.spans(documents, few).collect()) == brute([(r.doc_id, r.text) for r in documents.collect()], 50)


def test_no_files_stay(spark, documents):
    from pathlib import Path
    from urllib.parse import urlparse

    folder = Path(urlparse(S.K.checkpoint_dir(spark)).path)
    S.spans(documents, dataclasses.replace(S.Params(), shard=3000, memory=2000)).collect()
    assert not list(folder.glob("suffix-*"))


def test_odd_rows(odd_docs, no_docs):
    rows = S.spans(odd_docs).collect()
    got = {(r.doc_id, r.start_word, r.stop_word, r.first_doc_id) for r in rows}
    assert (2, 2, 72, 1) in got
    assert any(d == 5 and f == 5 for d, _, _, f in got)  # a passage that repeats inside its own text
    assert {d for d, *_ in got} == {2, 5}
    assert S.spans(no_docs).count() == 0
