import math
import unicodedata

import numpy as np

from folioflow.llm import quality_classifier as C
from folioflow.llm import quality_rules as R


def test_held_out_accuracy(spark):
    import pandas as pd

    sf = "/root/testdata/sf0.01"
    d = pd.read_parquet(f"{sf}/documents.parquet").merge(pd.read_parquet(f"{sf}/labels.parquet"), on="doc_id")
    w = C.train(C.sparse_rows(d.text[:250].tolist(), 18), d.quality[:250].tolist())
    s, _ = C.score_texts(d.text[250:].tolist(), w, 18)
    good = d.quality[250:].to_numpy() == 1
    assert ((s >= C.Params().threshold) == good).mean() > 0.95


def test_score_does_not_depend_on_the_batch(documents, labels):
    w = C.fit(documents, labels)
    texts = [r.text for r in documents.limit(30).collect()]
    one = np.array([C.score_texts([t], w, 18)[0][0] for t in texts])
    assert np.allclose(C.score_texts(texts, w, 18)[0], one)


M64 = (1 << 64) - 1


def mix(h):
    h ^= h >> 31
    h = h * 0xBF58476D1CE4E5B9 & M64
    return h ^ h >> 29


def run_hash(values):
    h = 0
    for v in values:
        h = (h * 0x9E3779B97F4A7C15 + v) & M64
    return mix((h + len(values)) & M64)


def lower(c):
    return ord(c.lower()) if len(c.lower()) == 1 else ord(c)


def brute_grams(text, bits):
    """The buckets of 1- and 2-grams, token by token, from their definition; no kernel of the operator takes part."""
    tokens, now, kind = [], [], None
    for c in [*(text or ""), " "]:
        k = "word" if unicodedata.category(c)[0] in "LN" else None if c.isspace() else "sign"
        if k != kind and now:
            tokens.append(run_hash(now))
            now = []
        kind = k
        if k:
            now.append(lower(c) if k == "word" else ord(c))
    pairs = [mix(mix((a * 0xD6E8FEB86659FD93 + b) & M64) ^ 0xA0761D6478BD642F) for a, b in zip(tokens, tokens[1:])]
    return [mix(h) >> 64 - bits for h in tokens + pairs]


def brute_features(text, bits):
    """{bucket: value} of the classifier, token by token."""
    classes = lambda c: 3 if c.isdigit() else (2 if c.isupper() else 1) if c.isalpha() else 16 + ord(c) if ord(c) < 128 else 9
    words, shapes = [], []
    for w in (text or "").split():
        h = run_hash([ord(c) for c in w])
        kinds = [classes(c) for c in w]
        shape = run_hash([k for i, k in enumerate(kinds) if not i or k != kinds[i - 1]])
        shapes.append(mix(shape + (bool(words) and words[-1] == h)))
        words.append(h)
    out = {1 << bits: 1.0}
    for salt, (hashes, n) in enumerate(((words, 1), (words, 2), (shapes, 1), (shapes, 2), (shapes, 3))):
        grams = []
        for i in range(n - 1, len(hashes)):
            g = hashes[i]
            for k in range(1, n):
                g = mix((g * 0xD6E8FEB86659FD93 + hashes[i - k]) & M64)
            grams.append(mix(g ^ (0x9E3779B97F4A7C15 * (salt + 1) & M64)) >> 64 - bits)
        for g in grams:
            out[g] = out.get(g, 0) + 1 / len(grams)
    return out


TEXTS = ["A plain text, with words and 12 numbers.", "x x x", "", None, "ÄÖ über 漢字 ***buy*** NOW!!", "one"]


def test_grams_against_plain_ones():
    for t in TEXTS:
        g, b = R.grams([t], 16)
        assert sorted(g.tolist()) == sorted(brute_grams(t, 16)) and b.tolist() == [0, len(g)]


def test_features_against_plain_ones():
    for t, (i, v) in zip(TEXTS, C.sparse_rows(TEXTS, 18)):
        want = brute_features(t, 18)
        assert set(i.tolist()) == set(want) and all(abs(want[k] - x) < 1e-6 for k, x in zip(i.tolist(), v.tolist()))


def test_training_against_a_plain_loop(documents, labels):
    """Follow-the-regularised-leader coordinate by coordinate, and scores as plain dot products."""
    p = C.Params(bits=12, epochs=2)
    quality = {r.doc_id: r.quality for r in labels.collect()}
    rows = [(r.text, quality[r.doc_id]) for r in documents.orderBy("doc_id").collect() if r.doc_id in quality and len(r.text) < 1500][:40]
    x, y = [brute_features(t, p.bits) for t, _ in rows], [q for _, q in rows]
    z, n = {}, {}

    def weight(i):
        a = z.get(i, 0.0)
        return 0.0 if abs(a) <= p.l1 else -(a - math.copysign(p.l1, a)) / ((p.beta + math.sqrt(n.get(i, 0.0))) / p.alpha + p.l2)

    rng = np.random.default_rng(7)
    for _ in range(p.epochs):
        for r in rng.permutation(len(rows)):
            w = {i: weight(i) for i in x[r]}
            q = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x[r].items())))
            for i, v in x[r].items():
                g = (q - y[r]) * v
                old = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / p.alpha * w[i]
                n[i] = old + g * g
    got = C.train(C.sparse_rows([t for t, _ in rows], p.bits), y, p)
    assert all(abs(got[i] - weight(i)) < 1e-4 for i in range(1 << p.bits))
    s, _ = C.score_texts([t for t, _ in rows], got, p.bits)
    for score, f in zip(s, x):
        assert abs(score - 1 / (1 + math.exp(-sum(got[i] * v for i, v in f.items())))) < 1e-6


def test_counts_and_scores_against_brute_force(documents, labels):
    p = R.Params()
    trusted = {r.doc_id for r in labels.where("quality = 1").collect()}
    rows = [(r, brute_grams(r.text, p.bits)) for r in documents.collect()]
    good, every = np.zeros(1 << p.bits), np.zeros(1 << p.bits)
    for r, grams in rows:
        np.add.at(every, grams, 1)
        if r.doc_id in trusted:
            np.add.at(good, grams, 1)
    a, b = R.counts(documents, labels, p)
    assert (a == good).all() and (b == every).all()
    lr = np.log((good + 1) / (good.sum() + len(good))) - np.log((every + 1) / (every.sum() + len(every)))
    want = {r.doc_id: round(float(np.mean(lr[grams])), 6) for r, grams in rows if grams}
    got = {r.doc_id: r for r in R.rate(documents, labels).collect()}
    assert all(abs(got[i].score - x) < 2e-6 and got[i].keep == (got[i].score >= p.threshold) for i, x in want.items())
    assert all(got[r.doc_id].n_grams == len(grams) for r, grams in rows)


def test_labels_joined_when_too_many(documents, labels):
    a = R.counts(documents, labels)
    b = R.counts(documents, labels, R.Params(max_ids=1))
    assert (a[0] == b[0]).all() and (a[1] == b[1]).all()


def test_odd_rows(spark, odd_docs, no_docs, labels):
    odd_labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 0), (4, None, None), (6, 0, 1), (99, 0, 0)], "doc_id bigint, quality int, toxic int")
    for f in (C.classify, R.rate):
        rows = f(odd_docs, odd_labels).collect()
        assert len(rows) == odd_docs.count() and all(r.keep is not None for r in rows)
        assert f(no_docs, odd_labels).count() == 0
        assert all(r.keep for r in f(odd_docs, odd_labels.where("false")).collect())
    kept = C.keep_good(odd_docs, labels)
    assert kept.schema.names == odd_docs.schema.names
    assert kept.where("doc_id in (3, 4)").count() == 2
    assert C.keep_good(no_docs, labels).count() == 0
