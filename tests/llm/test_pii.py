import math

import numpy as np
import pytest

from folioflow.llm import pii as P


@pytest.fixture(scope="module")
def model():
    return P.train()


def spans(text, model, p=P.Params()):
    return P.spans_of(*P.label_texts([text], model, p), p.min_length)[0]


def test_held_out_accuracy(model):
    r = np.random.default_rng(1234)
    data = [P.sample(r, 300, 0.05) for _ in range(300)]
    x, y = np.concatenate([a for a, _ in data]), np.stack([b for _, b in data])
    some, got = P._decode(x, np.arange(300) * 300, np.full(300, 300), model)
    out = np.zeros_like(y)
    out[some] = got.T
    assert (out == y).mean() > 0.99
    assert ((out > 0) & (y > 0)).sum() > 0.97 * (y > 0).sum() and ((out > 0) & (y > 0)).sum() > 0.97 * (out > 0).sum()


def test_bound_skips_only_windows_without_labels(model):
    r = np.random.default_rng(5)
    data = [P.sample(r, 200, 0.02)[0] for _ in range(100)]
    x = np.concatenate(data)
    some, got = P._decode(x, np.arange(100) * 200, np.full(100, 200), model)
    tr = model["tr"] - model["tr"][0, 0]
    e = np.zeros((200, P._K - 1, 100), np.float32) + (model["bias"][1:] - model["bias"][0])[:, None]
    for d in "fb":
        P._run_lstm(model["x" + d], model["u" + d], model["e" + d][:, 1:] - model["e" + d][:, :1], x, np.arange(100) * 200, np.full(200, 100), e, d == "b")
    full = np.zeros((200, 100, P._K), np.float32)
    full[:, :, 1:] = e.transpose(0, 2, 1)
    every = P._viterbi(full, np.full(100, 200), tr)
    assert set(np.flatnonzero((every > 0).any(0))) <= set(some.tolist())
    assert (every[:, some] == got).all()


def plain_labels(text, w):
    """The best path by single steps over one text, in double precision."""
    ids = P.char_ids(text)
    n = w["uf"].shape[0]
    sides = []
    for d, order in (("f", range(len(ids))), ("b", range(len(ids) - 1, -1, -1))):
        h, c = [0.0] * n, [0.0] * n
        out = {}
        u, x = w["u" + d].astype(float), w["x" + d].astype(float)
        for t in order:
            z = [x[ids[t], k] + sum(h[j] * u[j, k] for j in range(n)) for k in range(4 * n)]
            gate = [1 / (1 + math.exp(-v)) for v in z[: 3 * n]] + [math.tanh(v) for v in z[3 * n :]]
            c = [gate[n + k] * c[k] + gate[k] * gate[3 * n + k] for k in range(n)]
            h = [gate[2 * n + k] * math.tanh(c[k]) for k in range(n)]
            out[t] = h
        sides.append(out)
    kinds = range(len(P.KINDS))
    score, back = None, []
    for t in range(len(ids)):
        e = [w["bias"][k] + sum(sides[0][t][j] * w["ef"][j, k] + sides[1][t][j] * w["eb"][j, k] for j in range(n)) for k in kinds]
        if score is None:
            score = e
            continue
        best = [max(kinds, key=lambda a: score[a] + w["tr"][a, b]) for b in kinds]
        back.append(best)
        score = [score[best[b]] + w["tr"][best[b], b] + e[b] for b in kinds]
    path = [max(kinds, key=lambda k: score[k])]
    for best in reversed(back):
        path.append(best[path[-1]])
    return path[::-1]


def test_labels_against_single_steps(model):
    texts = ["Write to ann.lee@mail4.example.com or call (212) 555-0184 today.", "Nothing of it here, but 12 of them in 2021.", 'token = "0123456789abcdef0123456789abcdef" and 10.20.30.40 there', "x", "password: q8Zk3LmP0aa1 end, card 4111 1111 1111 1111."]
    labels, bounds = P.label_texts(texts, model)
    assert [labels[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [plain_labels(t, model) for t in texts]


def test_gradients():
    p = P.Params(hidden=3)
    r = np.random.default_rng(0)
    e, y, tr = r.normal(size=(6, 2, P._K)), r.integers(0, P._K, (6, 2)), r.normal(size=(P._K, P._K))
    _, de, dtr = P._crf(e, y, tr)
    for a, g in ((e, de), (tr, dtr)):
        i = tuple(r.integers(0, s) for s in a.shape)
        a[i] += 1e-5
        up = P._crf(e, y, tr)[0]
        a[i] -= 2e-5
        down = P._crf(e, y, tr)[0]
        a[i] += 1e-5
        assert abs((up - down) / 2e-5 - g[i]) < 1e-5
    assert p.hidden == 3


def test_spans_in_long_texts_are_found_wherever_windows_meet(model):
    for lead in (0, 380, 440, 500, 900, 30_000):
        text = ("the reader of this line goes on and " * 1000)[:lead] + " hsr.29@mail5.example.com and so on with the rest of it " + "more of the same " * 40
        got = spans(text, model)
        assert [text[a:b] for a, b, _ in got] == ["hsr.29@mail5.example.com"], lead


def test_clean_text_is_left_alone(model, documents):
    text = "Nothing in these lines is private. There are 12 of them, from 2021, and they cost $4.50 each.\nThat is all."
    assert spans(text, model) == []
    assert P.mask(text, []) is text


def test_odd_rows(odd_docs, no_docs, model):
    rows = P.find(odd_docs).collect()
    assert [r.doc_id for r in rows] == [5] and "<EMAIL>" in rows[0].text and "me.here" not in rows[0].text
    out = P.redact(odd_docs)
    assert out.schema.names == odd_docs.schema.names and out.count() == odd_docs.count()
    assert P.find(no_docs).count() == 0 and P.redact(no_docs).count() == 0
    assert out.where("doc_id is null").count() == 1
