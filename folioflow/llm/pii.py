"""Private data: a character-level bidirectional LSTM with CRF transitions, trained in numpy from labelled spans.

Labels are one kind per character (0: none). Training samples are made here: prose and junk of invented words with
inserted e-mail addresses, telephone numbers, IP addresses, card numbers, social security numbers and secrets, whose spans
are known, and with numbers, dates, versions and links that are none of these. Training is deterministic and runs once a
process.

A text is cut into windows of ``window`` characters that overlap by ``overlap``. All windows of a batch advance in step,
longest first. A bound over each window of what an excursion from none to any kinds can gain tells windows whose best path is
all none; the others are decoded by Viterbi. Neighbouring windows are reconciled at the middle
of their overlap, and runs of a kind over the whole text become spans, at least ``min_length`` long.

Defined cases: a null or empty text has no spans; a null doc_id stays null; rows that repeat are each reported; an empty
table gives no rows; very long texts are windowed whole; other columns are kept by ``redact`` and ignored by ``find``.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as K

KINDS = ("none", "email", "phone", "ip", "card", "ssn", "secret")
_K = len(KINDS)
_ALPHABET = 101


@dataclass(frozen=True)
class Params:
    hidden: int = 8
    steps: int = 600
    batch: int = 64
    length: int = 112
    rate: float = 0.02
    seed: int = 5
    window: int = 512
    overlap: int = 96
    min_length: int = 5
    lanes: int = 1024
    prior: float = 2.0  # cost of a span beyond that from training, whose samples are denser than texts


@functools.cache
def _ids() -> np.ndarray:
    out = np.full(0x3000, 100, np.uint8)
    for c in range(0x3000):
        ch = chr(c)
        if 32 <= c < 127:
            out[c] = c - 32
        elif ch == "\n":
            out[c] = 95
        elif ch.isspace():
            out[c] = 96
        elif ch.isdigit():
            out[c] = 97
        elif ch.isupper():
            out[c] = 98
        elif ch.isalpha():
            out[c] = 99
    return out


def char_ids(text: str) -> np.ndarray:
    return _ids()[np.minimum(K.codes(text), 0x2FFF)]


# --- labelled spans -------------------------------------------------------------------------------------------------

_SYLLABLES = "th the re on an er in ti at en ou es st ion ing ed le la un eau é è ç eux que de la el ción os ar mi ñ í der und sch ö ü ß keit ung ver ge be ch pf a e i o u ra ne lo si ta ku mo ri".split()


def _word(r: np.random.Generator) -> str:
    if r.random() < 0.3:
        return _from(r, _LOW, int(r.integers(1, 14)))
    return "".join(_SYLLABLES[i] for i in r.integers(0, len(_SYLLABLES), r.integers(1, 5)))


def _digits(r: np.random.Generator, n: int) -> str:
    return "".join(map(str, r.integers(0, 10, n)))


def _hex(r: np.random.Generator, n: int) -> str:
    return "".join("0123456789abcdef"[i] for i in r.integers(0, 16, n))


def _from(r: np.random.Generator, letters: str, n: int) -> str:
    return "".join(letters[i] for i in r.integers(0, len(letters), n))


_LOW, _UP = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def private(r: np.random.Generator) -> tuple[str, str, str, int]:
    """(before, value, after, kind)"""
    kind = int(r.integers(1, _K + 2))
    kind = 6 if kind >= 6 else kind
    d = lambda n: _digits(r, n)
    if kind == 1:
        name = [_from(r, _LOW, int(r.integers(2, 9))) if r.random() < 0.5 else _word(r) for _ in range(2)]
        user = [name[0] + "." + d(2), name[0] + "." + name[1], name[0], name[0] + d(int(r.integers(1, 4))), name[0] + "_" + name[1], name[0] + "+" + name[1]][r.integers(0, 6)]
        host = [f"mail{r.integers(0, 10)}.example.com", f"{_from(r, _LOW, int(r.integers(3, 9)))}.com", f"{_from(r, _LOW, 5)}.{_from(r, _LOW, 4)}.org", f"{_from(r, _LOW, 6)}-{_from(r, _LOW, 3)}.net", f"{_from(r, _LOW, 7)}.co.uk"][r.integers(0, 5)]
        return "", f"{user}@{host}", "", 1
    if kind == 2:
        return "", [f"+1 ({d(3)}) {d(3)}-{d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"+1 ({d(3)}) 555-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"+1 {d(3)} {d(3)} {d(4)}", f"+{r.integers(20, 99)} {d(2)} {d(4)} {d(4)}", f"+1-{d(3)}-{d(3)}-{d(4)}"][r.integers(0, 7)], "", 2
    if kind == 3:
        return "", ".".join(str(x) for x in r.integers(0, 256, 4)), "", 3
    if kind == 4:
        p = str(r.integers(3, 7))
        x = p + d(15)
        return "", x if r.random() < 0.6 else [" ", "-"][r.integers(0, 2)].join(x[i : i + 4] for i in range(0, 16, 4)), "", 4
    if kind == 5:
        return "", f"{d(3)}-{d(2)}-{d(4)}", "", 5
    q = r.random()
    if q < 0.3:
        return "", "AKIA" + _from(r, _UP + "0123456789", 16), "", 6
    if q < 0.6:
        key = ["token", "api_key", "secret", "key", "auth"][r.integers(0, 5) if r.random() < 0.5 else 0]
        return f'{key} = "', _hex(r, [32, 40, 40, 64][r.integers(0, 4)]), '"', 6
    if q < 0.85:
        return ["password=", "password: ", "pwd=", "secret="][r.integers(0, 4) if r.random() < 0.5 else 0], _hex(r, int(r.integers(12, 25))) if r.random() < 0.7 else _from(r, _LOW + _UP + "0123456789", int(r.integers(10, 22))), "", 6
    return "", ["sk-", "ghp_", "xoxb-"][r.integers(0, 3)] + _from(r, _LOW + _UP + "0123456789", int(r.integers(20, 40))), "", 6


def harmless(r: np.random.Generator) -> str:
    d = lambda n: _digits(r, n)
    return [
        lambda: d(int(r.integers(1, 6))), lambda: f"{r.integers(1900, 2030)}", lambda: f"{r.integers(1900, 2030)}-{d(2)}-{d(2)}", lambda: f"{d(2)}/{d(2)}/{r.integers(1900, 2030)}", lambda: f"v{d(1)}.{d(1)}", lambda: f"{d(1)}.{d(2)}.{d(1)}", lambda: f"{d(2)}:{d(2)}",
        lambda: f"{d(2)},{d(3)}", lambda: f"${d(2)}.{d(2)}", lambda: f"#{d(4)}", lambda: f"https://{_word(r)}.example.com/{_word(r)}", lambda: f"({d(1)})", lambda: f"{d(2)}%", lambda: "password", lambda: "the token", lambda: f"{_word(r)}.{_word(r)}",
        lambda: f"{_word(r)} = {_word(r)}", lambda: f"version {d(1)}", lambda: f"<{_word(r)}>", lambda: f"@{_word(r)}", lambda: f"{_word(r)}-{_word(r)}", lambda: f"{_from(r, _UP, 4)}", lambda: f"{d(1)}-{d(1)}", lambda: f"{_word(r)}{d(int(r.integers(1, 5)))}",
        lambda: " ".join(f"{w}{k}" for w, k in [(_word(r), int(r.integers(0, 90)))] for k in range(k, k + 4)), lambda: " ".join(d(int(r.integers(1, 4))) for _ in range(5)), lambda: f"{_word(r)}_{_word(r)}{d(2)}",
    ][r.integers(0, 27)]()


def sample(r: np.random.Generator, length: int, rate: float = 0.07) -> tuple[np.ndarray, np.ndarray]:
    """Ids and labels of ``length`` characters."""
    style = r.integers(0, 8)
    parts, labels = [], []

    def put(s: str, k: int = 0) -> None:
        parts.append(s)
        labels.append(np.full(len(s), k, np.uint8))

    n, skip = 0, int(r.integers(0, 40))
    same = _word(r)
    while n < length + skip + 8:
        at = len(parts)
        x = r.random()
        if x < rate:
            a, v, b, k = private(r)
            put(a)
            put(v, k)
            put(b)
        elif x < rate * 1.7:
            put(harmless(r))
        else:
            w = _word(r)
            if style == 1:
                w = w.upper() + "!!"
            elif style == 2:
                w += ["***", "$$$", "&&&", "###", "%%%"][r.integers(0, 5)]
            elif style == 3:
                w += " |"
            elif style == 4:
                w = same
            elif r.random() < 0.15:
                w = w.capitalize()
            put(w)
        q = r.random()
        put(", " if q < 0.06 else ". " if q < 0.13 else ".\n" if q < 0.16 else "\n" if q < 0.18 else " ")
        n += sum(map(len, parts[at:]))
    text, y = "".join(parts), np.concatenate(labels)
    if (x := r.random()) < 0.2:
        skip = 0
    elif x < 0.5:  # the end of a text, mostly that of a sentence
        text = text.rstrip(" ,\n")
        if r.random() < 0.6 and not y[len(text) - 1] and text[-1] != ".":
            text, y = text + ".", np.append(y[: len(text)], 0)
        skip = len(text) - length if len(text) >= length else 0
    return char_ids(text)[skip : skip + length], y[skip : skip + length]


# --- model ----------------------------------------------------------------------------------------------------------


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _forward(x: np.ndarray, u: np.ndarray, ids: np.ndarray) -> dict[str, np.ndarray]:
    t, b = ids.shape
    n = u.shape[0]
    g, c, h, tc = np.empty((t, b, 4 * n), np.float32), np.zeros((t + 1, b, n), np.float32), np.zeros((t + 1, b, n), np.float32), np.empty((t, b, n), np.float32)
    for i in range(t):
        z = x[ids[i]] + h[i] @ u
        z[:, : 3 * n] = _sigmoid(z[:, : 3 * n])
        z[:, 3 * n :] = np.tanh(z[:, 3 * n :])
        g[i] = z
        c[i + 1] = z[:, n : 2 * n] * c[i] + z[:, :n] * z[:, 3 * n :]
        tc[i] = np.tanh(c[i + 1])
        h[i + 1] = z[:, 2 * n : 3 * n] * tc[i]
    return {"g": g, "c": c, "h": h, "tc": tc}


def _backward(s: dict[str, np.ndarray], u: np.ndarray, ids: np.ndarray, dh_out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    t, b = ids.shape
    n = u.shape[0]
    dz_all = np.empty((t, b, 4 * n), np.float32)
    dh, dc = np.zeros((b, n), np.float32), np.zeros((b, n), np.float32)
    for i in range(t - 1, -1, -1):
        z, tc = s["g"][i], s["tc"][i]
        gi, gf, go, gc = z[:, :n], z[:, n : 2 * n], z[:, 2 * n : 3 * n], z[:, 3 * n :]
        dh = dh + dh_out[i]
        dc = dc + dh * go * (1 - tc * tc)
        dz = dz_all[i]
        dz[:, :n] = dc * gc * gi * (1 - gi)
        dz[:, n : 2 * n] = dc * s["c"][i] * gf * (1 - gf)
        dz[:, 2 * n : 3 * n] = dh * tc * go * (1 - go)
        dz[:, 3 * n :] = dc * gi * (1 - gc * gc)
        dc = dc * gf
        dh = dz @ u.T
    du = np.einsum("tbn,tbm->nm", s["h"][:-1], dz_all, optimize=True)
    dx = np.zeros((_ALPHABET, 4 * n), np.float32)
    order = np.argsort(ids.ravel(), kind="stable")
    flat = ids.ravel()[order]
    first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    dx[flat[first]] = np.add.reduceat(dz_all.reshape(-1, 4 * n)[order], first, axis=0)
    return dx, du


def _logsumexp(a: np.ndarray, axis: int) -> np.ndarray:
    m = a.max(axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(a - m).sum(axis))


def _crf(e: np.ndarray, y: np.ndarray, tr: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log-likelihood, and its gradients by the emissions and transitions."""
    t, b, _ = e.shape
    alpha, beta = np.empty_like(e), np.zeros_like(e)
    alpha[0] = e[0]
    for i in range(1, t):
        alpha[i] = e[i] + _logsumexp(alpha[i - 1][:, :, None] + tr, 1)
    for i in range(t - 2, -1, -1):
        beta[i] = _logsumexp(tr + (e[i + 1] + beta[i + 1])[:, None, :], 2)
    z = _logsumexp(alpha[-1], 1)
    de = np.exp(alpha + beta - z[None, :, None])
    pair = np.exp(alpha[:-1, :, :, None] + tr + (e[1:] + beta[1:])[:, :, None, :] - z[None, :, None, None]).sum((0, 1))
    rows, cols = np.arange(t)[:, None], np.arange(b)
    gold = e[rows, cols, y].sum(0) + tr[y[:-1], y[1:]].sum(0)
    de[rows, cols, y] -= 1
    np.add.at(pair, (y[:-1], y[1:]), -1)
    return float((z - gold).mean()), de / b, pair / b


@functools.cache
def train(p: Params = Params()) -> dict[str, np.ndarray]:
    r = np.random.default_rng(p.seed)
    n = p.hidden
    w = {k: (r.normal(size=s) * q).astype(np.float32) for k, s, q in (("xf", (_ALPHABET, 4 * n), 0.3), ("xb", (_ALPHABET, 4 * n), 0.3), ("uf", (n, 4 * n), n**-0.5), ("ub", (n, 4 * n), n**-0.5), ("ef", (n, _K), 0.3), ("eb", (n, _K), 0.3), ("bias", (_K,), 0.0), ("tr", (_K, _K), 0.01))}
    for k in ("xf", "xb"):
        w[k][:, n : 2 * n] += 1
    w["bias"][0] = 2
    m1, m2 = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}
    pool = [sample(r, p.length) for _ in range(p.batch * 80)]
    xs, ys = np.stack([a for a, _ in pool]).T.copy(), np.stack([b for _, b in pool]).T.astype(np.int64)
    for step in range(1, p.steps + 1):
        k = r.integers(0, len(pool), p.batch)
        x, y = xs[:, k], ys[:, k]
        f, b = _forward(w["xf"], w["uf"], x), _forward(w["xb"], w["ub"], x[::-1])
        hf, hb = f["h"][1:], b["h"][1:][::-1]
        _, de, dtr = _crf(hf @ w["ef"] + hb @ w["eb"] + w["bias"], y, w["tr"])
        g = {"tr": dtr, "bias": de.sum((0, 1)), "ef": np.einsum("tbn,tbk->nk", hf, de, optimize=True), "eb": np.einsum("tbn,tbk->nk", hb, de, optimize=True)}
        g["xf"], g["uf"] = _backward(f, w["uf"], x, de @ w["ef"].T)
        g["xb"], g["ub"] = _backward(b, w["ub"], np.ascontiguousarray(x[::-1]), (de @ w["eb"].T)[::-1])
        scale = min(1.0, 5.0 / max(1e-9, float(np.sqrt(sum((v**2).sum() for v in g.values())))))
        rate = p.rate * min(1.0, 2.0 * (1 - step / (p.steps + 1)))
        for q, v in g.items():
            v = v * scale
            m1[q] += 0.1 * (v - m1[q])
            m2[q] += 0.01 * (v * v - m2[q])
            w[q] -= (rate * (m1[q] / (1 - 0.9**step)) / (np.sqrt(m2[q] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    w["tr"][0, 1:] -= p.prior
    return w


# --- decoding -------------------------------------------------------------------------------------------------------


def _run_lstm(x: np.ndarray, u: np.ndarray, e: np.ndarray, ids: np.ndarray, start: np.ndarray, active: np.ndarray, out: np.ndarray, back: bool) -> None:
    """Adds the evidence from one direction to out[t, :, :active[t]]; lanes are sorted by length, longest first.

    Lanes are the last axis, so that every step works on contiguous memory. Going back, a lane joins where it ends.
    """
    n = u.shape[0]
    half = np.ones(4 * n, np.float32)
    half[: 3 * n] = 0.5
    x, u, e = np.ascontiguousarray((x * half).T), np.ascontiguousarray((u * half).T), np.ascontiguousarray(e.T)
    lanes = len(start)
    h, c = np.zeros((n, lanes), np.float32), np.zeros((n, lanes), np.float32)
    z, v, q, d = (np.empty((k * n, lanes), np.float32) for k in (4, 4, 1, 1))
    d = np.empty((len(e), lanes), np.float32)
    for t in range(len(active) - 1, -1, -1) if back else range(len(active)):
        m = int(active[t])
        if m < lanes:
            z_, v_, q_, d_, h_, c_ = (np.empty((len(k), m), np.float32) for k in (z, v, q, d, h, c))
            h_[:], c_[:] = h[:, :m], c[:, :m]
        else:
            z_, v_, q_, d_, h_, c_ = z, v, q, d, h, c
        np.take(x, ids[start[:m] + t].astype(np.intp), axis=1, out=z_, mode="clip")
        z_ += np.matmul(u, h_, out=v_)
        np.tanh(z_, out=z_)
        s = z_[: 3 * n]
        s *= 0.5
        s += 0.5
        c_ *= z_[n : 2 * n]
        c_ += np.multiply(z_[:n], z_[3 * n :], out=q_)
        np.multiply(np.tanh(c_, out=q_), z_[2 * n : 3 * n], out=h_)
        out[t, :, :m] += np.matmul(e, h_, out=d_)
        if m < lanes:
            h[:, :m], c[:, :m] = h_, c_


def _viterbi(e: np.ndarray, lengths: np.ndarray, tr: np.ndarray) -> np.ndarray:
    """(time, lanes) best labels for evidence (time, lanes, kinds)."""
    t, b, k = e.shape
    back = np.zeros((t, b, k), np.uint8)
    score = e[0].copy()
    for i in range(1, t):
        m = int((lengths > i).sum())
        s = score[:m, :, None] + tr
        back[i, :m] = s.argmax(1)
        score[:m] = s.max(1) + e[i, :m]
    last = score.argmax(1)
    out = np.zeros((t, b), np.uint8)
    lane = np.arange(b)
    for i in range(t - 1, -1, -1):
        m = int((lengths > i).sum())
        out[i, :m] = last[:m]
        last[:m] = back[i, lane[:m], last[:m]]
    return out


def _decode(ids: np.ndarray, start: np.ndarray, length: np.ndarray, w: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Windows, longest first, of one stream of ids -> (which windows have a label, labels (time, those windows))."""
    top = int(length[0])
    active = np.searchsorted(-length, -np.arange(top))
    e = np.zeros((top, _K - 1, len(start)), np.float32)  # evidence for each kind, less that for none
    e += (w["bias"][1:] - w["bias"][0])[:, None]
    for d in "fb":
        _run_lstm(w["x" + d], w["u" + d], w["e" + d][:, 1:] - w["e" + d][:, :1], ids, start, active, e, d == "b")
    tr = w["tr"] - w["tr"][0, 0]
    stay, enter, leave = float(tr[1:, 1:].max()), float(tr[0, 1:].max()), float(tr[1:, 0].max())
    # An upper bound of what an excursion from none, ending here, gains over none. At a window's ends one of the two is missing.
    some, best = np.zeros(len(start), bool), np.full(len(start), -np.inf, np.float32)
    for t in range(top):
        m = int(active[t])
        best[:m] = np.maximum(best[:m] + stay, enter if t else 0) + e[t, :, :m].max(0)
        inner = int(active[t + 1]) if t + 1 < top else 0
        some[:inner] |= best[:inner] + leave > 0
        some[inner:m] |= best[inner:m] > 0
    some = np.flatnonzero(some)
    if not len(some):
        return some, np.zeros((top, 0), np.uint8)
    full = np.zeros((top, len(some), _K), np.float32)
    full[:, :, 1:] = e[:, :, some].transpose(0, 2, 1)
    return some, _viterbi(full, length[some], tr)


def windows(n: int, p: Params) -> list[tuple[int, int]]:
    """(start, length) of the windows over n characters."""
    step = p.window - p.overlap
    return [(s, min(p.window, n - s)) for s in range(0, max(1, n - p.overlap), step)] if n else []


def label_texts(texts: list[str | None], w: dict[str, np.ndarray], p: Params = Params()) -> tuple[np.ndarray, np.ndarray]:
    """Labels of all characters of all texts in order, and where each text begins among them."""
    n = np.array([len(t) if t else 0 for t in texts], np.int64)
    bounds = np.concatenate([[0], np.cumsum(n)])
    labels = np.zeros(bounds[-1], np.uint8)
    if not bounds[-1]:
        return labels, bounds
    ids = char_ids("".join(t for t in texts if t))
    spans = [(bounds[i] + s, k, s > 0, s + k < n[i]) for i in range(len(texts)) for s, k in windows(int(n[i]), p)]
    start, length = np.array([s for s, *_ in spans]), np.array([k for _, k, *_ in spans])
    head, tail = np.array([x for *_, x, _ in spans]), np.array([x for *_, x in spans])
    order = np.argsort(-length, kind="stable")
    for at in range(0, len(order), p.lanes):
        k = order[at : at + p.lanes]
        some, y = _decode(ids, start[k], length[k], w)
        for j, lane in enumerate(some):
            i = k[lane]
            a = p.overlap // 2 if head[i] else 0
            b = int(length[i]) - (p.overlap - p.overlap // 2 if tail[i] else 0)
            labels[start[i] + a : start[i] + b] = y[a:b, j]
    return labels, bounds


def spans_of(labels: np.ndarray, bounds: np.ndarray, min_length: int) -> list[list[tuple[int, int, str]]]:
    """(start, stop, kind) in each text."""
    out: list[list[tuple[int, int, str]]] = [[] for _ in range(len(bounds) - 1)]
    edge = np.concatenate([[True], labels[1:] != labels[:-1]]) if len(labels) else np.zeros(0, bool)
    edge[bounds[:-1][bounds[:-1] < len(labels)]] = True
    first = np.flatnonzero(edge)
    last = np.append(first[1:], len(labels))
    for a, b in zip(first, last):
        if labels[a] and b - a >= min_length:
            i = int(np.searchsorted(bounds, a, side="right")) - 1
            out[i].append((int(a - bounds[i]), int(b - bounds[i]), KINDS[labels[a]]))
    return out


def mask(text: str | None, spans: list[tuple[int, int, str]]) -> str | None:
    if not spans:
        return text
    out, at = [], 0
    for a, b, kind in spans:
        out += [text[at:a], f"<{kind.upper()}>"]
        at = b
    return "".join([*out, text[at:]])


def _found(texts: list[str | None], w: dict[str, np.ndarray], p: Params) -> list[list[tuple[int, int, str]]]:
    out: list[list[tuple[int, int, str]]] = []
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (size < 1_500_000 or end == at):
            size += len(texts[end] or "")
            end += 1
        out += spans_of(*label_texts(texts[at:end], w, p), p.min_length)
        at = end
    return out


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("kind", pa.string())]))


def find(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """(doc_id, n_spans, spans, text) of each row with private data; text has them replaced by <KIND>."""
    shared = docs.sparkSession.sparkContext.broadcast(train(p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.keep_pages()
        for b in batches:
            texts = K.column(b, "text")
            found = _found(texts, shared.value, p)
            k = [i for i, s in enumerate(found) if s]
            spans = [[dict(zip(("start", "stop", "kind"), s)) for s in found[i]] for i in k]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(k, pa.int64())), pa.array([len(s) for s in spans], pa.int32()), pa.array(spans, _SPANS), pa.array([mask(texts[i], found[i]) for i in k], pa.string())], ["doc_id", "n_spans", "spans", "text"])

    return K.narrow(docs).mapInArrow(run, "doc_id bigint, n_spans int, spans array<struct<start:int,stop:int,kind:string>>, text string")


def redact(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """``docs`` with private data replaced by <KIND>; n_chars, if there, follows the text."""
    shared = docs.sparkSession.sparkContext.broadcast(train(p))
    names = docs.columns
    i = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.keep_pages()
        for b in batches:
            texts = b.column(i).to_pylist()
            found = _found(texts, shared.value, p)
            cols = list(b.columns)
            cols[i] = pa.array([mask(t, s) for t, s in zip(texts, found)], b.schema.field(i).type)
            yield pa.RecordBatch.from_arrays(cols, b.schema.names)

    out = K.map_rows(docs, run)
    size = F.when(F.col("n_chars").isNotNull(), F.length("text")).cast(docs.schema["n_chars"].dataType).alias("n_chars") if "n_chars" in names else None
    return out.select(*(size if c == "n_chars" else F.col(f"`{c}`") for c in names))
