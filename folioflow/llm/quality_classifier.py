"""Quality classifier: hashed word n-gram logistic regression, trained with follow-the-regularised-leader updates.

A token is a maximal run of characters that are not white space. Its features are hashes, into 2**bits buckets, of the
token and of its shape (the sequence of character classes without repeats, and whether the token repeats the one
before), as n-grams of 1 and 2 tokens and of 1 to 3 shapes. Each family is normalised by its count, so a score doesn't
depend on length. Training reads a sample of at most ``max_labelled`` labelled rows, those with the smallest hash of
doc_id; scoring covers every document.

Defined cases: a null or empty text has no features, so its score is that of the bias; a null doc_id stays null in the
scores; rows that repeat are scored each; null labels are ignored and several labels of one doc_id count as their
majority, ties as 1; without labels, every score is 0.5, which is kept; the threshold is below one half so that texts too short to tell are kept; other columns are ignored.
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


@dataclass(frozen=True)
class Params:
    bits: int = 18
    max_labelled: int = 4000
    epochs: int = 4
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 1e-4
    l2: float = 1e-4
    threshold: float = 0.4


@functools.cache
def _classes() -> np.ndarray:
    """Character class below 128, the same for all other characters by Unicode case: 0 is white space."""
    out = np.full(K._LIMIT, 9, np.uint32)
    for c in range(K._LIMIT):
        ch = chr(c)
        if ch.isspace():
            out[c] = 0
        elif ch.isdigit():
            out[c] = 3
        elif ch.isalpha():
            out[c] = 2 if ch.isupper() else 1
        elif c < 128:
            out[c] = 16 + c
    return out


def _grams(h: np.ndarray, inside: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n tokens that end at each place; ``inside`` counts a token's place in its text."""
    out = h
    for k in range(1, n):
        back = np.concatenate([np.zeros(k, np.uint64), h[:-k]]) if k < len(h) else np.zeros(len(h), np.uint64)
        out = K.mix(out * np.uint64(0xD6E8FEB86659FD93) + back)
    return out[inside >= n - 1]


def features(texts: list[str | None], bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each family: buckets of all texts in order, and where each text begins among them."""
    classes = _classes()
    words, shapes, counts = [], [], np.zeros(len(texts) + 1, np.int64)
    for group in K._pieces(texts):
        joined = "\n".join(p for _, p in group)
        c = K.codes(joined)
        kind = classes[np.minimum(c, K._LIMIT - 1)]
        start, end = K._runs(kind != 0)
        raw = np.where(kind != 0, c, 0)
        words.append(K._run_hashes(raw, start, end))
        keep = np.flatnonzero((kind != 0) & (kind != np.concatenate([[0], kind[:-1]])))
        at = np.searchsorted(keep, start)
        gap = np.zeros(len(keep) + len(start), np.uint32)  # a 0 between tokens
        gap[np.arange(len(keep)) + np.repeat(np.arange(len(start)), np.diff(np.append(at, len(keep))))] = kind[keep]
        s0, s1 = K._runs(gap != 0)
        shapes.append(K._run_hashes(gap, s0, s1))
        bounds = np.cumsum([0] + [len(p) + 1 for _, p in group])
        np.add.at(counts, np.array([i for i, _ in group]) + 1, np.diff(np.searchsorted(start, bounds)))
    bounds = np.cumsum(counts)
    if not words:
        return [(np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64))] * 5
    word, shape = np.concatenate(words), np.concatenate(shapes)
    n = np.diff(bounds)
    inside = np.arange(len(word)) - np.repeat(bounds[:-1], n)
    again = (inside > 0) & (word == np.concatenate([[np.uint64(0)], word[:-1]]))
    shape = K.mix(shape + again.astype(np.uint64))
    out = []
    for salt, (h, k) in enumerate(((word, 1), (word, 2), (shape, 1), (shape, 2), (shape, 3))):
        g = K.mix(_grams(h, inside, k) ^ np.uint64(0x9E3779B97F4A7C15 * (salt + 1) % 2**64))
        out.append(((g >> np.uint64(64 - bits)).astype(np.int64), np.concatenate([[0], np.cumsum(np.maximum(n - k + 1, 0))])))
    return out


def sparse_rows(texts: list[str | None], bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, values) of each text; the last bucket, 2**bits, is the bias."""
    families = features(texts, bits)
    rows = []
    for i in range(len(texts)):
        idx, val = [np.array([1 << bits])], [np.array([1.0])]
        for g, b in families:
            part = g[b[i] : b[i + 1]]
            if len(part):
                u, k = np.unique(part, return_counts=True)
                idx.append(u)
                val.append(k / len(part))
        u, inverse = np.unique(np.concatenate(idx), return_inverse=True)
        rows.append((u.astype(np.int32), np.bincount(inverse, np.concatenate(val)).astype(np.float32)))
    return rows


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], p: Params = Params()) -> np.ndarray:
    """Weights of the buckets, the bias last."""
    size = 1 << p.bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(i):
        zi = z[i]
        w = -(zi - np.sign(zi) * p.l1) / ((p.beta + np.sqrt(n[i])) / p.alpha + p.l2)
        return np.where(np.abs(zi) <= p.l1, 0.0, w)

    rng = np.random.default_rng(7)
    for _ in range(p.epochs):
        for r in rng.permutation(len(rows)):
            i, v = rows[r]
            w = weights(i)
            q = 1 / (1 + np.exp(-np.clip(w @ v, -30, 30)))
            g = (q - labels[r]) * v
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / p.alpha * w
            n[i] += g * g
    return weights(np.arange(size + 1))


def score_texts(texts: list[str | None], w: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(probability of good quality, tokens) of each text."""
    total = np.full(len(texts), w[-1])
    families = features(texts, bits)
    for g, b in families:
        n = np.diff(b)
        total += K.segment_sums(w[g], b) / np.maximum(n, 1)
    return 1 / (1 + np.exp(-np.clip(total, -30, 30))), np.diff(families[0][1])


def fit(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> np.ndarray:
    majority = (
        labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("double").alias("y"))
        .where("doc_id is not null and y is not null")
        .groupBy("doc_id")
        .agg((F.avg("y") >= 0.5).cast("int").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(p.max_labelled)
    )
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.slices(batches):
            rows = sparse_rows(K.column(b, "text"), p.bits)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([i for i, _ in rows], pa.list_(pa.int32())), pa.array([v for _, v in rows], pa.list_(pa.float32()))], ["doc_id", "y", "i", "v"])

    sample = K.narrow(docs).where("doc_id is not null").join(F.broadcast(majority), "doc_id").select("doc_id", "text", "y")
    found = sample.mapInArrow(run, "doc_id bigint, y int, i array<int>, v array<float>").toArrow().combine_chunks()  # features, so that long texts stay where they are
    order = np.argsort(found["doc_id"].to_numpy(), kind="stable")
    i, v, y = found["i"].combine_chunks(), found["v"].combine_chunks(), found["y"].to_pylist()
    return train([(i[int(k)].values.to_numpy(), v[int(k)].values.to_numpy()) for k in order], [y[k] for k in order], p)


def score(docs: DataFrame, w: np.ndarray, p: Params = Params()) -> DataFrame:
    """doc_id, n_tokens, score and keep of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for b in K.slices(batches):
            s, n = score_texts(K.column(b, "text"), w, p.bits)
            s = np.round(s, 6)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(s), pa.array(s >= p.threshold)], ["doc_id", "n_tokens", "score", "keep"])

    return K.narrow(docs).mapInArrow(run, "doc_id bigint, n_tokens bigint, score double, keep boolean")


def classify(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> DataFrame:
    return score(docs, fit(docs, labels, p), p)


def keep_good(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> DataFrame:
    """The rows of ``docs``, with all their columns, that the classifier keeps."""
    w = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, p))
    i = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.slices(batches, i):
            s, _ = score_texts(b.column(i).to_pylist(), w.value, p.bits)
            yield b.filter(pa.array(np.round(s, 6) >= p.threshold))

    return K.map_rows(docs, run)
