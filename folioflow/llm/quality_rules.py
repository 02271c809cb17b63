"""Quality rule: hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

Tokens are runs of letters and digits (lower-cased) and runs of other visible characters. Their 1- and 2-grams are hashed
into 2**bits buckets. Two multinomials are estimated with add-``smoothing`` counts, one over all documents with a trusted
label and one over all documents. A document's score is the mean over its n-grams of log p_target - log p_raw; it is
kept if the score is at least ``threshold``. Both counts and the scores cover every document and whole texts.

Defined cases: a null or empty text has no n-grams, scores 0 and is kept; a null doc_id stays null and is never trusted;
rows that repeat count and are scored each; a doc_id with several labels is trusted if any of them is ``trusted``; without
trusted documents every score is 0; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as K
from .quality_classifier import _classes


@dataclass(frozen=True)
class Params:
    bits: int = 16
    smoothing: float = 1.0
    threshold: float = -0.1
    trusted: int = 1
    max_ids: int = 4_000_000  # of 8 bytes each, sent to every task


def grams(texts: list[str | None], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all texts in order, and where each text begins among them; a text's 1-grams precede its 2-grams."""
    kinds = _classes()
    hashes, counts = [], np.zeros(len(texts) + 1, np.int64)
    for group in K._pieces(texts):
        c = K.codes("\n".join(p for _, p in group))
        kind = kinds[np.minimum(c, K._LIMIT - 1)]
        low = K._lowered(c)
        word = low != 0
        start, end = K._runs(word)
        s2, e2 = K._runs((kind != 0) & ~word)
        h = np.concatenate([K._run_hashes(low, start, end), K._run_hashes(np.where((kind != 0) & ~word, c, 0), s2, e2)])
        at = np.concatenate([start, s2])
        order = np.argsort(at, kind="stable")
        hashes.append(h[order])
        bounds = np.cumsum([0] + [len(p) + 1 for _, p in group])
        np.add.at(counts, np.array([i for i, _ in group]) + 1, np.diff(np.searchsorted(at[order], bounds)))
    bounds = np.cumsum(counts)
    if not hashes:
        return np.zeros(0, np.int64), bounds
    h = np.concatenate(hashes)
    pairs, pb = K.bigrams(h, bounds)
    n, m = np.diff(bounds), np.diff(pb)
    both = np.concatenate([[0], np.cumsum(n + m)])
    out = np.empty(len(h) + len(pairs), np.uint64)
    out[np.arange(len(h)) + np.repeat(both[:-1] - bounds[:-1], n)] = h
    out[np.arange(len(pairs)) + np.repeat(both[:-1] + n - pb[:-1], m)] = K.mix(pairs ^ np.uint64(0xA0761D6478BD642F))
    return (K.mix(out) >> np.uint64(64 - bits)).astype(np.int64), both


def log_ratio(target: np.ndarray, raw: np.ndarray, smoothing: float) -> np.ndarray:
    if not target.sum():
        return np.zeros(len(raw))
    p = (target + smoothing) / (target.sum() + smoothing * len(target))
    q = (raw + smoothing) / (raw.sum() + smoothing * len(raw))
    return np.log(p) - np.log(q)


def counts(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> tuple[np.ndarray, np.ndarray]:
    """Bucket counts over the trusted documents and over all. Each task sums its own; 2**bits numbers reach the driver."""
    good = labels.where((F.col("quality") == p.trusted) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct()
    few = np.sort(good.limit(p.max_ids + 1).toArrow()["doc_id"].to_numpy())
    if len(few) <= p.max_ids:  # else the ids are too many to send to every task, and the labels are joined to the texts
        marked, ids = K.narrow(docs), docs.sparkSession.sparkContext.broadcast(few)
    else:
        marked, ids = K.narrow(docs).join(good.withColumn("good", F.lit(True)), "doc_id", "left"), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 << p.bits), np.int64)
        for b in K.slices(batches):
            if ids is None:
                good = np.array([x is True for x in K.column(b, "good")], bool)
            else:
                own = pc.fill_null(b.column(0), -1).to_numpy(zero_copy_only=False)
                place = np.minimum(np.searchsorted(ids.value, own), max(0, len(ids.value) - 1))
                good = (ids.value[place] == own) & pc.is_valid(b.column(0)).to_numpy(zero_copy_only=False) if len(ids.value) else np.zeros(len(own), bool)
            g, bounds = grams(K.column(b, "text"), p.bits)
            total[1] += np.bincount(g, minlength=1 << p.bits)
            total[0] += np.bincount(g[np.repeat(good, np.diff(bounds))], minlength=1 << p.bits)
        i = np.flatnonzero(total[1])
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(total[0][i]), pa.array(total[1][i])], ["bucket", "good", "every"])

    found = marked.mapInArrow(run, "bucket bigint, good bigint, every bigint").groupBy("bucket").agg(F.sum("good").alias("good"), F.sum("every").alias("every")).toArrow()
    out = np.zeros((2, 1 << p.bits), np.int64)
    i = found["bucket"].to_numpy()
    out[0][i], out[1][i] = found["good"].to_numpy(), found["every"].to_numpy()
    return out[0], out[1]


def score_texts(texts: list[str | None], ratio: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    g, b = grams(texts, bits)
    n = np.diff(b)
    return np.round(K.segment_sums(ratio[g], b) / np.maximum(n, 1), 6), n


def rate(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, n_grams, score and keep of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(log_ratio(*counts(docs, labels, p), p.smoothing))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.slices(batches):
            s, n = score_texts(K.column(b, "text"), shared.value, p.bits)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(s), pa.array(s >= p.threshold)], ["doc_id", "n_grams", "score", "keep"])

    return K.narrow(docs).mapInArrow(run, "doc_id bigint, n_grams bigint, score double, keep boolean")
