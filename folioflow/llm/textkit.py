"""Shared kernels of the training-data operators: whole-batch word hashing in numpy and Spark helpers.

A word is a maximal run of letters and digits (Unicode categories L* and N*), lower-cased code point by code point.
Hashes are 64-bit: a polynomial in the code points (modulo 2**64) followed by a mixing step. All functions take whole
texts; a text longer than ``PIECE`` code points is cut between words for memory only, which changes no hash.
"""

from __future__ import annotations

import functools
import re
import tempfile
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PIECE = 1 << 20
_R = 0x9E3779B97F4A7C15 | 1
_LIMIT = 0x20000
_GAP = re.compile(r"[\W_]", re.UNICODE)


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir, set for use.

    Only where that setting is absent and Spark runs in this very process (tests, a laptop) a folder of our own is set; on a
    cluster a folder of one machine would lose its files with that machine, so there the setting is required.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="folioflow-checkpoint-"))
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` into the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """(lower-cased code point or 0 where it is no word character, the same as bool), below ``_LIMIT``."""
    low = np.zeros(_LIMIT, np.uint32)
    for c in range(_LIMIT):
        ch = chr(c)
        if unicodedata.category(ch)[0] in "LN":
            s = ch.lower()
            low[c] = ord(s) if len(s) == 1 else c
    return low, low != 0


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """R**i and R**-i modulo 2**64 for i < n."""
    inverse = pow(_R, -1, 1 << 64)
    out = []
    for base in (_R, inverse):
        p = np.ones(n, np.uint64)
        p[1:] = base
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _runs(word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(word.view(np.int8), prepend=0, append=0))
    return edge[0::2], edge[1::2]


def _run_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the values in each [start, end); values are not 0 inside and 0 outside of these runs."""
    n = len(values)
    power, inverse = _powers(1 << max(12, int(n).bit_length()))
    acc = np.empty(n + 1, np.uint64)
    acc[0] = 0
    np.cumsum(values * inverse[:n], out=acc[1:])
    return mix((acc[end] - acc[start]) * power[np.maximum(end - 1, 0)] + (end - start).astype(np.uint64))


def _lowered(c: np.ndarray) -> np.ndarray:
    low, _ = _tables()
    lc = low[np.minimum(c, _LIMIT - 1)]
    return np.where(far, c, lc) if (far := c >= _LIMIT).any() else lc


def _hash_piece(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts (in code points) of the words in ``text``."""
    lc = _lowered(codes(text))
    start, end = _runs(lc != 0)
    return _run_hashes(lc, start, end), start


def _pieces(texts: list[str]):
    """Groups of (index of text, piece) of at most about PIECE code points; long texts are cut between words."""
    group: list[tuple[int, str]] = []
    size = 0
    for i, t in enumerate(texts):
        if not t:
            continue
        at = 0
        while at < len(t):
            end = len(t)
            if end - at > PIECE:
                m = _GAP.search(t, at + PIECE)
                end = m.end() if m else end
            piece = t if at == 0 and end == len(t) else t[at:end]
            if size and size + len(piece) > PIECE:
                yield group
                group, size = [], 0
            group.append((i, piece))
            size += len(piece) + 1
            at = end
    if group:
        yield group


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All words of the texts in order: 64-bit hashes, and where each text begins among them (len(texts) + 1).

    A null or empty text has no words.
    """
    hashes, counts = [], np.zeros(len(texts) + 1, np.int64)
    for group in _pieces(texts):
        h, start = _hash_piece("\n".join(p for _, p in group))
        bounds = np.cumsum([0] + [len(p) + 1 for _, p in group])
        per = np.diff(np.searchsorted(start, bounds))
        np.add.at(counts, np.array([i for i, _ in group]) + 1, per)
        hashes.append(h)
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), np.cumsum(counts)


def units(texts: list[str | None], breaks: str = "\n.!?") -> dict[str, np.ndarray]:
    """The units of the texts: the words between two characters of ``breaks``, line ends first among them.

    Arrays with one entry a unit: ``text`` (index), ``start`` and ``stop`` in code points (from the first word to the
    first word of the next unit, or the end of the text), ``words``, and ``a`` and ``b``, two 64-bit digests of the
    sequence of lower-cased words. A unit without words does not count.
    """
    at, starts, ends, hashes, cuts = [], [], [], [], []
    marks = np.array([ord(x) for x in breaks], np.uint32)
    offset = np.zeros(len(texts), np.int64)
    for group in _pieces(texts):
        joined = "\n".join(p for _, p in group)
        c = codes(joined)
        lc = _lowered(c)
        start, end = _runs(lc != 0)
        bounds = np.cumsum([0] + [len(p) + 1 for _, p in group])
        per = np.diff(np.searchsorted(start, bounds))
        index = np.array([i for i, _ in group])
        mark = np.zeros(len(c), bool)
        for m in marks:
            mark |= c == m
        count = np.cumsum(mark, dtype=np.int64)
        for k, (i, p) in enumerate(group):  # pieces of one text follow each other
            bounds[k] -= offset[i]
            offset[i] += len(p)
        shift = np.repeat(bounds[: len(group)], per)
        hashes.append(_run_hashes(lc, start, end))
        at.append(np.repeat(index, per))
        starts.append(start - shift)
        ends.append(end - shift)
        gap = np.zeros(len(start), bool)
        if len(start):
            before = np.concatenate([[0], end[:-1]])
            gap = np.where(start > 0, count[np.maximum(start - 1, 0)], 0) > np.where(before > 0, count[np.maximum(before - 1, 0)], 0)
            if len(group) == 1 and group[0][1] is not texts[group[0][0]] and offset[group[0][0]] > len(group[0][1]):
                head = texts[group[0][0]][: int(offset[group[0][0]] - len(group[0][1]))].rstrip()
                tail = re.search(r"[\W_]*\Z", head + joined[: int(start[0])])
                gap[0] = any(x in breaks for x in tail.group() + texts[group[0][0]][len(head) : int(starts[-1][0])])
        cuts.append(gap)
    empty = np.zeros(0, np.int64)
    if not hashes or not sum(map(len, hashes)):
        return {k: empty.astype(np.uint64) if k in "ab" else empty for k in ("text", "start", "stop", "words", "a", "b")}
    h, at, start, end, cut = map(np.concatenate, (hashes, at, starts, ends, cuts))
    new = cut | np.concatenate([[True], at[1:] != at[:-1]])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(h)))
    place = np.arange(len(h)) - np.repeat(first, n)
    power, _ = _powers(1 << max(12, int(len(h)).bit_length()))
    both = []
    for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
        both.append(mix(np.add.reduceat(mix(h ^ np.uint64(salt)) * power[place], first) + n.astype(np.uint64)))
    text = at[first]
    length = np.array([len(t) if t else 0 for t in texts], np.int64)
    stop = np.where(np.append(text[1:], -1) == text, np.append(start[first][1:], 0), length[text])
    return {"text": text, "start": start[first], "stop": stop, "words": n, "a": both[0], "b": both[1]}


def bigrams(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the pairs of successive words inside each text, and where each text begins among them."""
    n = np.diff(bounds)
    if len(h) < 2:
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    pair = mix(h[:-1] * np.uint64(0xD6E8FEB86659FD93) + h[1:])
    inside = np.ones(len(h) - 1, bool)
    cut = bounds[1:-1]
    cut = cut[(cut > 0) & (cut < len(h))]
    inside[cut - 1] = False
    return pair[inside], np.concatenate([[0], np.cumsum(np.maximum(n - 1, 0))])


def segment_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values over [bounds[i], bounds[i + 1]); 0 for an empty range."""
    acc = np.concatenate([[0], np.cumsum(values, axis=0)])
    return acc[bounds[1:]] - acc[bounds[:-1]]


def keep_pages() -> None:
    """Lets this process keep the memory of arrays that it frees.

    The C library returns freed arrays above a threshold to the system, and the next array of that size faults its pages in
    again, which took a third of the time of some operators. The threshold rises to the size of the largest array freed.
    """
    np.empty(31 << 20, np.uint8)


def slices(batches: Iterator[pa.RecordBatch], text: str | int = "text", size: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most about ``size`` bytes of text (one text at least), to bound working memory."""
    keep_pages()
    for b in batches:
        i = text if isinstance(text, int) else b.schema.get_field_index(text)
        acc = np.cumsum(pc.fill_null(pc.binary_length(b.column(i)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(acc, (acc[at - 1] if at else 0) + size, side="right")))
            yield b.slice(at, end - at)
            at = end


def map_rows(docs: DataFrame, run) -> DataFrame:
    """mapInArrow over all columns with the same schema; names stay out of it, whatever characters they hold."""
    plain = [f"c{i}" for i in range(len(docs.columns))]
    schema = T.StructType([T.StructField(c, f.dataType, True) for c, f in zip(plain, docs.schema)])
    return docs.toDF(*plain).mapInArrow(run, schema).toDF(*docs.columns)


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def narrow(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, so that other columns are neither read nor able to clash."""
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
