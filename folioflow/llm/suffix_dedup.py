"""Suffix-array dedup: passages of at least ``min_words`` words that occur again, by external induced sorting.

Routing. A text becomes its lower-cased words, a word one of 255 codes. Every window of min_words words is owned by its
least ``gram``-word hash (the leftmost of equals), which depends on nothing but the window, so equal windows have equal
owners. Neighbouring windows with one owner form a tile. Tiles are shuffled by their owner's hash; those whose owner is
alone cannot repeat and end there. All others of a partition are sorted, ``shard`` codes at a time, cut between owners.

Sorting. Codes and the separators 0 form the shard's text. The S* suffixes are ordered by their codes up to 56 and their
common prefixes counted. Then all L suffixes are induced in ascending and all S suffixes in descending order: a queue per
first code takes tuples (position, common prefix with the queue's previous tuple); the tuples of a bucket are popped
together, and a suffix's predecessor is pushed with 1 + the least common prefix since the queue's last push. Pushes come in
final order, so the queues are a monotone priority queue by (code, arrival); beyond ``memory`` bytes they go to files in the
shared folder. Runs of suffixes with common prefixes of at least min_words codes that are windows of one owner, at one distance from it
and with one 16-bit check of the words' full hashes, are equal. (The reduced problem of the S* suffixes is solved by one bounded sort, since no tile is longer than 2 min_words.)

Hot owners. An owner of more than about ``hot`` tiles, such as that of a passage in a third of all documents, is not sorted in one
task: its windows are grouped by 128 bits of hashes, counted in each task before they move.

Of equal windows, that with the smallest (doc_id, word) stays; the words of all others are covered by the spans returned.

Defined cases: null and short texts have no windows; rows with a null doc_id are not compared; rows that repeat a doc_id
are one document; a window may equal one of its own document; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkit as K

@dataclass(frozen=True)
class Params:
    min_words: int = 50
    gram: int = 19
    shard: int = 1 << 23
    memory: int = 1 << 27
    hot: int = 1 << 16  # tiles of one owner in a shard, about

    def __post_init__(self):
        if not 0 < self.gram < self.min_words < 60_000:
            raise ValueError("min_words must be above gram and below 60000")

    @property
    def depth(self) -> int:
        """Codes by which suffixes are ordered at least, and to which common prefixes are counted."""
        return self.min_words + 6


# --- queues ---------------------------------------------------------------------------------------------------------


class Queues:
    """A first-in first-out queue of (position, common prefix) for each code; what exceeds memory goes to files."""

    def __init__(self, memory: int, folder: str | None):
        self.parts: dict[int, list] = {}
        self.memory, self.held, self.folder, self.fs, self.files = memory, 0, folder, None, 0
        self.kind = np.dtype(np.uint8)

    def push(self, code: int, position: np.ndarray, prefix: np.ndarray) -> None:
        self.parts.setdefault(code, []).append((position, prefix))
        self.held += position.nbytes + prefix.nbytes
        if self.held > self.memory and self.folder:
            self._spill()

    def _spill(self) -> None:
        if self.fs is None:
            self.fs, self.path = pa.fs.FileSystem.from_uri(self.folder)
            self.fs.create_dir(self.path, recursive=True)
        for code, parts in self.parts.items():
            fresh = [p for p in parts if not isinstance(p, str)]
            if not fresh:
                continue
            name = f"{self.path}/{self.files}"
            self.files += 1
            position, prefix = (np.concatenate(x) for x in zip(*fresh))
            with self.fs.open_output_stream(name) as f:
                f.write(position.astype("<i8").tobytes())
                f.write(prefix.tobytes())
            self.kind = prefix.dtype
            self.parts[code] = [p for p in parts if isinstance(p, str)] + [name]
        self.held = 0

    def pop(self, code: int) -> tuple[np.ndarray, np.ndarray]:
        """All of the queue."""
        out = []
        for p in self.parts.pop(code, []):
            if isinstance(p, str):
                with self.fs.open_input_stream(p) as f:
                    data = f.read()
                n = len(data) // (8 + self.kind.itemsize)
                out.append((np.frombuffer(data, "<i8", n), np.frombuffer(data, self.kind, n, 8 * n)))
                self.fs.delete_file(p)
            else:
                self.held -= p[0].nbytes + p[1].nbytes
                out.append(p)
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, self.kind)
        return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])

    def close(self) -> None:
        if self.fs is not None:
            self.fs.delete_dir(self.path)


def _range_min(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """min(x[a[i]:b[i]]) for ranges that are not empty."""
    level = np.frompyfunc(int.bit_length, 1, 1)(b - a).astype(np.int64) - 1 if len(a) < 16 else np.log2((b - a).astype(np.float64)).astype(np.int64)
    out = np.empty(len(a), x.dtype)
    k = 0
    while True:
        i = np.flatnonzero(level == k)
        if len(i):
            out[i] = np.minimum(x[a[i]], x[b[i] - (1 << k)])
        k += 1
        if k > (level.max() if len(level) else 0):
            return out
        x = np.minimum(x[: -(1 << (k - 1))], x[1 << (k - 1) :]) if len(x) > 1 << (k - 1) else x


class _Least:
    """Least common prefix of what was popped since the last push to each code."""

    def __init__(self, cap: int, kind: type):
        self.cap, self.kind = cap, kind
        self.since = np.zeros(256, kind)

    def pushes(self, prefix: np.ndarray, place: np.ndarray, code: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(code, order, prefix) of a batch whose tuples at ``place`` push to ``code``; ``prefix`` is that of all tuples."""
        out = []
        o = np.argsort(code, kind="stable")
        place, code = place[o], code[o]
        before = self.since
        self.since = np.minimum(before, prefix.min()) if len(prefix) else before
        if not len(code):
            return out
        head = np.concatenate([[True], code[1:] != code[:-1]])
        a = np.where(head, 0, np.concatenate([[0], place[:-1] + 1]))
        least = _range_min(prefix, a, place + 1)
        least[head] = np.minimum(least[head], before[code[head]])
        value = np.minimum(least.astype(np.int64) + 1, self.cap).astype(self.kind)
        cuts = np.flatnonzero(head)
        last = np.append(cuts[1:], len(code)) - 1
        after = place[last] + 1
        tail = np.full(len(cuts), np.iinfo(self.kind).max, self.kind)
        some = after < len(prefix)
        if some.any():
            tail[some] = np.minimum.accumulate(prefix[::-1])[::-1][after[some]]
        self.since[code[cuts]] = tail
        for c, i, j in zip(code[cuts].tolist(), cuts.tolist(), (last + 1).tolist()):
            out.append((c, o[i:j], value[i:j]))
        return out


def _common(t: np.ndarray, i: int, j: int, cap: int) -> int:
    a, b = t[i : i + cap], t[j : j + cap]
    n = min(len(a), len(b))
    stop = np.flatnonzero((a[:n] != b[:n]) | (a[:n] == 0))
    return int(stop[0]) if len(stop) else n


def induced(t: np.ndarray, memory: int = 1 << 27, folder: str | None = None, depth: int = 56) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Batches of (positions, common prefix with the suffix before) of the suffixes of ``t``, in descending order.

    ``t`` holds codes, ends with 0 and has no two 0 together; suffixes that start with 0 are left out and comparison stops
    at 0. Order is by the first ``depth`` codes, common prefixes are counted to ``depth`` at least.
    """
    cap = depth + 7
    kind = np.uint8 if cap < 255 else np.uint16
    n = len(t)
    differs = np.flatnonzero(t[1:] != t[:-1])
    nxt = differs[np.minimum(np.searchsorted(differs, np.arange(n - 1)), len(differs) - 1)] if len(differs) else np.zeros(0, np.int64)
    small = np.ones(n, bool)
    if len(differs):
        small[:-1] = t[nxt] < t[nxt + 1]
    star = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    text = np.concatenate([t, np.zeros(depth, np.uint8)])
    rows = np.lib.stride_tricks.sliding_window_view(text, depth)[star].copy()
    rows[np.maximum.accumulate(rows == 0, axis=1)] = 0
    o = np.argsort(rows.view(f"S{depth}").ravel(), kind="stable")
    star, rows = star[o], rows[o]
    prefix = np.zeros(len(star), kind)
    if len(star) > 1:
        same = (rows[1:] == rows[:-1]) & (rows[1:] != 0)
        prefix[1:] = np.where(same.all(1), depth, same.argmin(1))
    first = t[star]
    edges = np.searchsorted(first, np.arange(257))

    # L suffixes, ascending
    queues, least = Queues(memory, folder and f"{folder}/l"), _Least(cap, kind)
    ready: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(256)]

    def up(position: np.ndarray, lcp: np.ndarray, code: int) -> None:
        before = t[np.maximum(position - 1, 0)]
        k = np.flatnonzero((position > 0) & (before >= code) & ((before > code) | ~small[position]))
        for c, order, value in least.pushes(lcp, k, before[k]):
            queues.push(c, position[k[order]] - 1, value)

    for code in range(256):
        last = -1
        while True:
            position, lcp = queues.pop(code)
            if not len(position):
                break
            lcp = lcp.copy()
            if last < 0:
                lcp[0] = 0
            ready[code].append((position, lcp))
            last = int(position[-1])
            up(position, lcp, code)
        a, b = edges[code], edges[code + 1]
        if b > a:
            lcp = prefix[a:b].copy()
            lcp[0] = _common(t, last, int(star[a]), cap) if last >= 0 else 0
            up(star[a:b], lcp, code)
    queues.close()

    # S suffixes, descending; the common prefix of a tuple is that with the one popped before it, which is greater
    queues, least = Queues(memory, folder and f"{folder}/s"), _Least(cap, kind)

    def down(position: np.ndarray, lcp: np.ndarray, code: int) -> None:
        before = t[np.maximum(position - 1, 0)]
        k = np.flatnonzero((position > 0) & (before > 0) & (before <= code) & ((before < code) | small[position]))
        for c, order, value in least.pushes(lcp, k, before[k]):
            queues.push(c, position[k[order]] - 1, value)

    for code in range(255, 0, -1):
        last = -1
        while True:
            position, lcp = queues.pop(code)
            if not len(position):
                break
            lcp = lcp.copy()
            if last < 0:
                lcp[0] = 0
            last = int(position[-1])
            down(position, lcp, code)
            yield position, lcp
        link = None  # common prefix of the last popped L suffix with the next smaller one
        for position, lcp in reversed(ready[code]):
            position = position[::-1]
            between = np.empty(len(lcp), kind)
            between[1:] = lcp[:0:-1]
            between[0] = link if link is not None else _common(t, last, int(position[0]), cap) if last >= 0 else 0
            link, last = int(lcp[0]), int(position[-1])
            down(position, between, code)
            yield position, between
    queues.close()


# --- shards ---------------------------------------------------------------------------------------------------------


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for each start, length[i] of them."""
    ends = np.cumsum(length)
    return np.repeat(start - (ends - length), length) + np.arange(int(ends[-1]) if len(ends) else 0)


def tiles(texts: list[str | None], p: Params) -> dict[str, np.ndarray]:
    """text, owner, at, owned, off and (start, length) in ``codes`` of every tile."""
    h, bounds = K.word_hashes(texts)
    n = np.diff(bounds)
    w = p.min_words - p.gram + 1
    codes = (h % np.uint64(255)).astype(np.uint8) + np.uint8(1)
    ok = np.zeros(len(h) + 1, bool)
    for i in np.flatnonzero(n >= p.min_words):
        ok[bounds[i] : bounds[i + 1] - p.min_words + 1] = True
    q = np.flatnonzero(ok)
    if not len(q):
        e = np.zeros(0, np.int64)
        return {k: e for k in ("text", "owner", "at", "owned", "off", "start", "length", "place", "window")} | {"codes": codes, "check": e.astype("<u2")}
    power, inverse = K._powers(1 << max(12, int(len(h)).bit_length()))
    acc = np.concatenate([[np.uint64(0)], np.cumsum(h * inverse[: len(h)])])
    g = K.mix(K.mix((acc[p.gram :] - acc[: -p.gram]) * power[: len(h) - p.gram + 1]))
    mask = np.uint64((1 << 30) - 1)
    m = (g & ~mask) | np.arange(len(g), dtype=np.uint64)
    size = 1
    while size < w:
        step = min(size, w - size)
        m = np.minimum(m[:-step], m[step:])
        size += step
    own = (m[q] & mask).astype(np.int64)
    new = np.concatenate([[True], (own[1:] != own[:-1]) | (q[1:] != q[:-1] + 1)])
    first = np.flatnonzero(new)
    owned = np.diff(np.append(first, len(q)))
    text = np.searchsorted(bounds, q[first], side="right") - 1
    window = K.mix((acc[q + p.min_words] - acc[q]) * power[q])
    check = (window >> np.uint64(48)).astype("<u2")
    return {"check": check, "place": first, "text": text, "owner": g[own[first]].view(np.int64), "window": window.view(np.int64), "at": q[first] - bounds[text], "owned": owned, "off": own[first] - q[first], "start": q[first], "length": owned + p.min_words - 1, "codes": codes}


def repeats(owner: np.ndarray, doc: np.ndarray, at: np.ndarray, owned: np.ndarray, off: np.ndarray, check: np.ndarray, t: np.ndarray, start: np.ndarray, p: Params, folder: str | None) -> tuple[np.ndarray, ...]:
    """(doc, start, stop, first doc) of the spans of windows that are not the first of their kind."""
    run = 0
    positions, runs = [], []
    tile_at = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(t))))
    for position, lcp in induced(t, p.memory, folder, p.depth):
        r = run + np.cumsum(lcp < p.min_words)
        run = int(r[-1])
        k = tile_at[position]
        is_window = position - start[k] < owned[k]
        positions.append(position[is_window])
        runs.append(r[is_window])
    empty = tuple(np.zeros(0, np.int64) for _ in range(4))
    if not positions:
        return empty
    q, r = np.concatenate(positions), np.concatenate(runs)
    k = tile_at[q]
    inner = q - start[k]
    own = check[(np.cumsum(owned) - owned)[k] + inner].astype(np.uint64) << np.uint64(8)
    mark = K.mix(K.mix(owner[k].view(np.uint64) + r.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) + (off[k] - inner + 64).astype(np.uint64) + own)
    d, word = doc[k], at[k] + inner
    o = np.lexsort((word, d, mark))
    mark, d, word = mark[o], d[o], word[o]
    head = np.concatenate([[True], mark[1:] != mark[:-1]])
    lead = np.maximum.accumulate(np.where(head, np.arange(len(mark)), 0))
    gone = (d != d[lead]) | (word != word[lead])
    d, word, fd, fw = d[gone], word[gone], d[lead][gone], word[lead][gone]
    if not len(d):
        return empty
    o = np.lexsort((word, d))
    d, word, fd, fw = d[o], word[o], fd[o], fw[o]
    again = np.concatenate([[False], (d[1:] == d[:-1]) & (word[1:] == word[:-1])])
    d, word, fd, fw = d[~again], word[~again], fd[~again], fw[~again]
    new = np.concatenate([[True], (d[1:] != d[:-1]) | (word[1:] != word[:-1] + 1) | (fd[1:] != fd[:-1])])
    a = np.flatnonzero(new)
    b = np.append(a[1:], len(d)) - 1
    return d[a], word[a], word[b] + p.min_words, fd[a]


def _hot_owners(texts: DataFrame, p: Params) -> np.ndarray:
    """Owners of more than about ``hot`` tiles, by a sixteenth of the documents. Which way a window takes changes no result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.slices(batches):
            owner, n = np.unique(tiles(K.column(b, "text"), p)["owner"], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(owner.astype(np.int64)), pa.array(n.astype(np.int64))], ["owner", "n"])

    some = texts.where("pmod(xxhash64(doc_id), 16) = 0").mapInArrow(run, "owner bigint, n bigint")
    many = some.groupBy("owner").agg(F.sum("n").alias("n")).where(F.col("n") * 16 > p.hot)
    return np.sort(many.select("owner").toArrow()["owner"].to_numpy())


def _hot_windows(texts: DataFrame, hot, p: Params) -> DataFrame:
    """(doc_id, start, stop, first_doc_id) of the windows of hot owners that are not the first of their kind.

    Their windows are grouped by 128 bits of their hash and the owner's instead of being sorted in one task: each task counts
    its own first, and what is joined to the many equal windows is one row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.slices(batches):
            x = tiles(K.column(b, "text"), p)
            k = np.flatnonzero(np.isin(x["owner"], hot.value))
            n = x["owned"][k]
            i, inner = np.repeat(k, n), _ranges(np.zeros(len(k), np.int64), n)
            yield pa.RecordBatch.from_arrays([pa.array(x["window"][x["place"][i] + inner]), pa.array(x["owner"][i]), b.column(0).take(pa.array(x["text"][i])), pa.array((x["at"][i] + inner).astype(np.int32))], ["a", "b", "doc_id", "start"])

    windows = texts.mapInArrow(run, "a bigint, b bigint, doc_id bigint, start int")
    place = F.struct("doc_id", "start")
    first = windows.groupBy("a", "b").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first != last").select("a", "b", "first")
    gone = windows.join(first, ["a", "b"]).where(place != F.col("first"))
    return gone.select("doc_id", "start", (F.col("start") + p.min_words).alias("stop"), F.col("first.doc_id").alias("first_doc_id"))


def spans(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """(doc_id, start_word, stop_word, first_doc_id): merged spans to remove, and where the first of their words stay."""
    spark = docs.sparkSession
    base = K.checkpoint_dir(spark)
    texts = K.narrow(docs).where("doc_id is not null and text is not null")
    owners = _hot_owners(texts, p)
    hot = spark.sparkContext.broadcast(owners)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.slices(batches):
            x = tiles(K.column(b, "text"), p)
            if len(hot.value):
                k = np.flatnonzero(~np.isin(x["owner"], hot.value))
                x |= {c: x[c][k] for c in ("text", "owner", "at", "owned", "off", "start", "length", "place")}
            for i in range(0, len(x["text"]), 50_000):
                s = slice(i, i + 50_000)
                length, owned = x["length"][s], x["owned"][s]
                size = length + 2 * owned  # a byte a code, then two a window
                ends = np.cumsum(size)
                flat = np.empty(int(ends[-1]), np.uint8)
                flat[_ranges(ends - size, length)] = x["codes"][_ranges(x["start"][s], length)]
                flat[_ranges(ends - 2 * owned, 2 * owned)] = x["check"].view(np.uint8)[_ranges(2 * x["place"][s], 2 * owned)]
                tile = pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(flat)])
                yield pa.RecordBatch.from_arrays([pa.array(x["owner"][s]), b.column(0).take(pa.array(x["text"][s])), *(pa.array(x[c][s].astype(np.int32)) for c in ("at", "owned", "off")), tile], ["owner", "doc_id", "at", "owned", "off", "tile"])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.keep_pages()
        folder = f"{base}/suffix-{uuid.uuid4().hex}"
        try:
            yield from sorted_shards(batches, folder)
        finally:  # nothing stays behind, whether the task ends or fails
            fs, path = pa.fs.FileSystem.from_uri(folder)
            if fs.get_file_info(path).type != pa.fs.FileType.NotFound:
                fs.delete_dir(path)

    def sorted_shards(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        codes = 0

        def shard() -> pa.RecordBatch:
            x = pa.concat_tables(held).combine_chunks()
            col = {c: x[c].to_numpy().astype(np.int64) for c in ("owner", "doc_id", "at", "owned", "off")}
            size = pc.binary_length(x["tile"]).to_numpy().astype(np.int64)
            length = size - 2 * col["owned"]
            start = np.concatenate([[0], np.cumsum(length + 1)])
            t = np.zeros(int(start[-1]), np.uint8)
            flat = np.frombuffer(b"".join(x["tile"].to_pylist()), np.uint8)
            at = np.cumsum(size) - size
            t[_ranges(start[:-1], length)] = flat[_ranges(at, length)]
            check = flat[_ranges(at + length, 2 * col["owned"])].view("<u2")
            d, a, b, f = repeats(*(col[c] for c in ("owner", "doc_id", "at", "owned", "off")), check, t, start[:-1], p, folder)
            return pa.RecordBatch.from_arrays([pa.array(d), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(f)], ["doc_id", "start", "stop", "first_doc_id"])

        waiting: pa.Table | None = None
        for b in batches:
            if not b.num_rows:
                continue
            now = pa.Table.from_batches([b])
            now = pa.concat_tables([waiting, now]) if waiting is not None else now
            key = now["owner"].to_numpy()
            end = int(np.searchsorted(key, key[-1]))
            waiting = now.slice(end)
            _several(now.slice(0, end), key[:end], held)
            codes = sum(x.nbytes for x in held)
            if codes > p.shard:
                yield shard()
                held.clear()
        if waiting is not None:
            _several(waiting, waiting["owner"].to_numpy(), held)
        if held:
            yield shard()

    found = (
        texts.mapInArrow(cut, "owner bigint, doc_id bigint, at int, owned int, off int, tile binary")
        .repartition("owner")
        .sortWithinPartitions("owner")
        .mapInArrow(sort, "doc_id bigint, start int, stop int, first_doc_id bigint")
    )
    if len(owners):
        found = found.unionByName(_hot_windows(texts, hot, p))
    w = Window.partitionBy("doc_id").orderBy("start", "stop")
    reach = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0)
    return (
        found.withColumn("new", new)
        .withColumn("island", F.sum("new").over(w))
        .groupBy("doc_id", "island")
        .agg(F.min("start").alias("start_word"), F.max("stop").alias("stop_word"), F.min_by("first_doc_id", "start").alias("first_doc_id"))
        .drop("island")
    )


def _several(x: pa.Table, key: np.ndarray, held: list[pa.Table]) -> None:
    """Keeps the rows whose key is not alone; keys are sorted and complete."""
    if len(key) > 1:
        same = key[1:] == key[:-1]
        k = np.flatnonzero(np.concatenate([[False], same]) | np.concatenate([same, [False]]))
        if len(k):
            held.append(x.take(pa.array(k)))


ORACLE_SQL = r"""
with words as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from documents where doc_id is not null and text is not null),
windows as (select doc_id, i - 1 as pos, md5(array_to_string(w[i:i + 49], ' ')) as h from (select doc_id, w, unnest(range(1, len(w) - 48)) as i from words where len(w) >= 50)),
firsts as (select doc_id, pos, min_by(doc_id, (doc_id, pos)) over (partition by h) as fd, min_by(pos, (doc_id, pos)) over (partition by h) as fa from windows),
gone as (select * from firsts where doc_id <> fd or pos <> fa),
marked as (select *, case when pos > max(pos + 50) over (partition by doc_id order by pos rows between unbounded preceding and 1 preceding) then 1 else 0 end as new from gone),
islands as (select *, sum(new) over (partition by doc_id order by pos) as island from marked)
select doc_id, cast(min(pos) as int) as start_word, cast(max(pos + 50) as int) as stop_word, min_by(fd, pos) as first_doc_id from islands group by doc_id, island
"""
