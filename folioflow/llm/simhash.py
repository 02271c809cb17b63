"""SimHash near-dedup: 256-bit fingerprints and an exact join of all that differ in at most ``radius`` bits.

A fingerprint sums, over the distinct lower-cased words of a text, the signs of a 256-bit hash. Equal fingerprints are one
node of all this, and every node is compared with every other: the nodes lie in blocks, and a task joins two of them (or one
with itself), so that no task holds more than two blocks and nothing depends on how alike the texts are.

The join leaves out only pairs that a bound rules out. Two fingerprints within ``radius`` differ in few bits of some word:
the ``radius`` + 1 are dealt out to the four words, and were each word's bits at least its share, their sum would be over
``radius``. So some word differs in less than its share, and, by the same bound, some 16 bits of it in less than theirs (3 or
4 at the radius of 48). All values of 16 bits that are that close are looked up, the rows found are compared by the word, and
what is left by all bits. A pair counts in the first place where it is found, so that each is counted once.

Groups are the connected components of these pairs; the smallest doc_id of a group is its group_id and stays. ``links``
counts the different texts (more exactly: fingerprints) within ``radius`` of a document's.

Defined cases: a text without words (null, empty, only signs) is in no group and stays; rows with a null doc_id are not
compared and stay; rows that repeat a doc_id with different texts are documents of their own, and those with one
fingerprint are one document, of which ``keep_one`` keeps the row with the greatest text (ties: with the greatest row as JSON);
an empty table gives no rows; other columns are kept or ignored; doc_id is cast to bigint.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as K

WORDS = ("w0", "w1", "w2", "w3")


@dataclass(frozen=True)
class Params:
    radius: int = 48
    block: int = 1 << 18  # most rows of a block, on average
    least: int = 4096  # rows of a block, if there are fewer than ``blocks`` of them
    blocks: int = 8


def block_count(n: int, p: Params) -> int:
    return max(1, -(-n // p.block), min(p.blocks, -(-n // p.least)))


def _lanes() -> np.ndarray:
    """For a byte, its eight bits as the eight bytes of a word."""
    bits = (np.arange(256)[:, None] >> np.arange(8)) & 1
    return np.ascontiguousarray(bits.astype(np.uint8)).view(np.uint64).ravel()


def fingerprints(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(n, 4) words of the fingerprints, and the number of distinct words of each text."""
    h, bounds = K.word_hashes(texts)
    n = len(texts)
    out, distinct = np.zeros((n, 4), np.uint64), np.zeros(n, np.int64)
    lanes = _lanes()
    step = max(1, n)
    at = 0
    while at < n:
        step = max(1, int(np.searchsorted(bounds, bounds[at] + 400_000, side="right")) - 1 - at)
        end = min(n, at + step)
        m = end - at
        width = max(1, int(m - 1).bit_length())
        key = (np.repeat(np.arange(m, dtype=np.uint64), np.diff(bounds[at : end + 1])) << np.uint64(64 - width)) | (h[bounds[at] : bounds[end]] >> np.uint64(width))
        key = np.sort(key)
        key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
        doc = (key >> np.uint64(64 - width)).astype(np.int64)
        size = np.bincount(doc, minlength=m)
        distinct[at:end] = size
        low = (key << np.uint64(width)) >> np.uint64(24) << np.uint64(24)  # 40 bits, whatever the batch
        edges = np.concatenate([[0], np.cumsum(size)])
        cuts = np.unique(np.concatenate([edges[:-1], np.arange(0, len(key), 240)]))
        cuts = cuts[cuts < len(key)]
        owner = doc[cuts] if len(cuts) else np.zeros(0, np.int64)
        for w in range(4):
            g = K.mix(K.mix(low + np.uint64(0x9E3779B97F4A7C15 * (w + 1) % 2**64)))
            ones = np.zeros((m, 64), np.int32)
            for b in range(8):
                if len(cuts):
                    part = np.add.reduceat(lanes[(g >> np.uint64(8 * b)) & np.uint64(255)], cuts)
                    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
                    ones[owner[first], 8 * b : 8 * b + 8] = np.add.reduceat(part.view(np.uint8).reshape(-1, 8).astype(np.int32), first, axis=0)
            bits = 2 * ones > size[:, None]
            out[at:end, w] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()
        at = end
    return out, distinct


def _components(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest member of the component of each of n nodes."""
    label = np.arange(n)
    while True:
        m = np.minimum(label[a], label[b])
        old = label.copy()
        np.minimum.at(label, a, m)
        np.minimum.at(label, b, m)
        np.minimum.at(label, old[a], m)
        np.minimum.at(label, old[b], m)
        label = label[label]
        if (label == old).all():
            return label


def _shares(total: int, parts: int) -> list[int]:
    return [total // parts + (i < total % parts) for i in range(parts)]


def near(a: np.ndarray, b: np.ndarray, radius: int, most: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All (x, y) with rows x of a and y of b at most ``radius`` bits apart, each once; with x < y where b is a."""
    of_word = np.array(_shares(radius + 1, 4))
    of_part = np.array([u for v in of_word.tolist() for u in _shares(v, 4)])
    close = lambda z: (np.bitwise_count(z.view(np.uint16)) < of_part) & (np.bitwise_count(z) < of_word).repeat(4, axis=1)
    masks = np.arange(1 << 16)
    for part in range(16):
        mine, theirs, word = a.view(np.uint16)[:, part], b.view(np.uint16)[:, part], part // 4
        from_a, from_b = np.argsort(mine, kind="stable"), np.argsort(theirs, kind="stable")
        all_values, words_b = mine[from_a].astype(np.int64), b[from_b, word]
        size = np.bincount(theirs, minlength=1 << 16)
        start = np.cumsum(size) - size
        used = masks[np.bitwise_count(masks) < of_part[part]].tolist()
        for top in range(17):
            these = [m for m in used if m.bit_length() == top]
            # in one block both ways would be found: keep that from the value without the mask's highest bit
            rows = np.flatnonzero(all_values >> top - 1 & 1 == 0) if a is b and top else np.arange(len(a))
            order, values = from_a[rows], all_values[rows]
            words_a = a[order, word]
            for m in these:
                to = values ^ m
                count = size[to]
                ends = np.cumsum(count)
                shift = start[to] - ends + count
                done = 0
                while done < len(rows):
                    base = int(ends[done - 1]) if done else 0
                    end = max(done + 1, int(np.searchsorted(ends, base + most, side="right")))
                    k = count[done:end]
                    at = np.repeat(shift[done:end], k)
                    at += np.arange(base, base + len(at))
                    d = np.bitwise_count(np.repeat(words_a[done:end], k) ^ words_b[at])
                    hit = np.flatnonzero(d < of_word[word])
                    done = end
                    if len(hit):
                        x, y = order[np.searchsorted(ends, hit + base, side="right")], from_b[at[hit]]
                        z = a[x] ^ b[y]
                        ok = np.bitwise_count(z).sum(1, dtype=np.int64) <= radius
                        if a is b and not m:
                            ok &= x < y
                        x, y, z = x[ok], y[ok], z[ok]
                        first = close(z).argmax(1) == part
                        if first.any():
                            x, y = x[first], y[first]
                            yield (np.minimum(x, y), np.maximum(x, y)) if a is b else (x, y)


def join_blocks(fp: np.ndarray, second: np.ndarray, node: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, node, links): pairs that span the components of all near pairs, and the links of each node that has some.

    Rows of which ``second`` is true are compared with the others only; where it is true or false of all, all are compared.
    """
    n = len(node)
    one, two = np.flatnonzero(~second), np.flatnonzero(second)
    if not len(one) or not len(two):
        one = two = np.arange(n)
    a = np.ascontiguousarray(fp[one])
    links, found, waits = np.zeros(n, np.int64), [], 0

    def spanning() -> tuple[np.ndarray, np.ndarray]:
        label = _components(*(np.concatenate(v) for v in zip(*found)), n)
        k = np.flatnonzero(label != np.arange(n))
        return k, label[k]

    for x, y in near(a, a if one is two else np.ascontiguousarray(fp[two]), p.radius):
        x, y = one[x], two[y]
        np.add.at(links, x, 1)
        np.add.at(links, y, 1)
        found.append((x, y))
        waits += len(x)
        if waits > max(n, 1 << 18):
            found, waits = [spanning()], 0
    if not found:
        e = np.zeros(0, np.int64)
        return e, e, e, e
    x, y = (node[v] for v in spanning())
    k = np.flatnonzero(links)
    return np.minimum(x, y), np.maximum(x, y), node[k], links[k]


def fingerprint_table(docs: DataFrame) -> DataFrame:
    """(doc_id, w0..w3) of every row that has a doc_id and words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.slices(batches):
            fp, n = fingerprints(K.column(b, "text"))
            k = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(k)), *(pa.array(fp[k, w].view(np.int64)) for w in range(4))], ["doc_id", *WORDS])

    return K.narrow(docs).where("doc_id is not null and text is not null").mapInArrow(run, "doc_id bigint, w0 bigint, w1 bigint, w2 bigint, w3 bigint")


def near_pairs(reps: DataFrame, p: Params, n: int) -> DataFrame:
    """(a, b, links) of ``n`` rows (node, w0..w3): pairs that span the components of the near pairs (links null), and, with b null, links of a to be added up."""
    blocks = block_count(n, p)
    pairs = [(low, high) for high in range(blocks) for low in range(high + 1)]

    def block_of(node: np.ndarray) -> np.ndarray:
        return (K.mix(node.view(np.uint64)) % np.uint64(blocks)).astype(np.int64)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            own = block_of(x.column(0).to_numpy())
            for other in range(blocks if x.num_rows else 0):
                low, high = np.minimum(own, other), np.maximum(own, other)
                yield pa.RecordBatch.from_arrays([pa.array((high * (high + 1) // 2 + low).astype(np.int32)), *x.columns], ["pair", "node", *WORDS])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.keep_pages()
        held = [np.stack([c.to_numpy(zero_copy_only=False) for c in x.columns], 1) for x in batches if x.num_rows]
        rows = np.concatenate(held) if held else np.zeros((0, 6), np.int64)
        del held
        for pair in np.unique(rows[:, 0]).tolist():
            these = rows[rows[:, 0] == pair]
            low, high = pairs[pair]
            second = block_of(np.ascontiguousarray(these[:, 1])) == high
            if low != high and second.all() | ~second.any():
                continue  # the other block is empty
            a, b, who, k = join_blocks(np.ascontiguousarray(these[:, 2:]).view(np.uint64), second, these[:, 1], p)
            none = np.zeros(len(a), bool)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(a, who)), pa.array(np.append(b, who), mask=np.append(none, ~np.zeros(len(who), bool))), pa.array(np.append(a, k), mask=np.append(~none, np.zeros(len(k), bool)))], ["a", "b", "links"])

    schema = "pair int, node bigint, w0 bigint, w1 bigint, w2 bigint, w3 bigint"
    return reps.mapInArrow(spread, schema).repartitionById(len(pairs), "pair").mapInArrow(join, "a bigint, b bigint, links bigint")


def components(pairs: DataFrame) -> DataFrame:
    """(id, group_id) of every id in a pair (a, b), a < b; group_id is the smallest of its component.

    Alternates large-star and small-star; each round ends in a checkpoint, which also tells how many edges are not yet
    those of the round before.
    """
    edges = K.checkpoint(pairs)
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        down = large.select(F.col("b").alias("u"), F.col("a").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select("u", "v", "m")
        # v is least itself where it is the end of every edge; a round without another v changed nothing
        after = K.checkpoint(small.select(F.col("m").alias("a"), F.col("u").alias("b"), F.lit(0).alias("moved")).unionByName(small.where("v != m").select(F.col("m").alias("a"), F.col("v").alias("b"), F.lit(1).alias("moved"))).groupBy("a", "b").agg(F.max("moved").alias("moved")))
        done = not after.where("moved = 1").limit(1).count() and after.select("b").distinct().join(after.select(F.col("a").alias("b")).distinct(), "b", "left_semi").limit(1).count() == 0
        edges = after.select("a", "b")
        if done:
            return edges.select(F.col("b").alias("id"), F.col("a").alias("group_id")).unionByName(edges.select(F.col("a").alias("id"), F.col("a").alias("group_id")).distinct())


def _classes(docs: DataFrame, p: Params) -> DataFrame:
    """(doc_id, w0..w3, group_id, links, keep) of every document that has a near copy."""
    fps = K.checkpoint(fingerprint_table(docs).distinct())
    # nodes are numbered once, by what is written: a doc_id with several texts is several nodes
    reps = K.checkpoint(fps.groupBy(*WORDS).agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).withColumn("node", F.monotonically_increasing_id()))
    n = reps.count()
    found = K.checkpoint(near_pairs(reps.select("node", *WORDS), p, n).groupBy("a", "b").agg(F.sum("links").alias("links")))
    label = components(found.where("b is not null").select("a", "b"))
    links = found.where("b is null").select(F.col("a").alias("node"), "links")
    member = reps.join(label.withColumnRenamed("id", "node"), "node", "left").where("n > 1 or group_id is not null").join(links, "node", "left")
    member = member.select(*WORDS, "rep", F.coalesce("group_id", "node").alias("g"), F.coalesce("links", F.lit(0)).alias("links"))
    lead = member.groupBy("g").agg(F.min(F.struct("rep", *WORDS)).alias("lead"))
    named = member.join(lead, "g").select(*WORDS, F.col("lead.rep").alias("group_id"), "links", (F.struct("rep", *WORDS) == F.col("lead")).alias("first"))
    return fps.join(named, [*WORDS]).select("doc_id", *WORDS, "group_id", "links", (F.col("first") & (F.col("doc_id") == F.col("group_id"))).alias("keep"))


def groups(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """(doc_id, group_id, links, keep) of every document that has a near copy; keep is true for one of each group."""
    return _classes(docs, p).select("doc_id", "group_id", "links", "keep")


def keep_one(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """The rows of ``docs``, with all their columns, without those that have a near copy that stays."""
    drop = K.checkpoint(_classes(docs, p).where("not keep").select(F.col("doc_id").alias("__id"), *WORDS))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row")
    rows = docs.select(row, F.col("doc_id").cast("bigint").alias("__id"))
    many = K.checkpoint(docs.groupBy(F.col("doc_id").cast("bigint").alias("__id")).count().where("count > 1 and __id is not null").select("__id"))
    other = drop.select("__id").unionByName(many).distinct()
    single = rows.where("__id is not null").join(other, "__id", "left_anti").select("__row.*")
    # ids that repeat: a row goes with its text, and rows of one id and fingerprint are one document
    again = _again(rows.join(many, "__id", "left_semi"), drop)
    return rows.where("__id is null").select("__row.*").unionByName(single).unionByName(again)


def _again(rows: DataFrame, drop: DataFrame) -> DataFrame:
    @F.pandas_udf("array<bigint>")
    def marks(text: pd.Series) -> pd.Series:
        fp, n = fingerprints(list(text))
        return pd.Series([x.tolist() if k else None for x, k in zip(fp.view(np.int64), n)], dtype=object)

    marked = rows.withColumn("__fp", marks(F.col("__row.text").cast("string")))
    plain = marked.where("__fp is null").select("__row.*")
    key = [F.col("__fp")[i].alias(w) for i, w in enumerate(WORDS)]
    best = marked.where("__fp is not null").select("__id", *key, "__row").groupBy("__id", *WORDS).agg(F.max_by("__row", F.struct(F.col("__row.text"), F.to_json("__row"))).alias("__row"))
    return plain.unionByName(best.join(drop, ["__id", *WORDS], "left_anti").select("__row.*"))
