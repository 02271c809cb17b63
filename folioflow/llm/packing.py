"""Best-fit packing: best-fit decreasing with a segment tree over remaining capacities.

A document's length is its UTF-8 bytes plus one end mark, as byte-level token ids count it. A document longer than
``capacity`` is first cut into full pieces of ``capacity`` and a rest. Pieces go longest first (ties by doc_id, copy, then
piece) into the open bin with the smallest remaining capacity that holds them, found by descending the tree; among bins
with equal remaining capacity the oldest is taken. It is one packing of the whole table at every size.

The packing depends on lengths alone, and the pieces of one length that go into bins of one remaining capacity fill these
one after the other. So the driver reads the histogram of lengths (``capacity`` rows at most), and ``plan`` places runs of
equal pieces into runs of bins, by one descent of the tree a run. Each run of bins at least halves its remaining capacity
when it is used, so that the work depends on ``capacity`` and not on the number of documents. The pieces themselves are
only ranked among those of their length, by a range partitioning and sums of the weights of whole partitions, and look up
their run. Equal (doc_id, length) are counted before anything is moved, so that no id is too frequent for a task.

Defined cases: a null or empty text has length 1, its end mark; a null doc_id is packed, before all others among equals;
rows that repeat a doc_id are packed each, told apart by ``copy``, which counts them by length; an empty table gives no
rows; other columns are ignored; doc_id is cast to bigint, so that one that is no number is an error under ANSI.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkit as K


@dataclass(frozen=True)
class Params:
    capacity: int = 32768


_BLOCK = 4096  # pieces that a row stands for, at most, unless of one document


class Capacities:
    """Runs of open bins by remaining capacity; a segment tree holds which capacities have an open bin."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.tree = bytearray(2 * self.size)
        self.runs: dict[int, list[tuple[int, int]]] = {}

    def add(self, left: int, first: int, n: int) -> None:
        heapq.heappush(self.runs.setdefault(left, []), (first, n))
        i = left + self.size
        while i and not self.tree[i]:
            self.tree[i] = 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int, int] | None:
        """(remaining capacity, first bin, bins) of the oldest run with the tightest capacity of at least ``need``, removed."""
        tree, i = self.tree, need + self.size
        if not tree[i]:
            while i > 1 and (i & 1 or not tree[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if tree[2 * i] else 2 * i + 1
        left = i - self.size
        heap = self.runs[left]
        first, n = heapq.heappop(heap)
        if not heap:
            del self.runs[left]
            tree[i] = 0
            i >>= 1
            while i and not (tree[2 * i] or tree[2 * i + 1]):
                tree[i] = 0
                i >>= 1
        return left, first, n


def plan(lengths: list[tuple[int, int]], capacity: int) -> np.ndarray:
    """Rows (length, rank of the first piece, first bin, pieces a bin, offset of the first piece) for (length, pieces)."""
    free, bins, out = Capacities(capacity), 0, []
    for x, todo in sorted(lengths, reverse=True):
        rank = 0
        while rank < todo:
            left, first, n = free.take(x) or (capacity, bins, 1 << 62)
            k = left // x
            full, rest = min(n, (todo - rank) // k), 0
            if full:
                out.append((x, rank, first, k, capacity - left))
                rank += full * k
                if left > k * x:
                    free.add(left - k * x, first, full)
            if full < n and rank < todo:
                rest = todo - rank
                out.append((x, rank, first + full, rest, capacity - left))
                rank = todo
                if left > rest * x:
                    free.add(left - rest * x, first + full, 1)
            used = full + (rest > 0)
            if n == 1 << 62:
                bins = first + used
            elif used < n:
                free.add(left, first + used, n - used)
    return np.array(out, np.int64).reshape(-1, 5)


def _blocks(docs: DataFrame, p: Params) -> DataFrame:
    """(x, doc_id, copy, piece, n, per): n pieces of length x, in the order of copy and piece; ``per`` of them belong to one copy."""
    n = F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("bigint") + 1
    same = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), n.alias("n")).groupBy("doc_id", "n").agg(F.count("*").alias("c"))
    before = F.sum("c").over(Window.partitionBy("doc_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1))
    same = same.withColumn("copy", F.coalesce(before, F.lit(0))).withColumn("q", F.expr(f"n div {p.capacity}")).withColumn("r", F.expr(f"n % {p.capacity}"))
    same = same.withColumn("step", F.expr(f"greatest(1L, {_BLOCK} div (q + 1))"))
    few = same.withColumn("i", F.explode(F.expr("sequence(0L, c - 1, step)")))
    few = few.select("doc_id", "q", "r", (F.col("copy") + F.col("i")).alias("copy"), F.least("step", F.col("c") - F.col("i")).alias("c"))
    one = lambda x, piece, n, per: F.struct(x.cast("bigint").alias("x"), F.col("copy"), piece.cast("bigint").alias("piece"), n.cast("bigint").alias("n"), per.cast("bigint").alias("per"))
    both = F.array(one(F.lit(p.capacity), F.lit(0), F.col("c") * F.col("q"), F.col("q")), one(F.col("r"), F.col("q"), F.col("c"), F.lit(1)))
    return few.select("doc_id", F.explode(F.filter(both, lambda k: (k["n"] > 0) & (k["x"] > 0))).alias("k")).select("k.x", "doc_id", "k.copy", "k.piece", "k.n", "k.per")


_OUT = "doc_id bigint, copy bigint, piece bigint, n_tokens bigint, bin bigint, bin_offset bigint"


def pack(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """(doc_id, copy, piece, n_tokens, bin, bin_offset) of every piece of every document."""
    if not 0 < p.capacity <= 1 << 18:
        raise ValueError("capacity must be between 1 and 2**18")
    order = [F.desc("x"), F.asc_nulls_first("doc_id"), F.asc("copy")]
    # The ranks below count what stands before a row, so the order must not be computed again: it is written.
    blocks = K.checkpoint(_blocks(docs, p).repartitionByRange(*order).sortWithinPartitions(*order))

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each length in a partition, its pieces there."""
        part, total = TaskContext.get().partitionId(), {}
        for b in batches:
            x, n = (b.column(i).to_numpy() for i in (0, 1))
            for v, s in zip(*(lambda u, at: (u.tolist(), np.bincount(at, n).astype(np.int64).tolist()))(*np.unique(x, return_inverse=True))):
                total[v] = total.get(v, 0) + s
        yield pa.RecordBatch.from_arrays([pa.array([part] * len(total), pa.int32()), pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["part", "x", "n"])

    found = blocks.select("x", "n").mapInArrow(sizes, "part int, x bigint, n bigint").toArrow()  # a length spans partitions only where it fills them
    every: dict[int, int] = {}
    start: dict[tuple[int, int], int] = {}
    for part, x, n in sorted(zip(*(found[c].to_pylist() for c in ("part", "x", "n")))):
        start[part, x] = every.get(x, 0)
        every[x] = start[part, x] + n
    before = {k: v for k, v in start.items() if v}
    shared = docs.sparkSession.sparkContext.broadcast((plan(list(every.items()), p.capacity), before))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, before = shared.value
        key = (runs[:, 0] << 44) + runs[:, 1]
        by = np.argsort(key)
        key, runs = key[by], runs[by]
        part, seen = TaskContext.get().partitionId(), {}
        for b in batches:
            many = np.cumsum(b.column(b.schema.get_field_index("n")).to_numpy())
            at = 0
            while at < b.num_rows:
                end = max(at + 1, int(np.searchsorted(many, (many[at - 1] if at else 0) + 100_000, side="right")))
                s, at = b.slice(at, end - at), end
                x, copy, piece, n, per = (s.column(s.schema.get_field_index(c)).to_numpy() for c in ("x", "copy", "piece", "n", "per"))
                i = np.repeat(np.arange(len(n)), n)
                inner = np.arange(len(i)) - (np.cumsum(n) - n)[i]
                ends = np.cumsum(n)
                first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
                lead = np.zeros(len(x), np.int64)
                for a, z in zip(first.tolist(), [*first[1:].tolist(), len(x)]):
                    v = int(x[a])
                    had = seen.get(v, before.get((part, v), 0))
                    lead[a:z] = had - (int(ends[a - 1]) if a else 0)
                    seen[v] = had + int(ends[z - 1]) - (int(ends[a - 1]) if a else 0)
                rank = lead[i] + np.arange(len(i))
                r = runs[np.searchsorted(key, (x[i] << 44) + rank, side="right") - 1]
                place = rank - r[:, 1]
                ids = s.column(s.schema.get_field_index("doc_id")).take(pa.array(i))
                cols = (copy[i] + inner // per[i], piece[i] + inner % per[i], x[i], r[:, 2] + place // r[:, 3], r[:, 4] + place % r[:, 3] * x[i])
                yield pa.RecordBatch.from_arrays([ids, *map(pa.array, cols)], ["doc_id", "copy", "piece", "n_tokens", "bin", "bin_offset"])

    return blocks.mapInArrow(place, _OUT).select("doc_id", F.col("copy").cast("int"), F.col("piece").cast("int"), "n_tokens", "bin", "bin_offset")


ORACLE_SQL = r"""
with recursive sizes as (
  select doc_id, n, row_number() over (partition by doc_id order by n) - 1 as copy
  from (select doc_id, coalesce(octet_length(encode(text)), 0) + 1 as n from documents)),
pieces as (select doc_id, copy, piece, least(32768, n - 32768 * piece) as x from (select *, unnest(range(0, (n + 32767) // 32768)) as piece from sizes)),
ordered as (select *, row_number() over (order by x desc, doc_id nulls first, copy, piece) as i from pieces),
walk as (
  select 0::bigint as i, 0::bigint as bin, 0::bigint as bin_offset, []::bigint[] as space
  union all
  select i + 1, spot - 1, 32768 - coalesce(space[spot], 32768),
         case when spot > len(space) then list_append(space, 32768 - x) else list_concat(space[:spot - 1], [space[spot] - x], space[spot + 1:]) end
  from (select i, space, x, case when best is null then len(space) + 1 else list_position(space, best) end as spot
        from (select w.i, space, o.x, list_min(list_filter(space, lambda s: s >= o.x)) as best from walk w join ordered o on o.i = w.i + 1)))
select doc_id, cast(copy as int) as copy, cast(piece as int) as piece, cast(x as bigint) as n_tokens, bin, bin_offset from ordered join walk using (i)
"""
