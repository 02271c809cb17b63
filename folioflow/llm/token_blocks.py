"""Token ids as compressed binary blocks: an adaptive context-mixing range coder.

Ids (16 bits) of the documents of a task follow each other in blocks of ``block`` ids. Each block starts from nothing and
carries the CRC-32 of its ids. Orders 0, 1 and 2 each predict an id by its share among the ids seen so far in the block: of
all, of those after the id before, and of those after the two ids before (hashed to 16 bits); a fourth prediction is that all
ids are alike. Every id updates them at once. The distributions are mixed by weights, kept for each class of how often the
two contexts have been seen, and of the place; an id's range is the sum of its parts in the four, in whole numbers of
2**-22, below it lie those of all smaller ids. After each id the weights of its class move by what each prediction had in it.

The encoder knows all ids, so it counts smaller and equal ids before each place in each context for many blocks at once, by
sorting; then weights and the range coder advance all blocks in step, in 63 bits, 32 bits out at a time, with carries added
at the end. The decoder is sequential and finds an id by bisection.

Defined cases: a null or empty text has no ids and appears in a block with count 0; a null doc_id stays null; rows that
repeat are stored each; a document may span blocks (``first`` is its first id's place in the document); an empty table
gives no blocks; other columns are ignored; doc_id is cast to bigint. Ids beyond the vocabulary and vocabularies beyond 2**16 are
errors.
"""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import textkit as K

DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_C = 64  # places that are compared with each other directly
_FEW = 32  # blocks that are counted together
_STEPS = 16  # ids of a block that are prepared together
_BITS = 22  # an id's range is a whole number of 2**-22
_START = (0.3, 0.3, 0.4, 0.3)  # weights of orders 0, 1, 2 and of none before anything is seen
_DECAY = 0.98
_WIDE, _LOW = 63, 31  # bits of the range, and of it what stays when 32 are written
_TOP, _SHIFT, _DIGIT, _REST = np.uint64(1 << _LOW), np.uint64(_LOW), np.uint64(32), np.uint64((1 << _LOW) - 1)


@dataclass(frozen=True)
class Params:
    block: int = 8192
    lanes: int = 512
    ranks: str = DEFAULT_RANKS
    vocabulary: int = 50257


def contexts(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The id before, and the two before hashed to 16 bits; 0 before the first."""
    one, two = np.zeros_like(x), np.zeros_like(x)
    one[:, 1:] = x[:, :-1]
    two[:, 2:] = x[:, :-2]
    return one, (two.astype(np.uint32) * np.uint32(0x9E3B) + one * np.uint32(0x6A0B) + (two >> 5)).astype(np.uint16)


def _smaller_before(perm: np.ndarray, inv: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """For each place of permutations (lanes, n): how many of the values before it are smaller. n is a multiple of _C.

    Values in the same _C places and then those with the same upper bits are compared with each other, all pairs at a
    time; all others are counted by a table of sums. ``inv`` holds the places by value, ``flat`` the values as indices.
    """
    lanes, n = perm.shape
    m = n // _C

    def inside(a: np.ndarray) -> np.ndarray:
        a = np.ascontiguousarray(a.reshape(lanes * m, _C).T)
        out, less = np.zeros(a.shape, np.uint8), np.empty(a.shape, bool)
        for j in range(1, _C):
            np.less(a[:j], a[j], out=less[:j])
            np.add.reduce(less[:j].view(np.uint8), axis=0, dtype=np.uint8, out=out[j])
        return np.ascontiguousarray(out.T).ravel()

    cell = perm >> 6
    cell = (cell + np.arange(n) // _C * (m + 1)) * lanes  # a row and a column of zeros come first in the sums
    cell += np.arange(lanes)[:, None]
    h = np.bincount(cell.ravel(), minlength=(m + 1) * (m + 1) * lanes).reshape(m + 1, m + 1, lanes)
    acc = np.zeros(h.shape, np.int16)  # of lower chunks and lower buckets
    np.copyto(acc[1:, 1:], h[:m, :m], casting="unsafe")
    for j in range(2, m + 1):
        acc[j] += acc[j - 1]
    for j in range(2, m + 1):
        acc[:, j] += acc[:, j - 1]
    out = acc.ravel().take(cell)
    out += inside(perm).reshape(lanes, n)
    out += inside((inv >> 6).astype(np.uint8 if m <= 256 else np.uint16)).take(flat)
    return out


def _starts(change: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each column the last one at which there was a change, the first counting as one."""
    out = np.zeros((change.shape[0], len(at)), np.uint16)
    np.multiply(change, at[1:], out=out[:, 1:])
    return np.maximum.accumulate(out, axis=1, out=out)


def seen(x: np.ndarray, context: np.ndarray | None) -> np.ndarray:
    """Of the ids before each place of x (lanes, n) in the same context: how many are less than its own, equal to it, and
    all, as 16-bit numbers from the lowest on of one whole number."""
    lanes, n = x.shape
    row, at = np.arange(lanes)[:, None] * n, np.arange(n, dtype=np.uint16)
    key = x.astype(np.uint32 if context is None else np.int64)
    if context is not None:
        key |= context.astype(np.int64) << 16
    key <<= 16
    key |= at
    key.sort(axis=1)
    change = key[:, 1:] ^ key[:, :-1]
    key &= 0xFFFF
    pair = np.empty((lanes, n, 2), np.uint16)  # rank, and how many equal ones before
    pair[..., 0] = at
    np.subtract(at, _starts(change > 0xFFFF, at), out=pair[..., 1])
    g = np.empty(lanes * n, np.uint32)  # by place
    g[row + key] = pair.view(np.uint32)[..., 0]
    if context is None:
        seq, start = None, np.uint16(0)
        inv = key.astype(np.uint16)
    else:
        start = _starts(change > 0xFFFFFFFF, at)  # by rank and in the order of contexts alike
        by_context = (context.astype(np.uint32) << np.uint32(16)) | at
        by_context.sort(axis=1)
        by_context &= np.uint32(0xFFFF)
        seq = row + by_context
        g = g.take(seq)
        inv = None
    pair = g.view(np.uint16).reshape(lanes, n, 2)
    perm, same = np.ascontiguousarray(pair[..., 0]), np.ascontiguousarray(pair[..., 1])
    flat = row + perm
    if inv is None:
        inv = np.empty(lanes * n, np.uint16)
        inv[flat] = at
        inv = inv.reshape(lanes, n)
    if pad := -n % _C:
        more = np.broadcast_to(np.arange(n, n + pad, dtype=np.uint16), (lanes, pad))
        perm, inv = np.concatenate([perm, more], 1), np.concatenate([inv, more], 1)
        flat = np.arange(lanes)[:, None] * (n + pad) + perm
    less = _smaller_before(perm, inv, flat)[:, :n].view(np.uint16)
    out = np.zeros((lanes, n, 4), np.uint16)
    np.subtract(less - start, same, out=out[..., 0])
    out[..., 1] = same
    np.subtract(at, start, out=out[..., 2])
    out = out.view(np.int64)[..., 0]
    if seq is None:
        return out
    by_place = np.empty(lanes * n, np.int64)
    by_place[seq] = out
    return by_place.reshape(lanes, n)


def _late(at):
    return (at >= 128) + (at >= 1024) * 1


def _class(n2, n1, at):
    """Which weights an id takes: by how often its contexts stood before (0, 1, 2, 3 to 4, more), and by its place."""
    return _STEP[np.minimum(n2, 5)] * 15 + _STEP[np.minimum(n1, 5)] * 3 + _late(at)


_STEP = np.array([0, 1, 2, 3, 3, 4])
_CLASSES = 75
_KIND1, _KIND2 = _class(0, np.arange(1 << 15), 0), _class(np.arange(1 << 15), 0, 0)  # parts of the class, by count
_UNSEEN = {1: np.arange(_CLASSES) % 15 < 3, 2: np.arange(_CLASSES) < 15}  # classes of ids whose context was not seen, by order


def _carried(digits: np.ndarray) -> bytes:
    """Digits of 32 bits, highest first, that may carry into the one before."""
    if not len(digits):
        return b""
    whole = (digits & np.uint64(0xFFFFFFFF)).astype(">u4").tobytes()
    carry = np.append((digits >> np.uint64(32))[1:], np.uint64(0)).astype(">u4").tobytes()
    return ((int.from_bytes(whole, "big") + int.from_bytes(carry, "big")) & ((1 << (32 * len(digits))) - 1)).to_bytes(4 * len(digits), "big")


def encode_blocks(blocks: list[np.ndarray], vocabulary: int) -> list[bytes]:
    """Payloads of blocks of ids; blocks of equal length advance in step."""
    if not 0 < vocabulary <= 1 << 16:
        raise ValueError("ids must fit 16 bits")
    out: list[bytes] = [b""] * len(blocks)
    by_length: dict[int, list[int]] = {}
    for i, b in enumerate(blocks):
        if len(b) >= 1 << 15:
            raise ValueError("a block must have less than 32768 ids")
        if len(b) and int(b.max()) >= vocabulary:
            raise ValueError("an id is beyond the vocabulary")
        if len(b):
            by_length.setdefault(len(b), []).append(i)
    for n, members in by_length.items():
        lanes = len(members)
        ids, counts = np.empty((n, lanes), np.uint16), np.empty((n, 3, lanes), np.int64)
        for at in range(0, lanes, _FEW):
            x = np.stack([blocks[i] for i in members[at : at + _FEW]]).astype(np.uint16)
            lane = slice(at, at + x.shape[0])
            for k, context in enumerate((None, *contexts(x))):
                counts[:, k, lane] = seen(x, context).T
            ids[:, lane] = x.T
        digits, base = _coded(ids, counts, vocabulary)
        for lane, i in enumerate(members):
            b = int(base[lane])
            tail = np.array([b >> _LOW, (b << 1) & 0xFFFFFFFF], np.uint64)
            out[i] = _carried(np.concatenate([digits[lane], tail])).rstrip(b"\0")
    return out


def _coded(ids: np.ndarray, counts: np.ndarray, vocabulary: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The 32-bit digits of each lane, and what is left to write.

    The last of the four predictions, after orders 0, 1 and 2, is that of all ids alike. Divisions are of whole numbers
    below 2**53 in floating point: rounded down they are exact.
    """
    n, lanes = ids.shape
    weights = np.empty((4, _CLASSES, lanes))
    weights[...] = np.array(_START)[:, None, None]
    weights[1, _UNSEEN[1]] = weights[2, _UNSEEN[2]] = 0.0  # of a context not seen yet, and so they stay
    weights = np.append(weights.ravel(), 0.0)  # the last is that of order 0 at the first place
    offset = np.arange(4)[:, None] * (_CLASSES * lanes) + np.arange(lanes)
    base, width = np.zeros(lanes, np.uint64), np.full(lanes, 1 << _WIDE, np.uint64)
    narrow = np.uint16 if lanes <= 1 << 16 else np.int64  # sorted faster
    digits, lane_of = [np.zeros(0, np.uint64)], [np.zeros(0, narrow)]
    room = float((1 << _BITS) - vocabulary)
    whole = float(1 << _BITS)
    q, r, w, both = np.empty((4, lanes)), np.empty((4, lanes)), np.empty((4, lanes)), np.empty((4, 2, lanes))
    total, low, moved, ends, small = np.empty(lanes), np.empty((2, lanes)), np.empty(lanes, np.uint64), np.empty((2, lanes), np.uint64), np.empty(lanes, bool)
    (w0, w1, w2, w3), (q0, q1, q2, q3), (b0, b1, b2, b3), q_twice = w, q, both, q[:, None]
    begin, end = low
    first, range_ = ends
    c, s, edge, place = np.ones((_STEPS, 4, 1, lanes)), np.ones((_STEPS, 4, lanes)), np.empty((_STEPS, 4, 2, lanes)), np.empty((_STEPS, 4, lanes), np.int64)
    c[:, 3], s[:, 3] = vocabulary, 1 / vocabulary
    for t in range(n):
        if t % _STEPS == 0:
            k = min(_STEPS, n - t)
            part = counts[t : t + k].view(np.int16).reshape(k, 3, lanes, 4)
            np.maximum(part[..., 2], 1, out=c[:k, :3, 0])
            same = part[..., 1]
            np.divide(same, c[:k, :3, 0], out=s[:k, :3])
            kind = _KIND2[part[:, 2, :, 2]]
            kind += _KIND1[part[:, 1, :, 2]]
            kind += _late(np.arange(t, t + k))[:, None]
            kind *= lanes
            edge[:k, :3, 0] = part[..., 0]
            np.add(edge[:k, :3, 0], same, out=edge[:k, :3, 1])
            edge[:k, 3, 0] = ids[t : t + k]
            np.add(edge[:k, 3, 0], 1, out=edge[:k, 3, 1])
            np.add(offset, kind[:, None, :], out=place[:k])
            if not t:
                place[0, 0] = len(weights) - 1
        i = t % _STEPS
        at = place[i]
        weights.take(at, out=w, mode="clip")
        np.add(w0, w1, out=total)
        np.add(total, w2, out=total)
        np.add(total, w3, out=total)
        np.divide(room, total, out=total)
        np.floor(np.multiply(w, total, out=q), out=q)
        np.add(q0, q1, out=total)
        np.add(total, q2, out=total)
        np.subtract(whole, total, out=q3)
        np.multiply(q_twice, edge[i], out=both)
        np.floor(np.divide(both, c[i], out=both), out=both)
        np.add(b0, b1, out=low)
        np.add(low, b2, out=low)
        np.add(low, b3, out=low)
        np.subtract(end, begin, out=end)
        np.divide(np.multiply(q, s[i], out=r), end, out=r)
        w *= _DECAY
        w += r
        weights[at] = w
        ends[...] = low
        width >>= _SCALE
        base += np.multiply(width, first, out=moved)
        width *= range_
        k = np.less(width, _TOP, out=small).nonzero()[0]
        while len(k):
            b = base[k]
            lane_of.append(k.astype(narrow))
            digits.append(b >> _SHIFT)
            b &= _REST
            b <<= _DIGIT
            base[k] = b
            v = width[k]
            v <<= _DIGIT
            width[k] = v
            k = k[v < _TOP]
    by = np.concatenate(lane_of)
    ends = np.cumsum(np.bincount(by, minlength=lanes))
    return np.split(np.concatenate(digits)[np.argsort(by, kind="stable")], ends[:-1]), base


_SCALE = np.uint64(_BITS)


def decode_block(payload: bytes, n: int, vocabulary: int) -> np.ndarray:
    """The n ids of a block. Of each context the ids seen are kept sorted, so that a count is a search."""
    x = np.zeros(n, np.uint16)
    if not n:
        return x
    data = payload + bytes(16)
    code, at, width = int.from_bytes(data[:8], "big") >> 1, 8, 1 << _WIDE
    odd = data[7] & 1  # a bit that is read but does not belong to the range yet
    every: list[int] = []
    last: list[dict[int, list[int]]] = [{}, {}]
    weights: dict[int, list[float]] = {}
    room, whole, none = float((1 << _BITS) - vocabulary), float(1 << _BITS), []
    a = b = 0
    for i in range(n):
        ctx = (b, ((a * 0x9E3B + b * 0x6A0B + (a >> 5)) & 0xFFFFFFFF) & 0xFFFF)
        lists = [every, last[0].get(ctx[0], none), last[1].get(ctx[1], none)]
        count = [len(s) for s in lists]
        kind = int(_class(count[2], count[1], i))
        w = weights.setdefault(kind, list(_START))
        q = [v if c else 0.0 for v, c in zip(w, count)] + [w[3]]
        scale = room / (((q[0] + q[1]) + q[2]) + q[3])
        part = [int(v * scale) for v in q[:3]]
        part.append((1 << _BITS) - part[0] - part[1] - part[2])
        width >>= _BITS
        goal = code // width
        used = [(s, c, k) for s, c, k in zip(lists, count, part) if c]

        def start(v: int) -> int:
            return sum([bisect_left(s, v) * k // c for s, c, k in used], part[3] * v // vocabulary)

        low, high = 0, vocabulary  # start(low) <= goal < start(high)
        while high - low > 1:
            mid = (low + high) >> 1
            if start(mid) <= goal:
                low = mid
            else:
                high = mid
        v, begin, end = low, start(low), start(low + 1)
        code -= begin * width
        width *= end - begin
        while width < 1 << _LOW:
            more = odd << 32 | int.from_bytes(data[at : at + 4].ljust(4, b"\0"), "big")
            code, odd, at, width = code << 32 | more >> 1, more & 1, at + 4, width << 32
        r = [k * ((bisect_right(s, v) - bisect_left(s, v)) / c) if c else 0.0 for s, c, k in zip(lists, count, part)] + [part[3] * (1 / vocabulary)]
        weights[kind] = [u * _DECAY + e / (end - begin) if c else u for u, e, c in zip(w, r, [*count, 1])]
        insort(every, v)
        for k in (0, 1):
            insort(last[k].setdefault(ctx[k], []), v)
        x[i] = v
        a, b = b, v
    return x


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


_ASCII_WHITE = bytes(32 if i == 32 or 9 <= i <= 13 else 120 for i in range(256))
_WHITE_BEGINS = [b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a", b"\xe2\x80", b"\xe2\x81", b"\xe3\x80"]  # of white space beyond ASCII


def single_spaced(text: str) -> bool:
    """Whether surely no white space follows another."""
    data = text.encode()
    return b"  " not in data.translate(_ASCII_WHITE) and (text.isascii() or not any(x in data for x in _WHITE_BEGINS))


def tokenizer(ranks: dict[bytes, int]) -> Callable[[str], np.ndarray]:
    """Ids of a text. They come as a buffer, which is faster than a list; names of special tokens are text like any other.

    PATTERN looks ahead only to leave the last of several white spaces to what follows. Where none follows another, it parts
    the text as it does without that, which the library does faster.
    """
    import tiktoken

    if max(ranks.values()) >= 1 << 16:
        raise ValueError("ids must fit 16 bits")
    # the search for special tokens needs one
    whole, single = (tiktoken.Encoding("ranks", pat_str=p, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": max(ranks.values()) + 1}) for p in (PATTERN, PATTERN.replace(r"\s+(?!\S)|", "")))
    return lambda text: (single if single_spaced(text) else whole).encode_to_numpy(text, disallowed_special=()).astype(np.uint16)


_DOCS = pa.list_(pa.struct([("doc_id", pa.int64()), ("first", pa.int64()), ("n", pa.int32())]))
_NAMES = ["part", "block", "n_tokens", "crc32", "docs", "payload"]


def to_blocks(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """(part, block, n_tokens, crc32, docs, payload): blocks in the order in which a task reads its documents."""
    shared = docs.sparkSession.sparkContext.broadcast(load_ranks(p.ranks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(shared.value)
        part = TaskContext.get().partitionId()
        held: list[tuple[int | None, np.ndarray]] = []
        size = number = 0

        def cut(whole: bool) -> pa.RecordBatch:
            """Blocks of what is held; but for the last, an incomplete block waits."""
            nonlocal held, size, number
            blocks, members, room, now, entry = [], [], p.block, [], []
            rest = []
            for doc_id, ids, first in held:
                at = 0
                while True:
                    k = min(room, len(ids) - at)
                    now.append(ids[at : at + k])
                    entry.append({"doc_id": doc_id, "first": first + at, "n": k})
                    room -= k
                    at += k
                    if not room:
                        blocks.append(np.concatenate(now))
                        members.append(entry)
                        room, now, entry = p.block, [], []
                    if at >= len(ids):
                        break
            if entry:
                if whole:
                    blocks.append(np.concatenate(now))
                    members.append(entry)
                else:
                    rest = [(e["doc_id"], x, e["first"]) for e, x in zip(entry, now)]
            held, size = rest, sum(len(x) for _, x, _ in rest)
            payloads = encode_blocks(blocks, p.vocabulary)
            out = pa.RecordBatch.from_arrays(
                [pa.array([part] * len(blocks), pa.int32()), pa.array(range(number, number + len(blocks)), pa.int64()), pa.array([len(b) for b in blocks], pa.int32()), pa.array([zlib.crc32(b.astype("<u2").tobytes()) for b in blocks], pa.int64()), pa.array(members, _DOCS), pa.array(payloads, pa.binary())], _NAMES,
            )
            number += len(blocks)
            return out

        for b in K.slices(batches):
            for doc_id, text in zip(K.column(b, "doc_id"), K.column(b, "text")):
                ids = encode(text) if text else np.zeros(0, np.uint16)
                held.append((doc_id, ids, 0))
                size += len(ids)
                if size >= p.block * p.lanes:
                    yield cut(False)
        if held:
            yield cut(True)

    return K.narrow(docs).mapInArrow(run, "part int, block bigint, n_tokens int, crc32 bigint, docs array<struct<doc_id:bigint,first:bigint,n:int>>, payload binary")


def from_blocks(blocks: DataFrame, p: Params = Params()) -> DataFrame:
    """(doc_id, part, block, first, ids) of the pieces of documents, after the check of the CRC."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                x = decode_block(row["payload"], row["n_tokens"], p.vocabulary)
                if zlib.crc32(x.astype("<u2").tobytes()) != row["crc32"]:
                    raise ValueError(f"block {row['block']} of part {row['part']}: checksum")
                at, ids = 0, []
                for d in row["docs"]:
                    ids.append(x[at : at + d["n"]].astype(np.int32))
                    at += d["n"]
                yield pa.RecordBatch.from_arrays([pa.array([d["doc_id"] for d in row["docs"]], pa.int64()), pa.array([row["part"]] * len(ids), pa.int32()), pa.array([row["block"]] * len(ids), pa.int64()), pa.array([d["first"] for d in row["docs"]], pa.int64()), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "part", "block", "first", "ids"])

    return blocks.mapInArrow(run, "doc_id bigint, part int, block bigint, first bigint, ids array<int>")
