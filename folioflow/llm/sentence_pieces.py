"""SentencePiece encoding and decoding for vocabularies of the merge type.

Symbols start as characters. An agenda (heap) holds the adjacent pairs whose union is a piece, best score first and
leftmost among equals; the best is merged and its new neighbours join the agenda until it is empty. Characters that are
no piece become byte pieces, or the unknown piece where the vocabulary has none. Blanks are written as U+2581, and one
is put before the text. Where no piece joins a symbol to a following U+2581 or line feed, texts are cut there and each
distinct part is merged once a worker (up to ``cache`` parts), which changes no id.

Defined cases: a null text has null ids, an empty one no ids; a null doc_id stays null; rows that repeat are encoded
each; an empty table gives no rows; other columns are ignored. Bytes that are no UTF-8 decode to U+FFFD each.
"""

from __future__ import annotations

import codecs
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textkit as K

MARK = "▁"
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"

codecs.register_error("folioflow_each_byte", lambda e: ("�", e.start + 1))


@dataclass(frozen=True)
class Vocabulary:
    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    kinds: tuple[int, ...]  # 1 normal, 2 unknown, 3 control, 6 byte

    @staticmethod
    def load(path: str = DEFAULT_MODEL) -> "Vocabulary":
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = range(m.get_piece_size())
        kind = [6 if m.is_byte(i) else 3 if m.is_control(i) else 2 if m.is_unknown(i) else 1 for i in n]
        return Vocabulary(tuple(m.id_to_piece(i) for i in n), tuple(m.get_score(i) for i in n), tuple(kind))


class Encoder:
    def __init__(self, v: Vocabulary, cache: int = 500_000):
        normal = [i for i, k in enumerate(v.kinds) if k == 1]
        self.ids = {v.pieces[i]: i for i in normal}
        scores = sorted({v.scores[i] for i in normal}, reverse=True)
        place = {s: r for r, s in enumerate(scores)}
        self.rank = {v.pieces[i]: place[v.scores[i]] for i in normal if len(v.pieces[i]) > 1}
        self.union = [""] * len(scores)
        for piece, r in self.rank.items():
            self.union[r] = piece
        self.bytes = {int(v.pieces[i][3:5], 16): i for i, k in enumerate(v.kinds) if k == 6}
        self.unknown = next((i for i, k in enumerate(v.kinds) if k == 2), 0)
        whole = any(MARK in p.lstrip(MARK) for p in self.rank)
        cut_line = not any("\n" in p for p in self.rank)
        if whole:
            self.parts = re.compile(r"[^\n]+|\n" if cut_line else r"(?s).+")
        else:
            self.parts = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n" if cut_line else f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        self.cache: dict[str, bytes] = {}
        self.limit = cache
        self.marked = [k == 1 and p.startswith(MARK) for p, k in zip(v.pieces, v.kinds)]
        self.decoded = [chr(0xDC00 + int(p[3:5], 16)) if k == 6 and int(p[3:5], 16) > 127 else chr(int(p[3:5], 16)) if k == 6 else "" if k == 3 else " ⁇ " if k == 2 else p.replace(MARK, " ") for p, k in zip(v.pieces, v.kinds)]

    def symbols(self, part: str) -> list[str]:
        """The symbols that are left when the agenda is empty."""
        sym = list(part)
        n = len(sym)
        rank, union, shift = self.rank.get, self.union, n.bit_length()  # an agenda entry is (rank, place) in one number
        low = (1 << shift) - 1
        heap = []
        a = sym[0]
        for i in range(1, n):
            b = sym[i]
            r = rank(a + b)
            if r is not None:
                heap.append((r << shift) + i - 1)
            a = b
        heapify(heap)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            k = heappop(heap)
            i, p = k & low, union[k >> shift]
            j = nxt[i]
            if j >= n or not sym[i] or sym[i] + sym[j] != p:
                if not (j < n and sym[i] and self.rank.get(sym[i] + sym[j]) == k >> shift):
                    continue  # one of the two has merged since
                p = sym[i] + sym[j]
            sym[i], sym[j] = p, ""
            j = nxt[i] = nxt[j]
            if j < n:
                prv[j] = i
                r = rank(p + sym[j])
                if r is not None:
                    heappush(heap, (r << shift) + i)
            h = prv[i]
            if h >= 0:
                r = rank(sym[h] + p)
                if r is not None:
                    heappush(heap, (r << shift) + h)
        return [s for s in sym if s]

    def part(self, part: str) -> bytes:
        out = []
        for s in self.symbols(part):
            i = self.ids.get(s)
            if i is not None:
                out.append(i)
            elif self.bytes:
                out += [self.bytes[b] for b in s.encode("utf-8", "surrogatepass")]
            else:
                out.append(self.unknown)
        if len(self.cache) >= self.limit:
            self.cache.clear()
        if len(part) <= 64:
            self.cache[part] = (found := array("i", out).tobytes())
            return found
        return array("i", out).tobytes()

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        get, part = self.cache.get, self.part
        parts = self.parts.findall(MARK + text.replace(" ", MARK))
        return np.frombuffer(b"".join([get(s) or part(s) for s in parts]), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        text = "".join(map(self.decoded.__getitem__, ids.tolist()))
        if text[:1] == " " and self.marked[next(i for i in ids if self.decoded[i])]:
            text = text[1:]
        if any("\udc80" <= x for x in set(text) if x <= "\udcff"):
            text = text.encode("utf-8", "surrogateescape").decode("utf-8", "folioflow_each_byte")
        return text


def encode(docs: DataFrame, model: str = DEFAULT_MODEL) -> DataFrame:
    """(doc_id, n_tokens, ids, round_trip); round_trip tells whether decoding the ids gives the text again."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = Encoder(shared.value)
        for b in K.slices(batches, size=1 << 22):
            texts = K.column(b, "text")
            ids = [None if t is None else e.encode(t) for t in texts]
            same = [None if t is None else e.decode(i) == t for t, i in zip(texts, ids)]
            n = [0 if i is None else len(i) for i in ids]
            flat = np.concatenate([*(i for i in ids if i is not None), np.zeros(0, np.int32)])
            offsets = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32), mask=np.array([*(i is None for i in ids), False]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if i is None else k for i, k in zip(ids, n)], pa.int32()), pa.ListArray.from_arrays(offsets, pa.array(flat)), pa.array(same, pa.bool_())], ["doc_id", "n_tokens", "ids", "round_trip"])

    return K.narrow(docs).mapInArrow(run, "doc_id bigint, n_tokens int, ids array<int>, round_trip boolean")


def decode(tokens: DataFrame, model: str = DEFAULT_MODEL) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); null ids give a null text."""
    shared = tokens.sparkSession.sparkContext.broadcast(Vocabulary.load(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = Encoder(shared.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if x is None else e.decode(np.array(x, np.int32)) for x in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return tokens.selectExpr("cast(doc_id as bigint) doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


def mismatches(docs: DataFrame, model: str = DEFAULT_MODEL) -> DataFrame:
    """(doc_id, ids, library_ids) where the ids are not those of the sentencepiece library, compared in Arrow batches."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        library, e = sentencepiece.SentencePieceProcessor(model_file=model), Encoder(shared.value)
        for b in K.slices(batches):
            rows = []
            texts = [(i, t) for i, t in zip(K.column(b, "doc_id"), K.column(b, "text")) if t is not None]
            for (i, t), theirs in zip(texts, library.encode([t for _, t in texts], num_threads=1)):
                if (own := e.encode(t).tolist()) != theirs:
                    rows.append((i, own, theirs))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), *(pa.array([r[k] for r in rows], pa.list_(pa.int32())) for k in (1, 2))], ["doc_id", "ids", "library_ids"])

    return K.narrow(docs).mapInArrow(run, "doc_id bigint, ids array<int>, library_ids array<int>")
