"""Media columns: TIFF pages.

``decode`` walks the image directories of classic and big TIFF in either byte order, reads strips or tiles that are
stored plain or with PackBits, LZW or deflate, undoes horizontal (2) and floating-point (3) predictors, joins separate
planes, and gives one page a directory. ``pages`` applies it to a binary column: one row a page, pixels row by row with
interleaved samples, little-endian, in the sample type (1-, 2- and 4-bit samples as bytes).

Defined cases: null and empty content and content that cannot be decoded give one row with page null and the reason in
``error``; pages before a broken one are kept; a null id stays null; rows that repeat are decoded each; an empty table
gives no rows; other columns are ignored. Directories that form a loop are an error.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4, 16: 8, 17: 8, 18: 8}
_FORMATS = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}


@dataclass
class Page:
    width: int
    height: int
    samples: int
    bits: int
    sample_format: int
    compression: int
    predictor: int
    tiled: bool
    pixels: np.ndarray


def unpack_bits(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        c = data[i]
        i += 1
        if c < 128:
            out += data[i : i + c + 1]
            i += c + 1
        elif c > 128:
            out += data[i : i + 1] * (257 - c)
            i += 1
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        j = i
        while j + 1 < n and j - i < 127 and data[j + 1] == data[i]:
            j += 1
        if j > i:
            out += bytes((257 - (j - i + 1), data[i]))
            i = j + 1
            continue
        j = i + 1
        while j < n and j - i < 128 and (j + 1 >= n or data[j] != data[j + 1]):
            j += 1
        out.append(j - i - 1)
        out += data[i:j]
        i = j
    return bytes(out)


def lzw_decode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, highest bit first, that widen one code early."""
    base = [bytes((i,)) for i in range(256)] + [b"", b""]
    table, width, out, last = list(base), 9, [], b""
    acc = bits = 0
    for byte in data:
        acc = (acc << 8) | byte
        bits += 8
        if bits < width:
            continue
        bits -= width
        code = acc >> bits
        acc &= (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = list(base), 9, b""
            continue
        if code < len(table):
            entry = table[code]
        elif code == len(table) and last:
            entry = last + last[:1]
        else:
            raise ValueError("LZW code beyond its table")
        out.append(entry)
        if last:
            table.append(last + entry[:1])
            if len(table) + 1 >= 1 << width and width < 12:
                width += 1
        last = entry
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    out, acc, bits, width = bytearray(), 0, 0, 9
    table = {bytes((i,)): i for i in range(256)}
    n = 258

    def put(code: int) -> None:
        nonlocal acc, bits
        acc = (acc << width) | code
        bits += width
        while bits >= 8:
            bits -= 8
            out.append((acc >> bits) & 255)
        acc &= (1 << bits) - 1

    put(256)
    w = b""
    for i in range(len(data)):
        x = data[i : i + 1]
        if w + x in table:
            w += x
            continue
        put(table[w])
        table[w + x] = n
        n += 1
        if n >= 1 << width and width < 12:
            width += 1
        elif n >= 4094:
            put(256)
            table = {bytes((i,)): i for i in range(256)}
            n, width = 258, 9
        w = x
    if w:
        put(table[w])
        n += 1
        if n >= 1 << width and width < 12:
            width += 1
    put(257)
    if bits:
        out.append((acc << (8 - bits)) & 255)
    return bytes(out)


def _expand(data: bytes, compression: int) -> bytes:
    if compression == 1:
        return data
    if compression == 5:
        return lzw_decode(data)
    if compression in (8, 32946):
        return zlib.decompress(data)
    if compression == 32773:
        return unpack_bits(data)
    raise ValueError(f"compression {compression}")


def _dtype(bits: int, fmt: int) -> np.dtype:
    kind = {1: "u", 2: "i", 3: "f", 4: "u"}.get(fmt)
    if kind is None or bits not in ((16, 32, 64) if kind == "f" else (1, 2, 4, 8, 16, 32, 64)):
        raise ValueError(f"sample format {fmt} of {bits} bits")
    return np.dtype(f"{kind}{max(1, bits // 8)}")


def _block(raw: bytes, rows: int, cols: int, per: int, bits: int, dtype: np.dtype, order: str, predictor: int) -> np.ndarray:
    """(rows, cols, per) samples of one strip or tile."""
    if bits < 8:
        wide = -(-cols * per * bits // 8)
        b = np.unpackbits(np.frombuffer(raw, np.uint8, rows * wide).reshape(rows, wide), axis=1)
        b = b[:, : cols * per * bits].reshape(rows, cols * per, bits)
        x = (b * (1 << np.arange(bits - 1, -1, -1))).sum(2).astype(np.uint8).reshape(rows, cols, per)
        if predictor == 2:
            x = (np.cumsum(x, axis=1, dtype=np.uint8) & ((1 << bits) - 1)).astype(np.uint8)
        return x
    n = rows * cols * per
    if predictor == 3:
        size = dtype.itemsize
        b = np.frombuffer(raw, np.uint8, n * size).reshape(rows, cols * size, per)
        b = np.cumsum(b, axis=1, dtype=np.uint8).reshape(rows, size, cols * per)  # planes of bytes, the highest first
        return np.ascontiguousarray(b[:, ::-1].transpose(0, 2, 1)).view(dtype.newbyteorder("<")).reshape(rows, cols, per)
    x = np.frombuffer(raw, dtype.newbyteorder(order), n).astype(dtype).reshape(rows, cols, per)
    if predictor == 2:
        whole = x.view(f"u{dtype.itemsize}")
        x = np.cumsum(whole, axis=1, dtype=whole.dtype).view(dtype)
    return x


def decode(data: bytes) -> Iterator[Page]:
    if data[:2] not in (b"II", b"MM"):
        raise ValueError("no TIFF header")
    order = "<" if data[:2] == b"II" else ">"
    version = struct.unpack_from(order + "H", data, 2)[0]
    if version not in (42, 43):
        raise ValueError(f"TIFF version {version}")
    big = version == 43
    off, count_at, width = ("Q", "Q", 8) if big else ("I", "H", 4)
    at, seen = struct.unpack_from(order + off, data, 8 if big else 4)[0], set()
    while at:
        if at in seen:
            raise ValueError("directories form a loop")
        seen.add(at)
        n = struct.unpack_from(order + count_at, data, at)[0]
        entry = at + (8 if big else 2)
        tags: dict[int, list] = {}
        for i in range(n):
            e = entry + i * (20 if big else 12)
            tag, kind, count = struct.unpack_from(order + "HH" + off, data, e)
            if kind not in _FORMATS or not count:
                continue
            where = e + 4 + width
            if _SIZES[kind] * count > width:
                where = struct.unpack_from(order + off, data, where)[0]
            tags[tag] = list(struct.unpack_from(f"{order}{count}{_FORMATS[kind]}", data, where))
        yield _page(data, tags, order)
        at = struct.unpack_from(order + off, data, entry + n * (20 if big else 12))[0]


def _page(data: bytes, tags: dict[int, list], order: str) -> Page:
    one = lambda tag, default: tags.get(tag, [default])[0]
    w, h = one(256, 0), one(257, 0)
    if w <= 0 or h <= 0:
        raise ValueError("no size")
    samples, bits, fmt, compression, predictor, planar = one(277, 1), one(258, 1), one(339, 1), one(259, 1), one(317, 1), one(284, 1)
    if any(b != bits for b in tags.get(258, [])):
        raise ValueError("samples of several sizes")
    if predictor not in (1, 2, 3):
        raise ValueError(f"predictor {predictor}")
    dtype = _dtype(bits, fmt)
    tiled = 324 in tags
    tw, th = (one(322, 0), one(323, 0)) if tiled else (w, min(h, one(278, h)))
    if tw <= 0 or th <= 0:
        raise ValueError("no tile size")
    offsets, sizes = tags.get(324 if tiled else 273), tags.get(325 if tiled else 279)
    across, down = -(-w // tw), -(-h // th)
    planes, per = (samples, 1) if planar == 2 else (1, samples)
    if not offsets or not sizes or min(len(offsets), len(sizes)) < across * down * planes:
        raise ValueError("strips or tiles are missing")
    if max(h * w, th * tw) * samples * bits // 8 > 4096 * len(data):  # no codec packs more densely
        raise ValueError("the size is more than the data can hold")
    out = np.zeros((h, w, samples), dtype)
    for k in range(across * down * planes):
        plane, place = divmod(k, across * down)
        y, x = place // across * th, place % across * tw
        rows = th if tiled else min(th, h - y)
        raw = data[offsets[k] : offsets[k] + sizes[k]]
        block = _block(_expand(raw, compression), rows, tw, per, bits, dtype, order, predictor)
        part = block[: h - y, : w - x]
        if planes > 1:
            out[y : y + rows, x : x + tw, plane] = part[:, :, 0]
        else:
            out[y : y + rows, x : x + tw] = part
    return Page(w, h, samples, bits, fmt, compression, predictor, tiled, out)


def encode(pages: list[dict], order: str = "<", big: bool = False) -> bytes:
    """A TIFF of pages: dict(pixels (h, w, samples), compression, predictor, rows or tile (w, h))."""
    out = bytearray((b"II" if order == "<" else b"MM") + (struct.pack(order + "HHHQ", 43, 8, 0, 0) if big else struct.pack(order + "HI", 42, 0)))
    off, link = ("Q", 8) if big else ("I", 4)
    last = 8 if big else 4  # where the place of the next directory goes
    for p in pages:
        px, comp, pred = p["pixels"], p.get("compression", 1), p.get("predictor", 1)
        h, w, samples = px.shape
        tile = p.get("tile")
        bw, bh = tile or (w, p.get("rows", h))
        offsets, sizes = [], []
        for y in range(0, h, bh):
            for x in range(0, w, bw):
                b = px[y : y + bh, x : x + bw]
                if tile:
                    b = np.pad(b, ((0, bh - b.shape[0]), (0, bw - b.shape[1]), (0, 0)), mode="edge")
                size = b.dtype.itemsize
                if pred == 2:
                    u = b.view(f"u{size}")
                    b = np.diff(u, axis=1, prepend=u[:, :1] * 0).astype(u.dtype).view(b.dtype)
                if pred == 3:
                    planes = np.ascontiguousarray(b.astype(b.dtype.newbyteorder("<"))).view(np.uint8).reshape(b.shape[0], -1, size)[:, :, ::-1].transpose(0, 2, 1).reshape(b.shape[0], b.shape[1] * size, samples)
                    raw = np.diff(planes, axis=1, prepend=planes[:, :1] * 0).astype(np.uint8).tobytes()
                else:
                    raw = b.astype(b.dtype.newbyteorder(order)).tobytes()
                raw = {1: bytes, 5: lzw_encode, 8: zlib.compress, 32773: pack_bits}[comp](raw)
                offsets.append(len(out))
                sizes.append(len(raw))
                out += raw
        out += bytes(len(out) % 2)
        fmt = {"u": 1, "i": 2, "f": 3}[px.dtype.kind]
        tags = {256: [w], 257: [h], 258: [px.dtype.itemsize * 8] * samples, 259: [comp], 262: [1], 277: [samples], 317: [pred], 339: [fmt] * samples}
        tags |= {322: [bw], 323: [bh], 324: offsets, 325: sizes} if tile else {273: offsets, 278: [bh], 279: sizes}
        body = []
        for tag in sorted(tags):
            v = tags[tag]
            packed = struct.pack(f"{order}{len(v)}{off}", *v)
            if len(packed) > link:
                at = len(out)
                out += packed
                packed = struct.pack(order + off, at)
            body.append(struct.pack(order + "HH" + off, tag, 16 if big else 4, len(v)) + packed.ljust(link, b"\0"))
        at = len(out)
        out[last : last + link] = struct.pack(order + off, at)
        out += struct.pack(order + ("Q" if big else "H"), len(body)) + b"".join(body)
        last = len(out)
        out += bytes(link)
    return bytes(out)


_SCHEMA = "id bigint, page int, width int, height int, samples int, bits int, sample_format int, compression int, predictor int, tiled boolean, pixels binary, pixel_sum double, error string"
_NAMES = [x.split()[0] for x in _SCHEMA.split(", ")]
_TYPES = [pa.int64(), *[pa.int32()] * 8, pa.bool_(), pa.binary(), pa.float64(), pa.string()]


def pages(media: DataFrame, id_col: str, content_col: str) -> DataFrame:
    """One row a page of each row of ``media``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, size = [], 0
            for key, data in zip(b.column(0).to_pylist(), b.column(1)):
                data = data.as_py()
                n = 0
                try:
                    if not data:
                        raise ValueError("empty")
                    for n, p in enumerate(decode(data), 1):
                        px = p.pixels.astype(p.pixels.dtype.newbyteorder("<"))
                        rows.append((key, n - 1, p.width, p.height, p.samples, p.bits, p.sample_format, p.compression, p.predictor, p.tiled, px.tobytes(), float(p.pixels.sum(dtype=np.float64)), None))
                        size += px.nbytes
                    if not n:
                        raise ValueError("no image directory")
                except (ValueError, struct.error, zlib.error, IndexError, OverflowError, MemoryError) as e:
                    rows.append((key, *[None] * 11, str(e) or type(e).__name__))
                if size > 1 << 24:
                    yield _batch(rows)
                    rows, size = [], 0
            yield _batch(rows)

    return media.select(F.col(id_col).cast("bigint").alias("id"), F.col(content_col).cast("binary").alias("content")).mapInArrow(run, _SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_TYPES)], _NAMES)


def render(vector: np.ndarray) -> bytes:
    """A TIFF of three pages that shows a vector: bytes with PackBits, 16 bits in LZW tiles, and its floats deflated."""
    n = len(vector)
    w = max(1, int(np.ceil(np.sqrt(n))))
    v = np.zeros(w * w, np.float32)
    v[:n] = vector
    q = np.zeros(w * w, np.uint8)
    q[:n] = np.clip(np.floor((vector.astype(np.float64) + 1) * 127.5), 0, 255)
    shape = (w, w, 1)
    return encode([
        {"pixels": q.reshape(shape), "compression": 32773, "rows": 3},
        {"pixels": (q.astype(np.uint16) * 257).reshape(shape), "compression": 5, "predictor": 2, "tile": (16, 16)},
        {"pixels": v.reshape(shape), "compression": 8, "predictor": 3, "rows": 4},
    ])


def rendered(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, content) with a vector's picture; a null or empty vector or one with nulls has null content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [render(np.array(v, np.float32)) if v and None not in v else None for v in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary())], ["id", "content"])

    return vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("v")).mapInArrow(run, "id bigint, content binary")


ORACLE_SQL = """
with v as (select vec_id, embedding, list_sum(list_transform(embedding, lambda x: greatest(0, least(255, floor((x::double + 1) * 127.5))))) as q,
                  ceil(sqrt(len(embedding)))::int as w from embeddings)
select vec_id, k.page, w as width, w as height, k.bits, k.compression, k.predictor, k.tiled, w * w * k.bits // 8 as n_bytes,
       round(case k.page when 0 then q when 1 then 257 * q else list_sum(list_transform(embedding, lambda x: x::double)) end, 4) as pixel_sum, cast(null as varchar) as error
from v, (values (0, 8, 32773, 1, false), (1, 16, 5, 2, true), (2, 32, 8, 3, false)) k(page, bits, compression, predictor, tiled)
"""
