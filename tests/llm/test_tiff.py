import itertools
import struct
import zlib

import numpy as np
import pytest

from folioflow.llm import tiff as T

KINDS = [(o, b, c, p, d, t, s) for o, b, c, p, d, t, s in itertools.product("<>", (False, True), (1, 5, 8, 32773), (1, 2, 3), ("u1", "u2", "i4", "f4", "f8"), (None, (16, 16)), (1, 3)) if (p == 1) or (p == 3) == (d[0] == "f")]


def test_round_trips():
    r = np.random.default_rng(0)
    for order, big, comp, pred, dtype, tile, samples in KINDS:
        px = r.integers(0, 5, (19, 23, samples)).astype(dtype) if dtype[0] != "f" else r.normal(size=(19, 23, samples)).astype(dtype)
        data = T.encode([{"pixels": px, "compression": comp, "predictor": pred, "tile": tile, "rows": 5}, {"pixels": px[:3]}], order, big)
        a, b = T.decode(data)
        assert (a.pixels == px).all() and (b.pixels == px[:3]).all() and a.tiled == bool(tile)


@pytest.mark.parametrize("data", [b"", b"a", b"aaaa", bytes(range(256)) * 40, b"ab" * 9000, bytes(np.random.default_rng(1).integers(0, 256, 30_000, np.uint8))])
def test_codecs(data):
    assert T.lzw_decode(T.lzw_encode(data)) == data
    assert T.unpack_bits(T.pack_bits(data)) == data


def test_known_packbits():
    assert T.unpack_bits(bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")


def _tiny(tags):
    body = struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", t, 4, 1, v) for t, v in sorted(tags.items())) + bytes(4)
    return b"II" + struct.pack("<HI", 42, 12) + b"\xa5\x5a\x0f\xf0" + body


def test_bits_and_separate_planes():
    one = {256: 8, 257: 2, 258: 1, 259: 1, 273: 8, 278: 2, 279: 2}
    assert next(T.decode(_tiny(one))).pixels[:, :, 0].tolist() == [[1, 0, 1, 0, 0, 1, 0, 1], [0, 1, 0, 1, 1, 0, 1, 0]]
    four = one | {256: 4, 258: 4, 279: 4}
    assert next(T.decode(_tiny(four))).pixels[:, :, 0].tolist() == [[10, 5, 5, 10], [0, 15, 15, 0]]


def test_odd_rows(spark):
    good = T.render(np.linspace(-1, 1, 64, dtype=np.float32))
    loop = bytearray(T.encode([{"pixels": np.zeros((2, 2, 1), np.uint8)}]))
    loop[-4:] = loop[4:8]
    rows = [(1, good, 1), (1, good, 2), (None, good, 3), (2, None, 4), (3, b"", 5), (4, b"no", 6), (5, good[: len(good) // 2], 7), (6, bytes(loop), 8), (7, b"II*\0\0\0\0\0", 9)]
    got = T.pages(spark.createDataFrame(rows, "k bigint, data binary, page int"), "k", "data").collect()
    by = {}
    for r in got:
        by.setdefault(r.id, []).append(r)
    assert len(by[1]) == 6 and len(by[None]) == 3
    assert all(len(by[k]) == 1 and by[k][0].page is None and by[k][0].error for k in (2, 3, 4, 7))
    assert len(by[5]) > 1 and all(r.error is None for r in by[5][:-1]) and by[5][-1].error  # cut in the middle: its first pages stay
    assert [r.page for r in by[6]] == [0, None] and "loop" in by[6][1].error
    assert T.pages(spark.createDataFrame([], "k bigint, data binary"), "k", "data").count() == 0


def test_vectors(spark):
    d = spark.createDataFrame([(1, [0.5] * 64), (2, None), (3, []), (4, [0.1, None])], "vec_id bigint, embedding array<float>")
    got = {r.id: r.content for r in T.rendered(d).collect()}
    assert got[2] is got[3] is got[4] is None
    assert [p.compression for p in T.decode(bytes(got[1]))] == [32773, 5, 8]
    assert zlib.crc32(next(T.decode(bytes(got[1]))).pixels.tobytes())


def test_sizes_beyond_the_data_are_refused():
    for tags in ({256: 1 << 30, 257: 1 << 30}, {256: 8, 257: 1 << 31}):
        with pytest.raises(ValueError, match="than the data can hold|missing"):
            next(T.decode(_tiny({258: 8, 259: 1, 273: 8, 278: 1 << 31, 279: 2} | tags)))
