import random
import re

import numpy as np

from folioflow.llm import simhash as S


def test_fingerprint_does_not_depend_on_the_batch():
    texts = [f"alpha beta gamma {i} " * (i + 1) for i in range(30)]
    whole, n = S.fingerprints(texts)
    assert (whole == np.concatenate([S.fingerprints([t])[0] for t in texts])).all()
    assert S.fingerprints([None, "", "..."])[1].tolist() == [0, 0, 0]


def plain_fingerprint(text):
    """The fingerprint by whole numbers, bit by bit, from its definition alone; None without words."""
    m64 = (1 << 64) - 1

    def mix(h):
        h ^= h >> 31
        h = h * 0xBF58476D1CE4E5B9 & m64
        return h ^ h >> 29

    words = set()
    for w in re.findall(r"[^\W_]+", text or ""):
        h = 0
        for c in w:
            h = (h * 0x9E3779B97F4A7C15 + ord(c.lower() if len(c.lower()) == 1 else c)) & m64
        words.add(mix((h + len(w)) & m64) >> 24 << 24)
    if not words:
        return None
    bits = []
    for lane in range(4):
        hashes = [mix(mix(w + 0x9E3779B97F4A7C15 * (lane + 1) & m64)) for w in words]
        bits += [2 * sum(h >> b & 1 for h in hashes) > len(words) for b in range(64)]
    return sum(b << i for i, b in enumerate(bits))


def test_fingerprints_against_whole_numbers(documents):
    texts = sorted((r.text for r in documents.collect() if r.text), key=len)[:60] + ["ÄÖ straße Ünïcode 漢字 x_y", "a", ""]
    fp, n = S.fingerprints(texts)
    for t, row, k in zip(texts, fp.tolist(), n):
        want = plain_fingerprint(t)
        assert (k > 0) == (want is not None)
        assert want is None or sum(w << 64 * i for i, w in enumerate(row)) == want


def all_near(a, b, radius):
    return [(i, j) for i in range(len(a)) for j in np.flatnonzero(np.bitwise_count(a[i] ^ b).sum(1, dtype=int) <= radius).tolist()]


def joined(a, b, radius, most=1 << 19):
    return sorted((x, y) for u, v in S.near(a, b, radius, most) for x, y in zip(u.tolist(), v.tolist()))


def test_near_is_all_pairs_of_the_table(documents):
    fp, n = S.fingerprints([r.text for r in documents.collect()])
    fp = np.unique(fp[n > 0], axis=0)
    want = [(i, j) for i, j in all_near(fp, fp, 48) if i < j]
    assert len(want) > 10 and joined(fp, fp, 48) == want


def brute(rows, radius):
    """Groups {(id, fingerprint)} and the links of each, by whole numbers and all pairs."""
    nodes = {}
    for i, t in rows:
        f = plain_fingerprint(t)
        if i is not None and f is not None:
            nodes.setdefault(f, set()).add(i)
    fs = list(nodes)
    label, links = list(range(len(fs))), [0] * len(fs)
    near = [(a, b) for a in range(len(fs)) for b in range(a) if (fs[a] ^ fs[b]).bit_count() <= radius]
    for a, b in near:
        links[a] += 1
        links[b] += 1
    changed = True
    while changed:
        changed = False
        for a, b in near:
            if label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    out = {}
    for f, g, k in zip(fs, label, links):
        for i in nodes[f]:
            out.setdefault(g, []).append((i, f, k))
    return [x for x in out.values() if len(x) > 1]


def brute_groups(rows, p):
    return {frozenset(i for i, *_ in g) for g in brute(rows, p.radius)}


def many_copies():
    """Texts with copies in which some words are replaced, ids that repeat, and a large group."""
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(6))
    rows = []
    for k in range(60):
        base = [word() for _ in range(60)]
        for _ in range(25 if k == 0 else r.choice([1, 1, 2, 3])):
            rows.append((len(rows), " ".join(w if r.random() > 0.06 else word() for w in base)))
    return rows + [(3, "another text altogether " + word()), (5, rows[50][1]), (None, rows[0][1]), (900, rows[7][1]), (901, rows[7][1])]


def check_groups(spark, rows, p):
    got = {}
    for r in S.groups(spark.createDataFrame(rows, "doc_id bigint, text string"), p).collect():
        got.setdefault(r.group_id, []).append((r.doc_id, r.links, r.keep))
    want = brute(rows, p.radius)
    assert sorted(sorted((i, k) for i, k, _ in g) for g in got.values()) == sorted(sorted((i, k) for i, _, k in g) for g in want)
    assert all(g == min(i for i, *_ in x) and sum(keep for *_, keep in x) == 1 for g, x in got.items())


def test_groups_and_links_against_brute_force(spark):
    check_groups(spark, many_copies(), S.Params())


def border_copies():
    """Pairs of texts, most of which differ by some bits less or more than the radius."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(6))
    bases = [[word() for _ in range(60)] for _ in range(250)]
    return list(enumerate(" ".join(w if r.random() > share else word() for w in base) for base in bases for share in (0, 0.15)))


def test_pairs_at_the_radius_are_linked(spark):
    rows = border_copies()
    fs = [plain_fingerprint(t) for _, t in rows]
    assert sum(42 <= (a ^ b).bit_count() <= 48 for a, b in zip(fs[::2], fs[1::2])) > 50
    check_groups(spark, rows, S.Params())


def test_blocks_lose_nothing(spark):
    check_groups(spark, many_copies(), S.Params(block=9, least=1))


def test_every_pair_at_every_distance_up_to_the_radius_is_found_once():
    """Also where the bits differ in few words, or as evenly as they can."""
    r, n = np.random.default_rng(5), 2000
    bits = r.integers(0, 2, (n, 256), dtype=np.uint8)
    for d in (0, 1, 24, 47, 48, 49):
        weight = r.random((n, 256)) + np.where(np.arange(n)[:, None] % 2, np.arange(256) // 64 * (np.arange(n) % 3)[:, None], np.arange(256) % 16 * (np.arange(n) % 5)[:, None])
        other = bits.copy()
        np.put_along_axis(other, flip := np.argsort(weight, 1)[:, :d], 1 - np.take_along_axis(bits, flip, 1), 1)
        a, b = (np.packbits(v, axis=1, bitorder="little").view(np.uint64) for v in (bits, other))
        assert joined(a, b, 48) == ([(i, i) for i in range(n)] if d <= 48 else [])
        assert joined(both := np.concatenate([a, b]), both, 48) == ([(i, n + i) for i in range(n)] if d <= 48 else [])


def test_near_for_other_radii_and_rows_that_share_their_values():
    r = np.random.default_rng(6)
    base = r.integers(0, 2**63, (3, 4)).astype(np.uint64)
    a = base[r.integers(0, 3, 150)]
    for _ in range(12):
        a[np.arange(150), r.integers(0, 4, 150)] ^= np.uint64(1) << r.integers(0, 64, 150).astype(np.uint64)
    a = np.unique(a, axis=0)
    for radius in (0, 1, 5, 14, 20, 48):
        assert joined(a, a, radius, 40) == [(i, j) for i, j in all_near(a, a, radius) if i < j]
        assert joined(a[:70].copy(), a[50:].copy(), radius, 40) == all_near(a[:70], a[50:], radius)


def test_groups_with_production_parameters(spark, documents):
    got = {}
    for r in S.groups(documents).collect():
        got.setdefault(r.group_id, set()).add(r.doc_id)
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    assert {frozenset(x) for x in got.values()} == brute_groups(rows, S.Params())
    check_groups(spark, rows, S.Params())


def test_keep_one_keeps_unrelated_texts_of_one_id(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(1, text, "a"), (1, "nothing of the kind in here", "b"), (1, None, "c"), (1, None, "d"), (2, text, "e"), (2, "a third thing", "f"), (2, "a third thing", "g"), (3, text + " x", "h")]
    got = S.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string, tag string")).collect()
    assert sorted(r.tag for r in got) == ["a", "b", "c", "d", "g"]


def test_components(spark):
    pairs = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (7, 300), (299, 300), (101, 105)]
    got = dict(map(tuple, S.components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()))
    assert {k for k, v in got.items() if v == 0} == {*range(41), 299, 300}
    assert {k for k, v in got.items() if v == 100} == {100, 101, 105}


def test_odd_rows(odd_docs, no_docs):
    got = {r.doc_id: r.group_id for r in S.groups(odd_docs).collect()}
    assert got == {1: 1, 2: 1}
    kept = S.keep_one(odd_docs)
    assert kept.schema == odd_docs.schema
    assert sorted(r.doc_id if r.doc_id is not None else -1 for r in kept.collect()) == [-1, 1, 3, 4, 5, 6, 7]
    assert S.groups(no_docs).count() == 0 and S.keep_one(no_docs).count() == 0


def test_repeated_rows_alone_keep_one(spark):
    d = spark.createDataFrame([(1, "some words that repeat here"), (1, "some words that repeat here"), (2, "others")], "doc_id bigint, text string")
    assert sorted(r.doc_id for r in S.keep_one(d).collect()) == [1, 2]
