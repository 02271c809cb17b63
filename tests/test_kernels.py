import re

from hypothesis import given, settings
from hypothesis import strategies as st

from folioflow.functions import kernels as K
from folioflow.functions import patterns as P

TEXT = st.text(alphabet="ab 。！.;\n第一条、", max_size=120)


@given(TEXT, st.integers(1, 40))
@settings(max_examples=150, deadline=None)
def test_windows_and_packing_keep_the_text(text, n):
    assert "".join(K.windows(text, n, n)) == text
    s = K.sentences(text)
    spans = K.pack(s, n, 0)
    assert [i for a, b in spans for i in range(a, b)] == list(range(len(s)))


@given(TEXT, st.integers(4, 40))
@settings(max_examples=150, deadline=None)
def test_overlap_never_exceeds_its_limit(text, n):
    s = K.sentences(text)
    spans = K.pack(s, n, n // 3)
    for (a, b), (c, d) in zip(spans, spans[1:]):
        assert a <= c <= b and d > b and sum(map(len, s[c:b])) <= n // 3


@given(TEXT, st.integers(2, 40), st.floats(0, 0.4))
@settings(max_examples=150, deadline=None)
def test_cursor_covers_all_but_white_space(text, n, ratio):
    covered = set()
    for a, b, content in K.cursor(text, n, ratio):
        assert content and b - a <= n
        covered |= set(range(a, b))
    assert all(text[i].isspace() for i in range(len(text)) if i not in covered)


def test_cursor_halves_in_a_long_sentence():
    text = "a" * 60 + "。" + "b" * 200 + "。"
    assert [x[:2] for x in K.cursor(text, 100, 0.2)] == [(0, 61), (41, 61), (51, 61), (56, 61), (59, 61), (60, 160), (140, 240), (220, 262)]
    assert len(K.cursor(text, 100, 0.2, drop_contained=True)) < 8


def test_sentences_take_their_closers():
    assert K.sentences('他说"你好吗？"然后走了。Fine! ok') == ['他说"你好吗？"', "然后走了。", "Fine!"]


def test_strict_sizes():
    text = "这是一个用来测试长度的句子。" * 100
    parts = K.strict([text], 200, 50)
    assert len(parts) > 1 and all(len(p) <= 200 + 50 for p in parts)
    headed = K.split_oversized("A > B\n\n" + "一句话在这里。" * 40, 60, 0)
    assert all(p.startswith("A > B\n\n") and len(p) <= 60 for p in headed)
    assert K.split_oversized("x" * 30 + "。", 10, 0) == ["x" * 30 + "。"]


def test_markers_are_cut_without_loss():
    assert K.marker_sections("前言一、甲二、乙一、丙") == ["前言", "一、甲", "二、乙", "一、丙"]
    assert K.marker_sections("p\n\nq\n\n") == ["p", "q"] and K.marker_sections("p\nq") == ["p", "q"] and K.marker_sections("") == []


def test_greedy_dedup_is_idempotent():
    prints = ["abcdef", "abcdeg", "xyz", "", "", "abcdef"]
    keep = K.greedy_distinct(prints)
    assert keep == [True, False, True, True, True, False]
    kept = [p for p, k in zip(prints, keep) if k]
    assert all(K.greedy_distinct(kept))


def test_repair():
    assert K.repair(["应当对本办法", "第十条到第十九条的内容进行修改", "第一条 短", "后续", "第二条 另一条"]) == ["应当对本办法第十条到第十九条的内容进行修改", "第一条 短\n\n后续", "第二条 另一条"]


def test_articles():
    text = "某某管理办法的标题在这里\n\n第一章 总则部分的题目文字\n第一条 甲甲甲甲甲甲甲甲。\n第二条 乙乙乙乙乙乙乙乙（一）子项；（二）子项。"
    a = K.articles_advanced(text)
    assert a[0].startswith("某某") and a[1].startswith("第一章") and "第一条" in a[1] and a[2].startswith("第二条") and "（一）" in a[2] and "（二）" in a[2]
    assert [x for x in K.articles_by_chapter(text) if re.match(P.CHAPTER, x)] == ["第一章"]


@given(st.lists(st.tuples(st.booleans(), st.integers(1, 5)), max_size=40))
@settings(max_examples=200, deadline=None)
def test_parents_are_earlier_and_higher(elements):
    h, lv = [a for a, _ in elements], [b for _, b in elements]
    sections = K.tree(h, lv)
    for x in sections:
        i, q = x["element"], x["parent"]
        if q >= 0:
            assert q < i and h[q] and lv[q] < lv[i]
            assert all(lv[k] >= lv[i] for k in range(q + 1, i) if h[k])
        assert x["path"][-1] == i and (x["path"][-2:-1] or [-1]) == [q]
        assert x["is_leaf"] == all(y["parent"] != i for y in sections if y["element"] >= 0) or i < 0
    assert [k for x in sections for k in range(x["first"], x["stop"])] == list(range(len(h)))


@given(st.lists(st.text("abcde", max_size=6), max_size=30))
@settings(max_examples=200, deadline=None)
def test_distinct_chunks_by_sets(prints):
    kept, want = [], []
    for p in prints:
        s = frozenset(p)
        want.append(not (s and any(len(s & k) >= 0.7 * len(s | k) for k in kept)))
        if want[-1] and s:
            kept.append(s)
    assert K.greedy_distinct(prints) == want


def test_batches():
    assert K.batches(["a"] * 45) == [list(range(20)), list(range(20, 40)), list(range(40, 45))]
    assert K.batches(["x" * 2000, "x" * 2000]) == [[0], [1]]


def test_reflow():
    assert K.reflow_lines("某办法 第一条 根据 第二条") == "某办法\n\n第一条 根据\n\n第二条"


def test_patterns():
    assert P.clean_pattern(r"^第\d+条\s*") == r"第\d+条" and P.clean_pattern("(") == ""
    assert P.by_priority()[0].startswith("^第") and P.by_priority(False)[0] == "^" + P.GENERAL["chinese_numbering"][0]
    assert len(P.STRUCTURE_MARKERS) == 20 and len(P.GENERIC_SHEETS) == 13
