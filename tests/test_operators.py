import pytest
from pyspark.sql import functions as F

from folioflow.functions import kernels as K
from folioflow.operators import splitting as C
from folioflow.operators import heading_model as M
from folioflow.operators import hierarchy as H
from folioflow.operators import stats as S
from folioflow.operators import tabular as T


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "One sentence here. Another one there! And a third? " * 5), (2, ""), (3, None), (4, "x" * 900), (5, "。。。")]
    return spark.createDataFrame(rows, "doc_id int, text string")


def contents(df):
    out = {}
    for r in df.orderBy("doc_id", "chunk_id").collect():
        out.setdefault(r.doc_id, []).append(r.content)
    return out


def test_packing_of_odd_texts(docs):
    got = contents(C.pack_sentences(docs, 60, 20))
    assert got[2] == [""] and got[4] == ["x" * 900] and got[5] == ["。。。"] and 3 not in got


def test_windows(docs):
    assert "".join(contents(C.windows(docs, 400))[4]) == "x" * 900
    assert [len(x) for x in contents(C.windows(docs, 400, 100))[4]] == [400, 400, 300]
    assert C.windows(docs, 10, 20).count() == 0
    with pytest.raises(ValueError):
        C.windows(docs, 10, 10)
    with pytest.raises(ValueError):
        C.pack_sentences(docs, 0)


def test_simple_chunks_have_their_metadata(docs):
    rows = C.simple_chunks(docs, 100, 0.1).where("doc_id = 1").orderBy("chunk_id").collect()
    assert [r.chunk_id for r in rows] == list(range(1, len(rows) + 1)) and {r.total_chunks for r in rows} == {len(rows)}
    assert all(r.length == len(r.content) for r in rows)


def test_tree_and_flattening(spark):
    rows = [(1, 0, "intro", False, 0), (1, 1, "A", True, 1), (1, 2, "a text", False, 0), (1, 3, "A1", True, 2), (1, 4, "a1 text", False, 0), (1, 5, "B", True, 1)]
    s = H.build(spark.createDataFrame(rows, "doc_id int, seq int, text string, is_heading boolean, level int"))
    got = {r.heading: r for r in s.collect()}
    assert got["A1"].path == ["A", "A1"] and got["A1"].parent_seq == got["A"].element and got["A"].content == "A\n\na text"
    assert {h for h, r in got.items() if r.is_leaf} == {"Document Content", "A1", "B"}
    assert contents(H.flatten(s))[1] == ["intro", "A1\n\na1 text", "B"]
    assert contents(H.flatten(s, "all_levels"))[1] == ["intro", "A\n\na text", "A1\n\na1 text", "B"]
    assert contents(H.flatten(s, "parent_only")) == contents(H.flatten(s))
    assert contents(H.concat_text(s, with_heading=False).withColumnRenamed("text", "content").withColumn("chunk_id", F.lit(1)))[1][0].startswith("intro\nA")
    with pytest.raises(ValueError):
        H.flatten(s, "no")


def test_section_parts(spark):
    s = spark.createDataFrame([(1, 1, "H", "a" * 50, 2), (1, 2, "", "b" * 50, 1), (1, 3, "S", "c", 1)], "doc_id int, seq int, heading string, content string, level int")
    sib = sorted((r.seq, r.part, r.heading, len(r.content), r.level) for r in C.section_parts(s.where("seq != 2"), 20, 0, "sibling").collect())
    assert sib == [(1, 0, "H", 50, 2), (3, 0, "S", 1, 1)]  # one sentence is never cut
    text = spark.createDataFrame([(1, 1, "H", "一二三四五。" * 8, 2)], "doc_id int, seq int, heading string, content string, level int")
    sib = [r.heading for r in C.section_parts(text, 20, 0, "sibling").orderBy("part").collect()]
    assert sib[:2] == ["H", "H (Part 2)"]
    kids = C.section_parts(text, 20, 0, "child").orderBy("part").collect()
    assert (kids[0].content, kids[0].level) == ("", 2) and (kids[1].heading, kids[1].level) == ("H (Part 1)", 3)


def test_sheets(spark):
    cells = [(1, 1, "甲", r, c, v) for r, row in enumerate([["法规名称", "条文"], ["某办法", "第一条 a"], ["某办法", "第二条 b"], ["某办法", "无号"]], 1) for c, v in enumerate(row, 1)]
    df = spark.createDataFrame(cells, "doc_id int, sheet_idx int, sheet_name string, row_idx int, col_idx int, value string")
    text = T.law_text(df)
    assert text.first().text.startswith("【LAW_NAME】\n某办法\n\n【ARTICLE】第一条\n第一条 a")
    got = [(r.heading, r.section_type, r.content) for r in T.parse_law_articles(text).orderBy("section").collect()]
    assert got == [("法规名称", "law_name", "某办法"), ("第一条", "law_article", "第一条 a"), ("第二条", "law_article", "第二条 b"), ("条文", "law_article", "无号")]
    assert T.table_structure(df).orderBy("row_idx", "part").collect()[0].line == "表头: 法规名称 | 条文"
    lines = spark.createDataFrame([(1, 1, "s", "头\n表头: a\nb\n表头: c\n★ 重要\nd")], "doc_id int, sheet_idx int, sheet_name string, text string")
    assert [(r.heading, r.content) for r in T.by_table(lines).orderBy("section").collect()] == [("内容1", "头"), ("表格1", "表头: a\nb"), ("表格2", "表头: c\n★ 重要\nd")]
    assert {r.section_type: r.content for r in T.by_importance(lines).collect()}["important_content"] == "重要"
    legal = spark.createDataFrame([(1, 1, "s", "第一条 甲\n第二条 乙"), (1, 2, "t", "x")], "doc_id int, sheet_idx int, sheet_name string, text string")
    assert sorted((r.sheet_idx, r.heading) for r in T.legal_split(legal).collect()) == [(1, "第一条"), (1, "第二条"), (2, "一般内容")]


def test_heading_model(spark):
    asked = []

    def call(p):
        n = int(p.split("these ")[1].split()[0])
        return "here: " + str([{"is_heading": 1, "level": 2, "confidence": 0.5}] * n).replace("'", '"')

    lines = spark.createDataFrame([(1, 0, "一、标题"), (1, 1, "text"), (1, 2, "text"), (1, 3, None)], "doc_id int, seq int, text string")
    got = M.detect(lines, call).orderBy("seq").collect()
    assert [(r.is_heading, r.level) for r in got][:3] == [(True, 2)] * 3

    def broken(p):
        raise OSError("down")

    got = M.detect(lines, broken, attempts=2, pause=0.0).orderBy("seq").collect()
    assert [(r.is_heading, r.level, r.confidence) for r in got][:2] == [(True, 1, 0.9), (False, 0, 0.9)]
    assert M.answer("no list", 2) == [M._NONE] * 2 and M.answer('[{"is_heading": true}]', 2) == [M._NONE] * 2 and not asked


def test_statistics(spark):
    c = spark.createDataFrame([(1, 1, "a" * 40 + "。"), (1, 2, "b" * 150), (2, 1, "第一条 x。")], "doc_id int, chunk_id int, content string")
    r = S.chunk_stats(c, 100).first()
    assert (r.chunks, r.max_len, r.min_len, r.within_limit) == (3, 150, 6, 2)
    assert {x.bucket: x.n for x in S.length_histogram(c).collect()} == {"0-50": 2, "101-200": 1}
    assert S.completion_rate(c).first().percent == 66.67 and S.article_coverage(c).first().with_article == 1
    assert {x.kind: x.n for x in S.structure_histogram(c).collect()} == {"content": 2, "article": 1}
    assert tuple(S.structure_counts(c).first()) == (3, 0, 1, 0, 2, 66.7)
    assert S.tag_counts(c.withColumn("content", F.lit("甲方违约"))).count() == 2


def test_flat_sections_and_cascade(spark):
    d = spark.createDataFrame([(1, "前言\n第一章 总则\n甲\n乙\n第二章\n丙"), (2, "p one\n\np two"), (3, ""), (4, None)], "doc_id int, text string")
    got = [tuple(r) for r in H.pattern_sections(d.where("doc_id = 1")).orderBy("seq").collect()]
    assert got == [(1, 0, "", "前言", 0), (1, 1, "第一章 总则", "甲\n乙", 3), (1, 2, "第二章", "丙", 3)]
    got = {(r.doc_id, r.heading) for r in H.pdf_sections(d).collect()}
    assert got == {(1, ""), (1, "第一章 总则"), (1, "第二章"), (2, "Document Content")}
    assert H.preorder(H.pattern_sections(d)).where("doc_id = 1").count() == 3


def test_small_sections(spark):
    s = spark.createDataFrame([(1, 1, "ab", "short", 1), (1, 2, "heading", "short", 1), (1, 3, "", "long enough content", 1)], "doc_id int, seq int, heading string, content string, level int")
    assert [r.content for r in H.clean_small(s).orderBy("seq").collect()] == ["heading\nshort", "long enough content"]
