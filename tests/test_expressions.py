import pytest
from pyspark.sql import functions as F

from folioflow.functions import kernels as K
from folioflow.functions import text as X


def each(spark, column, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, t {kind}")
    return [r[0] for r in rows.orderBy("i").select(column(F.col("t"))).collect()]


def test_heading_levels(spark):
    got = each(spark, X.heading_level, ["第一章 总则", "第二节 x", "一、项", "1、项", "（一）项", "Chapter 3", "section 2", "1.1 x", "1. x", "plain"])
    assert got == [1, 2, 3, 3, 4, 1, 2, 4, 3, 3]


def test_legal_levels(spark):
    t = ["第一编 x", "第二篇", "第三章", "第四节", "第五条", "第六款", "第七项", "第八目", "（一）x", "(2) x", "一、x", "1、x", "3) x", "无", "第五条 规定很长", ""]
    assert each(spark, X.legal_level, t) == [1, 2, 3, 4, 5, 6, 7, 8, 10, 10, 10, 11, 11, 10, 10, 10]
    assert each(spark, X.legal_type, ["第五条", "无"]) == ["article", None]


def test_legal_headings(spark):
    t = ["第一章 总则", "第一条", "第一条 内容详细说明", "x", "普通文字", "第" + "一" * 300 + "章", None]
    assert each(spark, X.legal_heading, t) == [True, True, False, False, False, False, False]
    assert each(spark, lambda c: X.legal_heading(c, legal=False), ["普通文字", "普通，文字", "Chapter 1", "一句话。"]) == [True, False, True, False]
    assert each(spark, lambda c: X.legal_heading(c, custom=("^附件",)), ["附件一"]) == [True]


def test_unicode_white_space_and_repair(spark):
    assert each(spark, X.strip, ["　a b \n"]) == ["a b"]
    assert each(spark, X.clean_legal_text, ["制定本。根据本办法", "前缀 > 第一条", None]) == ["制定本办法。根据本办法", "第一条", ""]


def test_clean_text(spark):
    assert each(spark, X.clean_text, ["中 文 字 符\n  a   b ", "（ 一 ） 你好 ， x", "3 一"]) == ["中文 字符\na b", "（一）你好，x", "3一"]


def test_sentences_as_the_kernel(spark):
    t = ['他说"你好吗？"然后走了。Fine! ok', "", "no end here", "。。。", "a.b;c!d?"]
    assert each(spark, X.sentences, t) == [K.sentences(x) for x in t]


def test_overlap_fingerprint_numbers(spark):
    assert each(spark, lambda c: X.overlap_text(c, 6), ["短", "前文。后文字", "abcdefghij"]) == [K.char_overlap(x, 6) for x in ("短", "前文。后文字", "abcdefghij")]
    assert each(spark, X.fingerprint, ["【Chunk 1】x\nabc" + "=" * 60 + " (长度: 5 字符)"]) == ["abc"]
    assert each(spark, X.article_number, ["第十二条 x", "第一款", "3. x", "(4) y", "none"]) == ["第十二条", "第一款", "3.", "(4)", ""]


def test_small_predicates(spark):
    assert each(spark, X.has_structure, ["一、二、三、", "一、一、一、", "1、2、（一）"]) == [True, False, True]
    assert each(spark, X.sentence_complete, ["a。", "a. ", "a", "a；"]) == [True, True, False, True]
    assert each(spark, X.is_important, ["违约责任", "Liability", "x"]) == [True, True, False]
    assert each(spark, X.is_process, ["流程", "Step 1", "x"]) == [True, True, False]
    assert each(spark, X.party_tags, ["甲方应承担违约责任", "x", "第一条"]) == [["当事人", "违约责任"], [], ["合同条款"]]
    assert each(spark, X.legal_filename, ["/law/x.doc", "/y/law.d/x.doc", "/y/金融.doc"]) == [True, False, True]
    assert each(spark, X.file_format, ["/a/b.DOCX", "/a.b/c", "x.tar.gz"]) == ["docx", "", "gz"]
    assert each(spark, X.clean_sheet_text, ["【工作表: A】\n表头: x\n-----------\n★ y\n\n\nz"]) == ["x\ny\nz"]
    assert each(spark, X.table_text, [[["a", None], ["b", "c"]]], "array<array<string>>") == ["a | \nb | c"]


def test_word_headings(spark):
    rows = spark.createDataFrame([("Heading 2", "x."), (None, "1. x."), ("Normal", "short line"), ("Normal", "A sentence."), ("Title", "t.")], "s string, t string")
    assert [tuple(r) for r in rows.select(X.word_heading(F.col("s"), F.col("t")), X.word_heading_level(F.col("s"), F.col("t"))).collect()] == [(True, 2), (True, 3), (True, 3), (False, 3), (True, 3)]


def test_token_counters(spark):
    with pytest.raises(ValueError):
        X.count_tokens(F.col("t"), "tiktoken")
    with pytest.raises(ValueError):
        X.count_tokens(F.col("t"), "other")
    assert each(spark, X.count_tokens, ["𠀀中a"]) == [3]
