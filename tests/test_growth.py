"""Steps whose memory or time must not grow beyond the input's: in slices, in one pass, in a document's row."""

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from folioflow.functions import kernels as K
from folioflow.functions.slices import slices, values
from folioflow.operators import heading_model as HM
from folioflow.operators import hierarchy as H
from folioflow.operators import splitting as C


def test_slide_query_is_its_sql_on_odd_texts(spark, tmp_path):
    """list marks in long texts, and empty ones."""
    marked = "一、甲甲甲。二、乙乙乙。三、丙丙丙。" * 40
    texts = ["", None, "a", marked, marked[:500], marked[:501], "x" * 501, " " * 600, "好的。" * 300, " 一句话。" * 200]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").selectExpr("*", "'zh' lang", "'s' source").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = sorted(con.execute(E.oracle_sql()["c5_slide"]).fetchall())
    assert sorted(map(tuple, E.queries()["c5_slide"](spark, str(tmp_path)).collect())) == want
    assert {r[0] for r in want} == set(range(2, 10)) and sum(r[0] == 3 for r in want) > 1
    assert K.slide(marked, 500, 50) == K.pack_structure(marked, 500, 50) and K.slide("", 500, 50) == [""]  # the operator itself still has both


def test_model_answers_are_forgotten(spark):
    """a task remembers so many answers, and every line has its own all the same."""
    asked = []

    def call(prompt):
        asked.append(prompt)
        lines = prompt.split("\n")[1:]
        return "[" + ",".join('{"is_heading": true, "level": %s, "confidence": 1}' % (x.split("t")[-1]) for x in lines) + "]"

    seen = []
    detect = lambda n: HM.detect(spark.range(3000, numPartitions=1).selectExpr("id doc_id", "0 seq", "concat('t', id % 1500) text"), call, remembered=n)
    for n in (10, 5000):
        got = {r.doc_id: r.level for r in detect(n).collect()}
        assert got == {i: i % 1500 for i in range(3000)}
    held = []
    real = HM.slices

    def watched(batch):
        import sys

        for part in real(batch):
            held.append(len(sys._getframe(1).f_locals["cache"]))
            yield part

    batch = pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array([0] * 3000), pa.array([f"t{i}" for i in range(3000)])], ["doc_id", "seq", "text"])
    run = _arrow_function(HM.detect, spark, call, 10)
    HM.slices = watched
    try:
        assert sum(b.num_rows for b in run(iter([batch] * 3))) == 9000
    finally:
        HM.slices = real
    assert len(held) > 10 and max(held) <= 10


def _arrow_function(detect, spark, call, n):
    """What ``detect`` gives to mapInArrow."""
    got = []

    class Lines:
        def __init__(self, df):
            self.df = df

        def select(self, *c):
            return Lines(self.df.select(*c))

        schema = property(lambda self: self.df.schema)

        def mapInArrow(self, f, schema):
            got.append(f)
            return self.df.mapInArrow(f, schema)

    detect(Lines(spark.createDataFrame([(1, 0, "x")], "doc_id bigint, seq int, text string")), call, remembered=n)
    return got[0]


def test_section_parts_in_one_pass(spark):
    """both styles from one reading of the sections; only what is too long goes to Python."""
    s = spark.createDataFrame([(1, 1, "h", "短", 1), (1, 2, "", "很长的一句话。" * 5, 2), (2, 1, "g", None, 1), (2, 2, "k", "另一句很长的话。" * 4, 3)], "doc_id int, seq int, heading string, content string, level int")
    both = C.section_parts(s, 20, 0, "sibling", "child")
    rows = lambda df: sorted((tuple(r[c] for c in ("doc_id", "seq", "part", "heading", "content", "level")) for r in df.collect()), key=repr)
    for style in ("sibling", "child"):
        assert rows(both.where(F.col("style") == style)) == rows(C.section_parts(s, 20, 0, style))
    assert [r[3] for r in rows(C.section_parts(s, 20, 0, "child")) if r[:2] == (1, 2)][:2] == ["", "Part 1"]
    plan = E.queries()["c14_section_parts"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("orders.parquet") + plan.count("o_custkey") and plan.count("Relation") == 1


def test_kernels_see_slices():
    """ten thousand rows in a batch are never values at once."""
    a, b = pa.array(["x" * 100] * 10_000 + [None]), pa.array([[i, i + 1] for i in range(10_001)], pa.list_(pa.int32()))
    parts = list(slices((a, b)))
    assert max(len(p[0]) for p in parts) <= 512 and [v for p in parts for v in values(p[1])] == b.to_pylist() and [v for p in parts for v in values(p[0])] == a.to_pylist()
    assert [len(p[0]) for p in slices((pa.array(["y" * (3 << 20)] * 3),))] == [1, 1, 1] and not list(slices((pa.array([], pa.string()),)))
    odd = pa.array([[["a", None], None, []], None, [["b"]]], pa.list_(pa.list_(pa.string())))
    assert values(odd) == odd.to_pylist() and values(odd.slice(1)) == odd.slice(1).to_pylist()
    assert values(pa.array([[1, None], [2]])) == [[1, None], [2]] and values(pa.array([b"a", None])) == [b"a", None]


def test_fold_over_slices(spark):
    d = spark.range(2000, numPartitions=1).selectExpr("id doc_id", "case when id % 7 = 0 then null else concat('s', id) end text")
    got = {r.doc_id: r.n for r in d.select("doc_id", C.fold(lambda t: len(t), "int")(F.col("text")).alias("n")).collect()}
    assert got == {i: None if i % 7 == 0 else len(f"s{i}") for i in range(2000)}


@pytest.mark.parametrize("joiner,with_heading", [("\n\n", True), ("|", False)])
def test_tree_of_long_documents(spark, joiner, with_heading):
    """a section does not carry its document along."""
    n = 3000
    e = spark.range(n, numPartitions=1).selectExpr("1 doc_id", "cast(id as int) seq", "concat('t', id) text", "id % 3 = 1 is_heading", "cast(1 + id % 2 as int) level")
    rows = H.build(e, with_heading, joiner).orderBy("seq").collect()
    texts, h, lv = [f"t{i}" for i in range(n)], [i % 3 == 1 for i in range(n)], [1 + i % 2 for i in range(n)]
    want = K.tree(h, lv)
    assert [(r.seq, r.element, r.depth, r.is_leaf, r.parent_seq) for r in rows] == [(s["seq"], s["element"], len(s["path"]), s["is_leaf"], s["parent"] if s["parent"] >= 0 else None) for s in want]
    for r, s in zip(rows, want):
        own = s["element"] >= 0
        assert r.content == joiner.join(texts[s["first"] + (own and not with_heading) : s["stop"]]) and r.path == [texts[i] if i >= 0 else "Document Content" for i in s["path"]]
        assert (r.heading, r.level) == ((texts[s["element"]], lv[s["element"]]) if own else ("Document Content", 1))


def test_sections_without_sorting_lines(spark):
    """the lines of a text are grouped in its row."""
    texts = ["", "  \n\n ", "前言\n第一章 总则\n甲\n\n乙\n第一条 短\n", "第一章 总则", "段一\n二\n\n段二", None]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = sorted((r.doc_id, r.seq, r.heading, r.content, r.level) for r in H.pdf_sections(d).collect())
    assert got == [(2, 0, "", "前言", 0), (2, 1, "第一章 总则", "甲\n乙", 3), (2, 2, "第一条 短", "", 5), (3, 1, "第一章 总则", "", 3), (4, 0, "Document Content", "段一\n二\n\n段二", 1)]
    plan = H.pdf_sections(d)._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "Exchange" not in plan


def test_shared_runs():
    """F8: by blocks of half the run, not by every run."""
    import random

    r = random.Random(1)
    for _ in range(4000):
        a, b = ("".join(r.choice("ab") for _ in range(r.randint(0, 24))) for _ in range(2))
        for least in (1, 2, 5, 6, 10):
            assert K.share_run(a, b, least) == any(a[i : i + least] in b for i in range(len(a) - least + 1)), (a, b, least)


def test_readers_take_slices(monkeypatch):
    """a batch of files is read and answered in slices."""
    from folioflow.sources import files as FS

    class Caught:
        select = lambda self, *c: self
        mapInArrow = lambda self, f, schema: f

    monkeypatch.setattr(FS, "validated", lambda files: Caught())
    n = 2000
    path, text, none = pa.array([f"/{i}.txt" for i in range(n)]), pa.array([b"a"] * n), pa.array([None] * n, pa.string())
    rows = list(FS._rows(None, lambda data, fmt: [(len(data),)], "path string, n int")(iter([pa.RecordBatch.from_arrays([path, text, pa.array(["txt"] * n), none], list("abcd"))])))
    texts = list(FS.extract_text(None)(iter([pa.RecordBatch.from_arrays([path, pa.array(["txt"] * n), text, none], list("abcd"))])))
    for got in (rows, texts):
        assert max(b.num_rows for b in got) <= 512 and [p for b in got for p in b.column(0).to_pylist()] == path.to_pylist()


def test_rtf_candidates_that_cannot_win(monkeypatch):
    """text by escapes alone is parsed once; runs of characters read as one by one."""
    from folioflow.plans import renderers
    from folioflow.sources import rtf

    lines = ["关于客户的管理办法", *(f"第{i}条 订单{i}应当在O状态下执行。" for i in range(1, 9))]
    data = renderers.rtf_bytes(lines)
    want = K.reflow_lines("\n".join(lines))
    assert rtf.parse(data) == rtf.parse(data.replace(b"{\\rtf1", b"{\\rtf1\\uc2\\uc1 ")) == "\n".join(lines)
    assert rtf.parse(b"{@c0@19968?@19969?}{@c2@19968??x}@19968?1".replace(b"@", b"\\u")) == "一?丁?一x一1"
    monkeypatch.setattr(rtf, "direct", lambda data: 1 / 0)
    assert rtf.extract(data) == want
