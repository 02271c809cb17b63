"""More queries: the readers and entry points on files made from whole tables, and the remaining expressions, each with SQL."""

from __future__ import annotations

import json
import re

from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X
from ..operators import dedup as D
from ..operators import heading_model as HM
from ..operators import hierarchy as H
from ..operators import splitting as C
from ..operators import stats as S
from ..operators import tabular as T
from ..sources import files as FS
from ..sources import rtf
from . import api, renderers
from . import queries as Q

query, table, documents, hashed = Q.query, Q.table, Q.documents, Q.hashed

_LINES = f"with {Q.LEGAL}, {Q.LINES}"
_STRIP = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _strip(x: str) -> str:
    return _STRIP.replace("{x}", x)


# --- statistics and expressions ------------------------------------------------------------------------------------------


@query(Q._KEPT + f" select count(*) as chunks, count(*) filter (regexp_matches(content, '{P.ARTICLE}')) as with_article, round(avg(regexp_matches(content, '{P.ARTICLE}')::int), 4) as share from kept")
def a12_article_coverage(spark, sf):
    return S.article_coverage(C.articles(Q.legal_docs(spark, sf), "simple"))


@query(Q._TREE_SQL + "select doc_id, md5(string_agg(content, chr(10) || chr(10) order by seq)) as hash from tree where content <> '' group by doc_id")
def a2_concat_contents(spark, sf):
    return H.concat_text(Q.tree(spark, sf), "\n\n", with_heading=False).select("doc_id", F.md5("text").alias("hash"))


@query(Q.SQL["a3_near_duplicate_chunks"].replace("substr(content, 1, 200)", "content").replace("10 * len(", "100 * len(").replace(">= 7 *", ">= 90 *"))
def a5_near_duplicates_by_300(spark, sf):
    """The variant whose fingerprints see up to 300 characters of whole chunks."""
    return D.distinct_chunks(C.pack_sentences(documents(spark, sf), 500, 50), 1 << 30, 0.9).select("doc_id", "chunk_id")


@query("select c_custkey as doc_id, substr(c_mktsegment, 1, cast(c_custkey % 8 as int)) as heading, case when c_custkey % 8 = 0 then '' else substr(c_mktsegment, 1, cast(c_custkey % 8 as int)) || chr(10) end || substr(c_name, 1, cast(c_custkey % 19 as int)) as content from customer where not (c_custkey % 19 < 10 and c_custkey % 8 < 5)")
def p5_short_sections(spark, sf):
    s = table(spark, sf, "customer").selectExpr("c_custkey doc_id", "substring(c_mktsegment, 1, cast(c_custkey % 8 as int)) heading", "substring(c_name, 1, cast(c_custkey % 19 as int)) content")
    return H.clean_small(s).select("doc_id", "heading", "content")


def _words(words) -> str:
    return "|".join(re.escape(w) for w in words)


for _name, _mark, _list in (("p7_important_texts", X.is_important, P.CLAUSE_WORDS), ("p8_process_texts", X.is_process, P.PROCESS_WORDS)):

    def _flags(spark, sf, mark=_mark):
        legal = Q.legal_docs(spark, sf).select("doc_id", F.lit("legal").alias("corpus"), "text")
        every = legal.unionByName(documents(spark, sf).select("doc_id", F.lit("documents").alias("corpus"), "text"))
        return every.select("corpus", "doc_id", mark(F.col("text")).alias("flag"))

    _flags.__name__ = _name
    query(f"with {Q.LEGAL} select 'legal' as corpus, doc_id, regexp_matches(lower(text), '{_words(_list)}') as flag from legal union all select 'documents', doc_id, regexp_matches(lower(text), '{_words(_list)}') from documents")(_flags)


@query(f"select c_custkey as id, contains(p, '/law/') or regexp_matches(regexp_replace(string_split(p, '/')[-1], '\\.[^.]*$', ''), '{_words(P.FILE_WORDS)}') as legal from (select c_custkey, lower('/data/' || ['law', 'Law', 'x'][c_custkey % 3 + 1] || '/' || ['某管理办法', 'notes', 'Law of it', '证券'][c_custkey % 4 + 1] || '.docx') as p from customer)")
def p11_legal_filenames(spark, sf):
    pick = lambda words: F.element_at(F.array(*map(F.lit, words)), (F.col("c_custkey") % len(words) + 1).cast("int"))
    path = F.concat(F.lit("/data/"), pick(("law", "Law", "x")), F.lit("/"), pick(("某管理办法", "notes", "Law of it", "证券")), F.lit(".docx"))
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), X.legal_filename(path).alias("legal"))


_DRAFT = "regexp_replace({x}, '^（征求意见稿）\\s*>\\s*', '')"
_X6 = f"""{_LINES}, marked as (select doc_id, seq, case seq % 3 when 0 then '（征求意见稿） > ' || text when 1 then '总则 > ' || text else text end as t from lines),
twice as (select * from marked union all select doc_id, seq + 100000, t from marked where seq % 2 = 0),
whole as (select doc_id, string_agg(t, chr(10) order by seq) as text from twice group by doc_id),
advanced as (select doc_id, regexp_replace(regexp_replace(text, '（征求意见稿）\\s*>\\s*', '', 'g'), '[^第]*?>\\s*(第)', '\\1', 'g') as text from whole),
parts as (select doc_id, 'advanced' as kind, unnest(string_split(text, chr(10))) as x, generate_subscripts(string_split(text, chr(10)), 1) as i from advanced
  union all select doc_id, 'simple', t, seq from twice union all select doc_id, 'chunk', t, seq from twice),
short as (select doc_id, kind, i, {_strip('x')} as x from parts),
cut as (select doc_id, kind, i, case kind when 'advanced' then x when 'simple' then regexp_replace({_DRAFT.replace('{x}', 'x')}, '^[^第]*?>\\s*', '') else regexp_replace({_DRAFT.replace('{x}', 'x')}, '^.*?>\\s*', '') end as x from short),
bare as (select doc_id, kind, i, {_strip('x')} as x from cut),
once as (select doc_id, kind, x, min(i) as i from bare where x <> '' group by doc_id, kind, x)
select doc_id, kind, md5(string_agg(x, chr(10) || chr(10) order by i)) as hash from once group by doc_id, kind"""


@query(_X6)
def x6_legal_cleaning(spark, sf):
    """The three cleanings of legal chunks, on lines under paths and with repeats."""
    line = F.when(F.col("seq") % 3 == 0, F.concat(F.lit("（征求意见稿） > "), "text")).when(F.col("seq") % 3 == 1, F.concat(F.lit("总则 > "), "text")).otherwise(F.col("text"))
    marked = Q.legal_lines(spark, sf).select("doc_id", "seq", line.alias("t"))
    twice = marked.unionByName(marked.where("seq % 2 = 0").withColumn("seq", F.col("seq") + 100000))
    whole = twice.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "t"))), lambda x: x["t"]), "\n").alias("text"))
    kinds = {"advanced": X.clean_legal_advanced, "simple": X.clean_legal_simple, "chunk": X.clean_legal_chunk}
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.md5(f(F.col("text"))).alias("hash")) for k, f in kinds.items())))
    return whole.select("doc_id", each.alias("x")).select("doc_id", "x.kind", "x.hash")


@query("select p_partkey as id, case when fmt in ('xlsx', 'xls', 'xlsm') then 'excel' else fmt end as type, fmt in ('xlsx', 'xls', 'xlsm') or hex(c)[1:8] = '504B0304' or hex(c)[1:4] = 'D0CF' as sheet from (select p_partkey, lower(['xlsx', 'PDF', 'XLS', 'docx', 'xlsm', 'txt'][p_partkey % 6 + 1]) as fmt, case p_partkey % 5 when 0 then '\\x50\\x4B\\x03\\x04'::blob when 1 then '\\xD0\\xCF\\x11'::blob else 'ab'::blob end as c from part)")
def s24_file_types(spark, sf):
    """Type names by suffix, and what is a workbook by suffix or first bytes."""
    name = F.concat(F.lit("/d/a."), F.element_at(F.array(*map(F.lit, ("xlsx", "PDF", "XLS", "docx", "xlsm", "txt"))), (F.col("p_partkey") % 6 + 1).cast("int")))
    content = F.when(F.col("p_partkey") % 5 == 0, F.unhex(F.lit("504B0304"))).when(F.col("p_partkey") % 5 == 1, F.unhex(F.lit("D0CF11"))).otherwise(F.lit("ab").cast("binary"))
    d = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), X.file_format(name).alias("fmt"), content.alias("c"))
    return d.select("id", X.file_type_name(F.col("fmt")).alias("type"), X.excel_content(F.col("fmt"), F.col("c")).alias("sheet"))


@query("select o_custkey as id, string_agg(o_orderkey || ' | ' || case when o_orderkey % 3 = 0 then '' else o_orderpriority end, chr(10) order by o_orderkey) as text from orders group by o_custkey")
def x13_table_text(spark, sf):
    o = table(spark, sf, "orders").selectExpr("o_custkey id", "o_orderkey k", "array(cast(o_orderkey as string), case when o_orderkey % 3 = 0 then null else o_orderpriority end) r")
    return o.groupBy("id").agg(X.table_text(F.transform(F.array_sort(F.collect_list(F.struct("k", "r"))), lambda x: x["r"])).alias("text"))


@query(_LINES + f" select doc_id, cast(seq as int) as seq, case when seq % 4 = 0 then 2 when seq % 4 = 1 then 3 else {Q._X3} end as level from lines")
def x14_word_heading_levels(spark, sf):
    style = F.element_at(F.array(*map(F.lit, ("Heading 2", "my heading3", "Body", None))), (F.col("seq") % 4 + 1).cast("int"))
    return Q.legal_lines(spark, sf).select("doc_id", "seq", X.word_heading_level(style, F.col("text")).alias("level"))


_E = "[。！？；.!?;]"


@query(f"select doc_id, md5(case when length(text) <= 80 then text when regexp_matches(right(text, 80), '{_E}') then {_strip(f'regexp_replace(right(text, 80), {chr(39)}(?s)^[^。！？；.!?;]*{_E}{chr(39)}, {chr(39) * 2})')} else {_strip('right(text, 80)')} end) as hash from documents")
def x8_overlap_texts(spark, sf):
    return documents(spark, sf).select("doc_id", F.md5(X.overlap_text(F.col("text"), 80)).alias("hash"))


def _tail(s: str, limit: int) -> str:
    """The longest run of last sentences of the list ``s`` that is at most ``limit`` long."""
    start = f"list_filter(range(1, len({s}) + 2), lambda j: coalesce(list_sum(list_transform({s}[j:], lambda y: length(y))), 0) + greatest(len({s}) - j, 0) <= {limit})[1]"
    return f"array_to_string({s}[{start}:], ' ')"


@query(f"with {Q._SENT} select s.doc_id, md5(case when length(d.text) <= 120 then d.text else {_tail('s.s', 120)} end) as hash from sent0 s join documents d using (doc_id)")
def x9_sentence_overlap(spark, sf):
    return documents(spark, sf).select("doc_id", F.md5(C.fold(C.K.sentence_overlap, "string", 120)(F.col("text"))).alias("hash"))


_BOOK = Q._SHEETS + ", s as (select doc_id, sheet_idx, '【工作表: ' || sheet_name || '】' || chr(10) || string_agg(case when star then '★ ' || line else line end, chr(10) order by row_idx) as t from starred group by doc_id, sheet_idx, sheet_name), w as (select doc_id, string_agg(t, chr(10) || chr(10) order by sheet_idx) as text from s group by doc_id)"
_CLEANED = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '【工作表:[^】]*】', '', 'g'), '表头:', '', 'g'), '-{10,}', '', 'g'), '★\\s*', '', 'g'), '\\n\\s*\\n', chr(10), 'g')"


@query(f"{_BOOK} select doc_id, md5({_strip(_CLEANED)}) as hash from w")
def s32_clean_workbook_text(spark, sf):
    t = T.sheet_text(T.legal_content(Q.cells(spark, sf)))
    return t.select("doc_id", F.md5(X.clean_sheet_text(F.col("text"))).alias("hash"))


# --- pages and outlines --------------------------------------------------------------------------------------------------

_PAGES = "pages_ as (select l_orderkey as doc_id, l_linenumber as page, repeat('x', cast(min(l_partkey) % 90 as int)) || ' ' as text from lineitem group by 1, 2)"


def _pages(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("k")).selectExpr("l_orderkey doc_id", "l_linenumber page", "concat(repeat('x', cast(k % 90 as int)), ' ') text")


@query(f"with {_PAGES} select doc_id, string_agg('--- 第' || page || '页 ---' || chr(10) || text, chr(10) || chr(10) order by page) as text from pages_ group by doc_id")
def s22_page_banners(spark, sf):
    return FS.pdf_page_text(_pages(spark, sf))


@query(f"with {_PAGES} select doc_id, bool_or(length(rtrim(text)) > 50) as digital from pages_ where page <= 3 group by doc_id")
def s23_digital_pages(spark, sf):
    return FS.digital_pdf(_pages(spark, sf))


@query(_LINES + f", c as (select doc_id, seq, {Q._CLEAN} as t from lines) select doc_id, cast(1 as int) as seq, 'Document Content' as heading, md5(string_agg(t, chr(10) order by seq)) as hash, cast(1 as int) as level from c group by doc_id")
def s20_single_sections(spark, sf):
    return H.single_section(Q.legal_docs(spark, sf)).withColumn("hash", F.md5("content")).drop("content")


_OUT = "o as (select distinct l_orderkey as doc_id, l_linenumber as seq, cast(1 + l_linenumber * 5 % 3 as int) as level, 't' || l_linenumber as title from lineitem)"


@query(
    f"with recursive {_OUT}, up as (select a.doc_id, a.seq, a.title, max(b.seq) as parent from o a left join o b on b.doc_id = a.doc_id and b.seq < a.seq and b.level < a.level group by a.doc_id, a.seq, a.title), "
    + "walk as (select doc_id, seq, title as path, 1 as depth from up where parent is null union all select u.doc_id, u.seq, w.path || ' > ' || u.title, w.depth + 1 from up u join walk w on w.doc_id = u.doc_id and w.seq = u.parent) "
    + "select w.doc_id, w.seq, cast(w.depth as int) as depth, w.path, not exists (select 1 from up c where c.doc_id = w.doc_id and c.parent = w.seq) as is_leaf, t.text as content from walk w join (select l_orderkey as doc_id, l_linenumber as page, 'page ' || min(l_partkey) as text from lineitem group by 1, 2) t on t.doc_id = w.doc_id and t.page = w.seq"
)
def t2_outline_tree(spark, sf):
    li = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"))
    pages = li.selectExpr("l_orderkey doc_id", "l_linenumber page", "concat('page ', l_partkey) text")
    outline = li.selectExpr("l_orderkey doc_id", "l_linenumber seq", "cast(1 + l_linenumber * 5 % 3 as int) level", "concat('t', l_linenumber) title", "l_linenumber page")
    return H.outline_tree(pages, outline).select("doc_id", "seq", "depth", F.array_join("path", " > ").alias("path"), "is_leaf", "content")


# --- files ---------------------------------------------------------------------------------------------------------------


def _files(d, fmt: str, content):
    """(path, ...) as ``read_files`` gives it, of rows with a doc_id."""
    f = d.select(F.concat(F.lit("/data/law/"), F.col("doc_id").cast("string"), F.lit("." + fmt)).alias("path"), content.alias("content"))
    return FS.describe(f.withColumn("length", F.octet_length("content").cast("bigint")))


def _id(c: str = "path"):
    return F.regexp_extract(c, "/([0-9]+)[.]", 1).cast("bigint").alias("doc_id")


@query("select doc_id, md5(text) as hash from documents where text <> ''")
def s38_text_of_files(spark, sf):
    d = documents(spark, sf).where("text <> ''")
    return FS.extract_text(_files(d, "txt", F.col("text").cast("binary"))).where("error is null").select(_id(), F.md5("text").alias("hash"))


@query(Q._CURSOR.replace("md5(c) as hash", "md5(c) as hash, doc_id || '.txt' as source_file, 'txt' as file_type"))
def k2_chunks_of_text_files(spark, sf):
    d = documents(spark, sf).where("text <> ''")
    c = api.simple_chunk_file(_files(d, "txt", F.col("text").cast("binary")))
    return c.select(_id("doc_id"), "chunk_id", "total_chunks", "start_pos", "end_pos", "length", F.md5("content").alias("hash"), "source_file", "file_type")


def _legal_lists(spark, sf):
    return Q.legal_docs(spark, sf).select("doc_id", F.split("text", "\n").alias("lines"))


def word_files(spark, sf):
    """Word files of a paragraph a line, every fifth in a heading style."""
    styles = F.transform("lines", lambda _, i: F.when(i % 5 == 0, "heading 2"))
    return _files(_legal_lists(spark, sf).withColumn("styles", styles), "docx", renderers.docx(F.col("lines"), F.col("styles")))


_WORD = rf"regexp_matches(text, '^(?i:(第[{P.HAN}0-9]+[章节]|[{P.HAN}0-9]+[、．.]|（[{P.HAN}0-9]+）|(chapter|section)\s+[0-9]+|[0-9]+\.?\s+|[0-9]+\.[0-9]+\.?\s+))') or (length(text) < 100 and not regexp_matches(text, '[。.！!？?]$'))"


@query(_LINES + f", c as (select doc_id, seq, {Q._CLEAN} as text from lines) select doc_id, cast(seq as int) as seq, md5(text) as hash, seq % 5 = 0 or {_WORD} as is_heading, case when seq % 5 = 0 then 2 when {_WORD} then {Q._X3} else 0 end as level from c")
def s8_word_files(spark, sf):
    """Word files read as elements."""
    e = FS.docx_elements(word_files(spark, sf))
    return e.select(_id(), "seq", F.md5("text").alias("hash"), "is_heading", "level")


@query(f"with {Q.CELLS} select doc_id, cast(dense_rank() over (partition by doc_id order by sheet_idx) as int) as sheet_idx, sheet_name, cast(row_idx as int) as row_idx, cast(col_idx as int) as col_idx, value from cells where value is not null")
def s30_workbook_files(spark, sf):
    """Workbooks read as cells."""
    got = FS.xlsx_cells(workbook_files(spark, sf))
    return got.withColumn("doc_id", _id("doc_id")).drop("error")


@query(f"with {Q.LEGAL} select doc_id, md5(text) as hash from legal")
def s13_rtf_files(spark, sf):
    d = _legal_lists(spark, sf)
    return d.select("doc_id", F.md5(C.fold(rtf.parse, "string")(renderers.rtf(F.col("lines")))).alias("hash"))


@query(f"with {Q.LEGAL} select doc_id, md5(replace(text, '||', chr(10) || chr(10))) as hash from ({Q._REFLOWED})")
def o5_best_rtf_text(spark, sf):
    """The best of the candidates for a file's text, with its lines set again."""
    return _legal_lists(spark, sf).select("doc_id", F.md5(C.fold(rtf.extract, "string")(renderers.rtf(F.col("lines")))).alias("hash"))


def _starts_with_a_mark(asked: str) -> str:
    """Stands for a model: answers by the first character of each line it is asked about."""
    lines = [line.split(". ", 1)[1] for line in asked.split("\n")[1:]]
    return json.dumps([{"is_heading": t.startswith("第"), "level": 2 if t.startswith("第") else 0, "confidence": 0.75} for t in lines])


@query(_LINES + " select doc_id, cast(seq as int) as seq, starts_with(text, '第') as is_heading, cast(case when starts_with(text, '第') then 2 else 0 end as int) as level, 0.75::double as confidence from lines")
def l4_model_headings(spark, sf):
    """Lines asked in batches of a function that stands for a model."""
    return HM.detect(Q.legal_lines(spark, sf), _starts_with_a_mark).drop("text")


@query(Q._TITLED)
def c24_rtf_articles(spark, sf):
    parts = C.fold(lambda t: rtf.articles(C.K.reflow_lines(t)), "array<struct<heading:string,content:string>>")(F.col("text"))
    return Q.legal_docs(spark, sf).select("doc_id", F.posexplode(parts).alias("seq", "s")).select("doc_id", "seq", "s.heading", F.md5("s.content").alias("content"))


def workbook_files(spark, sf):
    """Workbooks of the cells of all nations of a region."""
    c = Q.cells(spark, sf).where("value is not null")
    d = c.groupBy("doc_id").agg(F.collect_list(F.struct(*(F.col(k) for k in ("sheet_idx", "sheet_name", "row_idx", "col_idx", "value")))).alias("cells"))
    return _files(d, "xlsx", renderers.xlsx(F.col("cells")))


@query(
    Q._LAW
    + """, m as (select doc_id, sheet_idx, sheet_name, row_idx - 1 + special::int as section, case when special then case when number <> '' then number else '条文' end else trim(law_name || ' ' || number) end as heading, content from s),
    books as (select doc_id, count(distinct sheet_idx) as sheets from m group by doc_id)
    select doc_id, cast(row_number() over (partition by doc_id order by sheet_idx, section) as int) as chunk_id, md5(case when sheets > 1 then sheet_name || ' - ' else '' end || heading || chr(10) || content) as hash from m join books using (doc_id)"""
)
def e5_laws_of_workbooks(spark, sf):
    """Workbooks of law and article columns go past the text: each article row is a chunk."""
    c = api.split_legal_files(workbook_files(spark, sf))
    return c.where("error is null").select(_id("doc_id"), "chunk_id", F.md5("content").alias("hash"))


_SPANS = "s as (select p_partkey % 50 as doc_id, cast(1 + p_partkey // 50 // 20 as int) as page, p_partkey // 50 as k, p_name as text, cast(10 + p_size % 5 as double) as font_size from part)"


def _spans(spark, sf):
    return table(spark, sf, "part").selectExpr("p_partkey % 50 doc_id", "cast(1 + p_partkey div 50 div 20 as int) page", "p_partkey div 50 seq", "p_name text", "cast(10 + p_size % 5 as double) font_size")


def pdf_files(spark, sf):
    d = _spans(spark, sf).groupBy("doc_id").agg(F.collect_list(F.struct("page", "seq", "text", "font_size")).alias("spans"))
    return _files(d, "pdf", renderers.pdf(F.col("spans")))


@query(f"with {_SPANS} select doc_id, page, cast(row_number() over (partition by doc_id order by page, k) - 1 as int) as seq, text, font_size from s")
def s22_pdf_files(spark, sf):
    """PDF files of the names of parts, read as lines with pages and font sizes."""
    return FS.pdf_spans(pdf_files(spark, sf)).select(_id(), "page", "seq", "text", "font_size")


_READ = f"read as (select doc_id, seq, {Q._CLEAN} as text from lines)"
_EL = f"e as (select doc_id, seq, text, w or {Q._P1} as h, case when w then {Q._X3} when {Q._P1} then {Q._X4} else {Q._X3} end as level from (select *, {_WORD} as w from (select doc_id, seq, regexp_replace(text, '^\\s+|\\s+$', '', 'g') as text from lines) where text <> ''))"
_TREE_OF_LINES = re.sub(r"e as \(select doc_id, seq, text, .*? as level from lines\)", lambda _: _EL, Q._TREE_SQL, count=1, flags=re.S)


@query(_TREE_OF_LINES + Q._FLAT.replace("{c}", "content").replace("{w}", "is_leaf").replace(", level,", ","))
def e1_split_text_files(spark, sf):
    """Text files to chunks: elements by the rules for unstyled lines, the legal rules on top, tree, finest chunks."""
    d = Q.legal_docs(spark, sf)
    c = api.split_document(_files(d, "txt", F.col("text").cast("binary"))).where("error is null")
    return c.select(_id("doc_id"), "chunk_id", F.md5("content").alias("hash"))


@query(_TREE_OF_LINES + "select doc_id, cast(seq as int) as seq, cast(len(path) as int) as depth, level, heading, md5(content) as hash, is_leaf from tree")
def e2_sections_of_text_files(spark, sf):
    d = Q.legal_docs(spark, sf)
    s = api.split_sections(_files(d, "txt", F.col("text").cast("binary"))).where("error is null")
    return s.select(_id("doc_id"), "seq", "depth", "level", "heading", F.md5("content").alias("hash"), "is_leaf")


@query("select c_custkey as doc_id, case c_custkey % 4 when 0 then 'BadZipFile' when 1 then 'unsupported format' when 2 then null else 'ValueError' end as error, case when c_custkey % 4 = 2 then cast(1 as int) else 0 end as chunk_id from customer")
def e1_broken_files(spark, sf):
    """Broken and unsupported files among readable ones: each is a row with its reason, and the others are read."""
    fmt = F.element_at(F.array(*map(F.lit, ("docx", "zip", "txt", "pdf"))), (F.col("c_custkey") % 4 + 1).cast("int"))
    f = table(spark, sf, "customer").select(F.concat(F.lit("/data/"), F.col("c_custkey").cast("string"), F.lit("."), fmt).alias("path"), F.col("c_name").cast("binary").alias("content"))
    got = api.split_document(FS.describe(f.withColumn("length", F.octet_length("content").cast("bigint"))))
    return got.select(_id("doc_id"), F.regexp_extract("error", "^[A-Za-z ]+", 0).alias("error"), F.coalesce("chunk_id", F.lit(0)).alias("chunk_id"))
