"""Spreadsheets as cells (doc_id, sheet_idx, sheet_name, row_idx, col_idx, value), rows and columns from 1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions import patterns as P
from ..functions import text as X
from .splitting import fold

SHEET = ("doc_id", "sheet_idx", "sheet_name")


def _joined(value: Column, by: str = "col_idx", sep: str = " | ") -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by, value.alias("v")))), lambda x: x["v"]), sep)


def rows(cells: DataFrame, keep_empty: bool = False) -> DataFrame:
    """(..., row_idx, line): the row's cells joined; empty ones left out or kept as empty."""
    c = cells.withColumn("value", X.strip(F.coalesce("value", F.lit(""))))
    if not keep_empty:
        return c.where("value != ''").groupBy(*SHEET, "row_idx").agg(_joined(F.col("value")).alias("line"))
    return c.groupBy(*SHEET, "row_idx").agg(_joined(F.col("value")).alias("line"), F.max(F.length("value")).alias("most")).where("most > 0").drop("most")


def legal_content(cells: DataFrame) -> DataFrame:
    r = rows(cells)
    return r.withColumn("line", F.when(X.contains_any(F.col("line"), P.SHEET_KEYWORDS), F.concat(F.lit("★ "), "line")).otherwise(F.col("line")))


def table_structure(cells: DataFrame) -> DataFrame:
    """Header, rule and rows 2 to 999. ``cells`` holds every cell of the used range."""
    r = rows(cells, keep_empty=True)
    head = r.where("row_idx = 1").select(*SHEET, "row_idx", F.explode(F.array(F.concat(F.lit("表头: "), "line"), F.repeat(F.lit("-"), 50))).alias("line"))
    marked = head.withColumn("part", F.when(F.col("line").startswith("表头"), 0).otherwise(1))
    return marked.unionByName(r.where("row_idx between 2 and 999").withColumn("part", F.lit(0)))


def law_articles(cells: DataFrame) -> DataFrame:
    """Columns 1 and 2 as law and article: (..., law_name, number, content, heading, special) a row.

    A first row with a known column title is a header. A sheet is special if its first law name stands in two rows at
    least and two articles at least have numbers: then the law is named once and articles stand by number.
    """
    v = cells.withColumn("value", X.strip(F.coalesce("value", F.lit(""))))
    header = v.where(F.col("row_idx") == 1).groupBy(*SHEET).agg(F.max(F.col("value").isin(*P.LAW_HEADERS)).alias("header"))
    two = v.groupBy(*SHEET, "row_idx").agg(F.max(F.when(F.col("col_idx") == 1, F.col("value"))).alias("law_name"), F.max(F.when(F.col("col_idx") == 2, F.col("value"))).alias("content"))
    body = two.join(header, [*SHEET], "left").where((F.col("row_idx") > F.when(F.col("header"), 1).otherwise(0)) & ~F.coalesce("content", F.lit("")).isin("", "None")).drop("header")
    body = body.withColumn("law_name", F.coalesce("law_name", F.lit(""))).withColumn("number", X.article_number(F.col("content")))
    named = ~F.col("law_name").isin("", "None")
    sheet = Window.partitionBy(*SHEET)
    first = F.first(F.when(named, F.col("law_name")), ignorenulls=True).over(sheet.orderBy("row_idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    b = body.withColumn("law", first)
    same = F.sum((F.col("law_name") == F.col("law")).cast("int")).over(sheet)
    numbered = F.sum((F.col("number") != "").cast("int")).over(sheet)
    b = b.withColumn("special", F.col("law").isNotNull() & (same >= 2) & (numbered >= 2))
    plain = F.concat(F.lit("【"), F.when((F.col("law_name") == "") & (F.col("number") == ""), "条文").otherwise(F.trim(F.concat_ws(" ", "law_name", "number"))), F.lit("】"))
    special = F.concat(F.lit("【ARTICLE】"), F.when(F.col("number") != "", F.col("number")).otherwise("条文"))
    return b.withColumn("heading", F.when(F.col("special"), special).otherwise(plain))


def law_text(cells: DataFrame) -> DataFrame:
    """(..., text) in the marked-up form that ``parse_law_articles`` reads."""
    b = law_articles(cells)
    body = F.concat_ws("\n", F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_idx", "heading", "content"))), lambda x: F.concat(x["heading"], F.lit("\n"), x["content"], F.lit("\n"))), "\n"))
    t = b.groupBy(*SHEET).agg(body.alias("body"), F.max("special").alias("special"), F.max("law").alias("law"))
    return t.select(*SHEET, F.when(F.col("special"), F.concat(F.lit("【LAW_NAME】\n"), "law", F.lit("\n\n"), "body")).otherwise(F.col("body")).alias("text"))


def info(cells: DataFrame) -> DataFrame:
    used = F.coalesce(F.col("value"), F.lit("")) != ""
    return cells.groupBy(*SHEET).agg(F.max("row_idx").alias("rows"), F.max("col_idx").alias("cols"), F.max(used).alias("has_data"))


def sheet_text(lines: DataFrame) -> DataFrame:
    """(doc_id, text): each sheet's lines under its name."""
    order = "part" if "part" in lines.columns else F.lit(0).alias("part")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_idx", order, "line"))), lambda x: x["line"]), "\n")
    s = lines.groupBy(*SHEET).agg(body.alias("body"))
    t = F.concat(F.lit("【工作表: "), "sheet_name", F.lit("】\n"), "body")
    return s.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sheet_idx", t.alias("t")))), lambda x: x["t"]), "\n\n").alias("text"))


def _lines(texts: DataFrame) -> DataFrame:
    return texts.select(*SHEET, F.posexplode(F.split("text", "\n")).alias("i", "line")).withColumn("line", X.strip(F.col("line"))).where("line != ''")


def _grouped(marked: DataFrame) -> DataFrame:
    """Lines with a marker flag -> sections, numbered by a running count of markers."""
    w = Window.partitionBy(*SHEET).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn("section", F.sum(F.col("marker").cast("int")).over(w))


def parse_law_articles(texts: DataFrame) -> DataFrame:
    """(..., section, heading, content, section_type) of law text; lines before any mark stand alone."""
    lines = _lines(texts).withColumn("marker", F.col("line").startswith("【LAW_NAME】") | F.col("line").startswith("【ARTICLE】") | F.col("line").rlike("^【.*】$"))
    g = _grouped(lines)
    name = F.when(F.col("line").startswith("【LAW_NAME】"), "法规名称").when(F.col("line").startswith("【ARTICLE】"), F.coalesce(F.nullif(F.substring("line", 10, 1 << 30), F.lit("")), F.lit("条文"))).otherwise(F.expr("substring(line, 2, length(line) - 2)"))
    marked = g.where("section > 0").groupBy(*SHEET, "section").agg(F.max(F.when(F.col("marker"), name)).alias("heading"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("marker"), F.struct("i", "line")))), lambda x: x["line"]), "\n").alias("content")).where("content != ''")
    marked = marked.withColumn("section_type", F.when(F.col("heading") == "法规名称", "law_name").otherwise("law_article"))
    alone = g.where("section = 0").select(*SHEET, (F.col("i") - (1 << 30)).cast("bigint").alias("section"), F.concat("sheet_name", F.lit(" - 内容")).alias("heading"), F.col("line").alias("content"), F.lit("general_content").alias("section_type"))
    return marked.withColumn("section", F.col("section").cast("bigint")).unionByName(alone)


def by_table(texts: DataFrame) -> DataFrame:
    """A section for each header line (table n) and for what precedes the first (content)."""
    g = _grouped(_lines(texts).withColumn("marker", F.col("line").startswith("表头:")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "\n")
    s = g.groupBy(*SHEET, "section").agg(body.alias("content"))
    return s.select(*SHEET, "section", F.when(F.col("section") > 0, F.concat(F.lit("表格"), "section")).otherwise("内容1").alias("heading"), "content", F.when(F.col("section") > 0, "table").otherwise("content").alias("section_type"))


def by_importance(texts: DataFrame) -> DataFrame:
    """Starred lines and others, each joined in order."""
    starred = F.col("line").startswith("★")
    line = F.when(starred, X.strip(F.expr("substring(line, 2)"))).otherwise(F.col("line"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", line.alias("l")))), lambda x: x["l"]), "\n")
    kind = F.when(starred, "important_content").otherwise("normal_content")
    return _lines(texts).groupBy(*SHEET, kind.alias("section_type")).agg(body.alias("content")).withColumn("heading", F.when(F.col("section_type") == "important_content", "重要内容").otherwise("一般内容"))


def by_length(texts: DataFrame, limit: int = 2000) -> DataFrame:
    """Lines packed to the limit; a line is never broken."""
    parts = fold(lambda t: K.pack_lines(t.split("\n"), limit), "array<string>")(F.col("text"))
    p = texts.select(*SHEET, F.posexplode(parts).alias("p", "content"))
    return p.select(*SHEET, (F.col("p") + 1).alias("part"), F.format_string("第%d部分", F.col("p") + 1).alias("heading"), X.strip(F.col("content")).alias("content"), F.lit("content_part").alias("section_type"))


def legal_split(texts: DataFrame) -> DataFrame:
    """Sheets by structure marks; sheets without any by importance."""
    from .splitting import legal_sections

    ids = texts.select(*SHEET, F.struct(*SHEET).alias("doc_id2"), "text")
    s = legal_sections(ids.select(F.col("doc_id2").alias("doc_id"), "text"))
    found = s.select("doc_id.*", F.col("seq").alias("section"), "heading", "content", F.lit("legal_article").alias("section_type"))
    rest = by_importance(texts.join(found.select(*SHEET).distinct(), [*SHEET], "left_anti")).withColumn("section", F.lit(0))
    return found.unionByName(rest)
