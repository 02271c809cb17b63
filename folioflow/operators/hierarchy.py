"""Section trees as edge tables, and their flattening."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions import text as X
from .splitting import fold

STRATEGIES = ("finest_granularity", "all_levels", "parent_only")
_TREE = "struct<element:array<int>,parent:array<int>,first:array<int>,stop:array<int>,path:array<array<int>>,is_leaf:array<boolean>>"


def enhance(elements: DataFrame, legal: bool = True, custom: tuple[str, ...] = ()) -> DataFrame:
    """Elements that are no headings yet are tested again by the legal rules."""
    more = ~F.col("is_heading") & X.legal_heading(F.col("text"), legal, custom=custom)
    return elements.withColumn("level", F.when(more, X.legal_level(F.col("text"))).otherwise(F.col("level"))).withColumn("is_heading", F.col("is_heading") | more)


def build(elements: DataFrame, with_heading: bool = True, joiner: str = "\n\n") -> DataFrame:
    """(doc_id, seq, text, is_heading, level) -> sections (doc_id, seq, parent_seq, depth, level, heading, content, path, is_leaf).

    A heading closes the open sections of its level or deeper. Text before any heading goes to "Document Content". A section
    is a run of elements, from its heading to the next one, so that one gathering of a document's elements does it all: a
    kernel sees flags and levels alone and answers with places. The sections are put together before they become rows, so
    that no section carries its whole document along. Elements with ``error`` give a section with it and no content.
    """
    bad = ["error"] if "error" in elements.columns else []
    e = elements.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("seq", "text", "is_heading", "level"))).alias("e"), *(F.max(c).alias(c) for c in bad))
    placed = e.withColumn("t", fold(K.tree_columns, _TREE)(F.col("e.is_heading"), F.col("e.level")))
    at = lambda i: F.get("e", i)

    def section(x: Column, k: Column) -> Column:
        own, named = x["element"], x["element"] >= 0
        skip = F.when(named & F.lit(not with_heading), 1).otherwise(0)
        body = F.when(x["stop"] > x["first"] + skip, F.transform(F.sequence(x["first"] + skip, x["stop"] - 1), lambda i: at(i)["text"])).otherwise(F.array().cast("array<string>"))
        return F.struct(
            (k + 1).alias("seq"), F.when(x["parent"] >= 0, x["parent"]).alias("parent_seq"), own.alias("element"), F.size(x["path"]).alias("depth"),
            F.when(named, at(own)["level"]).otherwise(1).alias("level"), F.when(named, at(own)["text"]).otherwise("Document Content").alias("heading"), F.array_join(body, joiner).alias("content"),
            F.transform(x["path"], lambda i: F.when(i >= 0, at(i)["text"]).otherwise("Document Content")).alias("path"), x["is_leaf"].alias("is_leaf"),
        )

    fields = F.arrays_zip(*(F.col(f"t.{k}") for k in ("element", "parent", "first", "stop", "path", "is_leaf")))
    rows = placed.select("doc_id", F.explode(F.transform(fields, section)).alias("s"), *bad)
    return rows.select("doc_id", "s.*", *bad)


def flatten(sections: DataFrame, strategy: str = "finest_granularity") -> DataFrame:
    """(doc_id, chunk_id, level, content). finest (and parent_only, its alias): leaves, by content or else by path.

    all_levels: every section with content, and leaves without content by heading.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy {strategy}")
    body = X.strip(F.coalesce(F.col("content"), F.lit("")))
    if strategy == "all_levels":
        text, keep = F.when(body != "", body).otherwise(X.strip(F.col("heading"))), (body != "") | F.col("is_leaf")
    else:
        text, keep = F.when(body != "", body).otherwise(F.array_join("path", " > ")), F.col("is_leaf")
    if "error" not in sections.columns:
        return _numbered(sections.where(keep).select("doc_id", "seq", "level", text.alias("content")).where("content != ''"))
    good = F.col("error").isNull()
    rows = sections.where(keep | ~good).select("doc_id", "seq", "level", F.when(good, text).alias("content"), "error").where("content != '' or error is not null")
    return _numbered(rows).withColumn("chunk_id", F.when(good, F.col("chunk_id")))


def _numbered(rows: DataFrame) -> DataFrame:
    """With chunk_id from 1 in the order of seq; rows with ``error`` go through."""
    more = ["error"] if "error" in rows.columns else []
    return rows.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("seq")).alias("chunk_id"), "level", "content", *more)


def flatten_with_paths(sections: DataFrame, strategy: str = "finest_granularity", limit: int | None = None, overlap: int = 0) -> DataFrame:
    """Chunks "path, empty line, content", cleaned, near-duplicates of the document removed, and strictly sized if asked."""
    from . import dedup
    from .splitting import strict_sizes

    body = X.strip(F.coalesce(F.col("content"), F.lit("")))
    keep = (body != "") & (F.lit(strategy == "all_levels") | F.col("is_leaf"))
    text = X.clean_text(F.concat(F.array_join("path", " > "), F.lit("\n\n"), body))
    chunks = dedup.distinct_chunks(_numbered(sections.where(keep).select("doc_id", "seq", "level", text.alias("content"))).drop("level"))
    return strict_sizes(chunks, limit, overlap) if limit else chunks


def concat_text(sections: DataFrame, joiner: str = "\n", with_heading: bool = True) -> DataFrame:
    """(doc_id, text): headings and contents in order, empty ones left out."""
    parts = F.array("heading", "content") if with_heading else F.array("content")
    full = F.filter(parts, lambda x: F.coalesce(x, F.lit("")) != "")
    agg = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("seq", full.alias("p")))), lambda x: x["p"]))
    return sections.groupBy("doc_id").agg(F.array_join(agg, joiner).alias("text"))


def pattern_sections(docs: DataFrame, unit: str = "line") -> DataFrame:
    """Flat sections (doc_id, seq, heading, content, level) of text without styles.

    unit ``line``: legal headings among lines; what precedes the first has no heading and level 0. ``paragraph``: the same
    among paragraphs, with general levels and "Document Content" at level 1.
    """
    return _pattern_sections(docs, F.lit(unit == "line"))


def _pattern_sections(docs: DataFrame, by_line: Column) -> DataFrame:
    """A document's sections are made in its row, so that no lines are sorted: a heading's runs to the next one."""
    mark = F.when(by_line, "\n").otherwise("\n\n")
    lines = F.filter(F.transform(F.split("text", mark), X.strip), lambda x: x != "")
    rated = docs.select("doc_id", by_line.alias("by_line"), F.transform(lines, lambda x: F.struct(x.alias("t"), X.legal_heading(x).alias("h"))).alias("z")).where(F.size("z") > 0)
    led = F.get("z", F.lit(0))["h"]
    heads = F.filter(F.sequence(F.lit(0), F.size("z") - 1), lambda i: F.get("z", i)["h"])
    placed = rated.select("doc_id", "by_line", "z", led.alias("led"), F.when(led, heads).otherwise(F.concat(F.array(F.lit(-1)), heads)).alias("b"))

    def section(own: Column, k: Column) -> Column:
        stop = F.coalesce(F.get("b", k + 1), F.size("z"))
        t = F.get("z", own)["t"]
        body = F.transform(F.when(stop > own + 1, F.sequence(own + 1, stop - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.get("z", i)["t"])
        body = F.when(F.col("by_line"), F.array_join(body, "\n")).otherwise(F.array_join(body, "\n\n"))
        name, level = F.when(F.col("by_line"), "").otherwise("Document Content"), F.when(F.col("by_line"), X.legal_level(t)).otherwise(X.heading_level(t))
        return F.struct((k + F.col("led").cast("int")).alias("seq"), F.when(own >= 0, t).otherwise(name).alias("heading"), body.alias("content"), F.when(own >= 0, level).when(F.col("by_line"), 0).otherwise(1).alias("level"))

    return placed.select("doc_id", F.explode(F.transform("b", section)).alias("s")).select("doc_id", "s.*")


def single_section(docs: DataFrame) -> DataFrame:
    return docs.where(X.strip(F.col("text")) != "").select("doc_id", F.lit(1).alias("seq"), F.lit("Document Content").alias("heading"), X.clean_text(F.col("text")).alias("content"), F.lit(1).alias("level"))


def pdf_sections(docs: DataFrame) -> DataFrame:
    """The cascade for page text: line patterns if a document has headings, else paragraphs; a text without either is blank.

    Which attempt a document takes is decided in its row, so that no attempt is computed for nothing or joined away.
    """
    return _pattern_sections(docs, F.coalesce(F.exists(F.split("text", "\n"), lambda x: X.legal_heading(X.strip(x))), F.lit(False)))


def preorder(sections: DataFrame) -> DataFrame:
    """Sections that have content, in order, without their children."""
    return sections.where(X.strip(F.col("content")) != "").select("doc_id", "seq", "heading", "content", "level")


def clean_small(sections: DataFrame) -> DataFrame:
    """Without sections of under 10 characters under a heading of under 5; heading and content joined."""
    keep = ~((F.length("content") < 10) & (F.length("heading") < 5))
    return sections.where(keep).withColumn("content", F.when(F.col("heading") != "", F.concat_ws("\n", "heading", "content")).otherwise(F.col("content")))


def lines(docs: DataFrame) -> DataFrame:
    """Plain text as elements, a line each, by the rules for unstyled paragraphs."""
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("seq", "line")).withColumn("text", X.strip(F.col("line"))).where("text != ''")
    return rows.select("doc_id", "seq", "text", X.word_heading(F.lit(None).cast("string"), F.col("text")).alias("is_heading"), X.heading_level(F.col("text")).alias("level"))


def font_headings(spans: DataFrame, ratio: float = 1.2) -> DataFrame:
    """Spans (doc_id, page, seq, text, font_size) with is_heading and level: sizes above ratio x the mean, weighted by
    characters, are heading sizes, the largest level 1; the text must look like a heading too."""
    n, doc = F.length("text"), Window.partitionBy("doc_id")
    mean = F.sum(F.col("font_size") * n).over(doc) / F.sum(n).over(doc)
    big = spans.withColumn("big", F.coalesce(F.col("font_size") > ratio * mean, F.lit(False)))
    rank = F.dense_rank().over(doc.orderBy(F.desc_nulls_last("font_size")))  # heading sizes are the largest
    h = F.col("big") & X.legal_heading(F.col("text"), legal=False)
    return big.withColumn("rank", rank).select("doc_id", "page", "seq", "text", "font_size", h.alias("is_heading"), F.when(h, F.col("rank")).otherwise(0).alias("level"))


def outline_sections(pages: DataFrame, outline: DataFrame) -> DataFrame:
    """Pages (doc_id, page, text) and outline (doc_id, seq, level, title, page) -> elements' sections with the text of
    the pages from their own to before the next entry's, at least their own."""
    nxt = F.lead("page").over(Window.partitionBy("doc_id").orderBy("seq"))
    o = outline.withColumn("stop", F.greatest(F.coalesce(nxt, F.lit(1 << 30)) - 1, F.col("page"))).alias("o")
    joined = o.join(pages.alias("p"), (F.col("o.doc_id") == F.col("p.doc_id")) & F.col("p.page").between(F.col("o.page"), F.col("o.stop")), "left")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("p.page").alias("page"), F.col("p.text").alias("text")))), lambda x: x["text"]), "\n")
    return joined.groupBy("o.doc_id", "o.seq", "o.level", "o.title").agg(text.alias("content")).withColumnRenamed("title", "heading")


def outline_tree(pages: DataFrame, outline: DataFrame) -> DataFrame:
    """The sections of ``outline_sections`` as a tree: with parent_seq, depth, path and is_leaf by the outline's levels."""
    flat = outline_sections(pages, outline)
    tree = build(outline.select("doc_id", "seq", F.col("title").alias("text"), F.lit(True).alias("is_heading"), "level"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("seq")) - 1
    return flat.withColumn("element", place).join(tree.select("doc_id", "element", "parent_seq", "depth", "path", "is_leaf"), ["doc_id", "element"]).drop("element")
