"""Public entry points. Each takes and returns DataFrames; nothing runs until an action does.

A file that can't be read is a row with its ``error`` and nothing else, wherever files go in; all others go on.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import hierarchy as H
from ..operators import splitting as C
from ..operators import tabular as T
from ..sources import files as S
from .options import DOMAINS, Options, for_domain

SPLITTERS: dict[str, Callable[[DataFrame], DataFrame]] = {}
_ELEMENT = ["doc_id", "seq", "text", "is_heading", "level", "error"]


def register(fmt: str, splitter: Callable[[DataFrame], DataFrame]) -> None:
    """A splitter of the user's, in place of the one built in: files of ``fmt`` -> elements (path, seq, text, is_heading, level)."""
    SPLITTERS[fmt] = splitter


def extract_text(files: DataFrame, extractors=None) -> DataFrame:
    return S.extract_text(files, extractors)


def _sheets(cells: DataFrame, mode: str) -> DataFrame:
    """(doc_id, sheet_idx, sheet_name, text) of workbooks by an extraction mode, or of the mode that fits each (auto)."""
    if mode == "law_articles":
        return T.law_text(cells)
    lines = {"legal_content": T.legal_content, "table_structure": T.table_structure, "all_content": T.rows}[mode](cells)
    part = "part" if "part" in lines.columns else F.lit(0).alias("part")
    return lines.groupBy(*T.SHEET).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_idx", part, "line"))), lambda x: x["line"]), "\n").alias("text"))


def sheet_sections(cells: DataFrame, mode: str = "legal_content") -> DataFrame:
    """(doc_id, seq, heading, content, section_type) of workbooks: law and article rows by their marks, tables by their
    headers, all else by structure marks or importance; a sheet's name leads its headings where a workbook has several."""
    texts = _sheets(cells, mode)
    if mode == "law_articles":
        s = T.parse_law_articles(texts)
    elif mode == "table_structure":
        s = T.by_table(texts)
    else:
        s = T.legal_split(texts)
    s = s.select(*T.SHEET, F.col("section").cast("bigint").alias("section"), "heading", "content", "section_type").where("content != ''")
    doc = H.Window.partitionBy("doc_id")
    sheets = F.size(F.collect_set("sheet_idx").over(doc))
    seq = F.row_number().over(doc.orderBy("sheet_idx", "section", "section_type"))
    return s.select("doc_id", seq.alias("seq"), X.sheet_heading(F.col("sheet_name"), F.col("heading"), sheets).alias("heading"), "content", "section_type")


def _sheet_elements(files: DataFrame, mode: str) -> DataFrame:
    cells = S.xlsx_cells(files)
    s = sheet_sections(cells.where("error is null").drop("error"), mode)
    both = s.select("doc_id", F.explode(F.array(F.struct((2 * F.col("seq")).alias("seq"), F.col("heading").alias("text"), F.lit(True).alias("is_heading")), F.struct((2 * F.col("seq") + 1).alias("seq"), F.col("content").alias("text"), F.lit(False).alias("is_heading")))).alias("x"))
    good = both.select("doc_id", "x.seq", "x.text", "x.is_heading", F.lit(1).alias("level"), F.lit(None).cast("string").alias("error"))
    bad = cells.where("error is not null").select("doc_id", F.lit(None).cast("int").alias("seq"), F.lit(None).cast("string").alias("text"), F.lit(False).alias("is_heading"), F.lit(0).alias("level"), "error")
    return good.unionByName(bad)


def elements_of(files: DataFrame, options: Options = Options(), sheet_mode: str = "legal_content") -> DataFrame:
    """(doc_id = path, seq, text, is_heading, level, error) of the files of all formats, by registered splitters first."""
    own = files.where(~F.coalesce(F.col("format").isin(list(SPLITTERS)), F.lit(False))) if SPLITTERS else files
    sheet = F.coalesce(F.col("format").isin(*S.EXCEL), F.lit(False))
    paged = F.coalesce(F.col("format") == "pdf", F.lit(False)) & ~F.lit("pdf" in S.EXTRACTORS)
    read = [S.flow_elements(own.where(~sheet & ~paged)), S.pdf_elements(own.where(paged))]
    parts = [_sheet_elements(own.where(sheet), sheet_mode), *(e.withColumnRenamed("path", "doc_id").select(_ELEMENT) for e in read)]
    for fmt, splitter in SPLITTERS.items():
        e = splitter(files.where(F.col("format") == fmt)).withColumnRenamed("path", "doc_id")
        parts.append((e if "error" in e.columns else e.withColumn("error", F.lit(None).cast("string"))).select(_ELEMENT))
    return H.enhance(reduce(DataFrame.unionByName, parts), custom=options.custom_patterns)


def _failed(elements: DataFrame, like: DataFrame) -> DataFrame:
    names = {f.name: f.dataType for f in like.schema}
    return elements.where("error is not null").select("doc_id", *(F.lit(None).cast(t).alias(c) for c, t in names.items() if c not in ("doc_id", "error")), "error")


def split_sections(files: DataFrame, options: Options = Options(), sheet_mode: str = "legal_content") -> DataFrame:
    """Section trees as edge tables, with ``error``."""
    return H.build(elements_of(files, options, sheet_mode))


def flatten_sections(sections: DataFrame, options: Options = Options()) -> DataFrame:
    good = sections.where("error is null") if "error" in sections.columns else sections
    return H.flatten_with_paths(good, options.strategy, options.max_tokens if options.strict_max_tokens else None, options.overlap)


def split_document(files: DataFrame, options: Options = Options(), sheet_mode: str = "legal_content") -> DataFrame:
    """(doc_id, chunk_id, content, error)"""
    chunks = H.flatten(split_sections(files, options, sheet_mode), options.strategy).drop("level")
    return C.strict_sizes(chunks, options.max_tokens, options.overlap) if options.strict_max_tokens else chunks


def simple_chunk_text(docs: DataFrame, max_chunk_size: int = 800, overlap_ratio: float = 0.1, **kw) -> DataFrame:
    return C.simple_chunks(docs, max_chunk_size, overlap_ratio, **kw)


def simple_chunk_file(files: DataFrame, max_chunk_size: int = 800, overlap_ratio: float = 0.1) -> DataFrame:
    """As ``simple_chunk_text``, with source_file, file_type and error."""
    texts = S.extract_text(files).withColumnRenamed("path", "doc_id")
    every = C.simple_chunks(texts, max_chunk_size, overlap_ratio)
    return every.withColumn("source_file", F.element_at(F.split("doc_id", "/"), -1)).withColumn("file_type", X.file_type_name(X.file_format(F.col("doc_id"))))


def split_legal_files(files: DataFrame, options: Options | None = None) -> DataFrame:
    """(doc_id, chunk_id, content, error) of files of laws. A workbook whose sheets hold law and article columns is its rows,
    a chunk each; any other file is its merged text, as ``split_legal_text`` takes it."""
    book = F.coalesce(F.col("format").isin(*S.EXCEL), F.lit(False))
    cells = S.xlsx_cells(files.where(book))
    good = sheet_sections(cells.where("error is null").drop("error"), "law_articles").where("section_type = 'law_article'")
    number = F.row_number().over(H.Window.partitionBy("doc_id").orderBy("seq"))
    rows = good.select("doc_id", number.alias("chunk_id"), F.concat("heading", F.lit("\n"), "content").alias("content")).withColumn("error", F.lit(None).cast("string"))
    texts = S.extract_text(files.where(~book)).withColumnRenamed("path", "doc_id")
    chunks = split_legal_text(texts.where("error is null").select("doc_id", "text"), options).withColumn("error", F.lit(None).cast("string"))
    return rows.unionByName(chunks).unionByName(_failed(cells, rows)).unionByName(_failed(texts, chunks))


def split_directory(files: DataFrame) -> DataFrame:
    """(dir, doc_id, domain, chunk_id, content, error) of files by the domain that their directory's name says."""
    known = files.withColumn("domain", S.domain_of(F.col("dir")))
    legal = split_legal_files(known.where("domain = 'legal'")).withColumn("domain", F.lit("legal"))
    parts = [legal]
    for domain in ("contract", "regulation"):
        o = for_domain(domain)
        chunks = H.flatten(split_sections(known.where(F.col("domain") == domain)), o.strategy).drop("level")
        parts.append(C.strict_sizes(chunks, o.max_tokens, o.overlap).withColumn("domain", F.lit(domain)))
    out = reduce(DataFrame.unionByName, parts)
    return out.select(F.element_at(F.split("doc_id", "/"), -2).alias("dir"), "doc_id", "domain", "chunk_id", "content", "error")


def directory_counters(chunks: DataFrame) -> DataFrame:
    """(dir, files, success, failed, chunks) of ``split_directory``, with a null dir in total."""
    one = chunks.groupBy("dir", "doc_id").agg(F.max("error").alias("error"), F.count("chunk_id").alias("chunks"))
    from ..operators.stats import batch_counters

    return batch_counters(one)


def split_legal_text(docs: DataFrame, options: Options | None = None) -> DataFrame:
    """Merged text -> size control with an overlap of a tenth -> repair of cut articles."""
    o = options or for_domain("legal")
    return C.repair_articles(C.slide(docs, o.max_tokens, o.max_tokens // 10, o.split_by_sentence))


def split_domain_text(docs: DataFrame, domain: str, kind: str = "", **given) -> DataFrame:
    """Contracts and regulations: lines -> tree -> flattened by the type's strategy and size, with a flag for what matters."""
    if domain not in DOMAINS:
        raise ValueError(f"domain {domain}")
    o = for_domain(domain, kind, **given)
    if domain == "legal":
        return split_legal_text(docs, o)
    chunks = H.flatten(H.build(H.enhance(H.lines(docs), legal=False)), o.strategy).drop("level")
    sized = C.strict_sizes(chunks, o.max_tokens, o.overlap) if o.strict_max_tokens else chunks
    flag = X.is_important(F.col("content")).alias("is_important") if domain == "contract" else X.is_process(F.col("content")).alias("is_process")
    return sized.select("*", flag)


def supported_formats() -> list[str]:
    return sorted({*S.ROUTES, *SPLITTERS})


def capabilities() -> dict[str, dict]:
    own = set(S.ROUTES) | set(S.EXTRACTORS) | set(SPLITTERS)
    return {f: {"route": S.ROUTES.get(f, "custom"), "supported": f in own, "needs_converter": f not in own} for f in supported_formats()}


def dependencies() -> dict[str, bool]:
    from importlib.util import find_spec

    return {name: find_spec(name) is not None for name in ("pyspark", "pyarrow", "pandas", "numpy", "tiktoken")}


def write_chunks(chunks: DataFrame, path: str, fmt: str = "parquet", by: str | None = None) -> None:
    """Parquet, JSON or text (numbered, one a line) files."""
    w = chunks.select(F.concat_ws("\t", "doc_id", "chunk_id", F.regexp_replace("content", r"[\n\t]", " ")).alias("value")) if fmt == "text" else chunks
    writer = w.write.mode("overwrite")
    (writer.partitionBy(by) if by and fmt != "text" else writer).format(fmt).save(path)
