"""Files as DataFrames: listing, validation, routing, and text extraction. Parsers run in Arrow batches, one file a row."""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions import text as X
from ..functions.slices import slices, values
from . import docx, ole, pdf, rtf, xlsx

EXCEL = ("xlsx", "xls", "xlsm", "xltx", "xltm")
ROUTES = {"docx": "docx", "doc": "docx", "rtf": "rtf", "pdf": "pdf", "wps": "wps", "txt": "txt"} | dict.fromkeys(EXCEL, "excel")

#: format -> function(bytes) -> text. The formats without an entry need a converter from the user.
EXTRACTORS: dict[str, Callable[[bytes], str]] = {}


def read_files(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """(path, name, dir, format, route, length, content)"""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path)
    return describe(f)


def route_of(fmt: Column) -> Column:
    return F.create_map(*(F.lit(x) for kv in ROUTES.items() for x in kv))[fmt]


def describe(files: DataFrame) -> DataFrame:
    parts = F.split("path", "/")
    fmt = X.file_format(F.col("path"))
    return files.select("path", F.element_at(parts, -1).alias("name"), F.element_at(parts, -2).alias("dir"), fmt.alias("format"), route_of(fmt).alias("route"), X.file_type_name(fmt).alias("file_type"), "length", "content")


def validated(files: DataFrame) -> DataFrame:
    """With ``error``: why a file is rejected, or null."""
    before = F.when(F.col("error").isNotNull(), F.col("error")) if "error" in files.columns else F
    why = before.when(F.col("length") == 0, "empty file").when(F.col("route").isNull(), F.concat(F.lit("unsupported format: "), "format"))
    return files.withColumn("error", why)


def domain_of(dir_name, law=("law",), contract=("contract",), rule=("rule", "others")):
    """Helper by directory name."""
    return F.when(dir_name.isin(*law), "legal").when(dir_name.isin(*contract), "contract").when(dir_name.isin(*rule), "regulation")


def decode_text(data: bytes) -> str:
    for encoding in ("utf-8", "gbk"):
        try:
            return data.decode(encoding)
        except UnicodeDecodeError:
            continue
    return data.decode("utf-8", "replace")


def extract_bytes(fmt: str, data: bytes, extractors: dict[str, Callable[[bytes], str]] | None = None) -> str:
    """Text of a file, by a registered extractor, else by its contents: doc and wps files may be compound files, zipped
    XML, RTF or plain text under another name. Nothing is sent anywhere."""
    own = {**EXTRACTORS, **(extractors or {})}
    if fmt in own:
        return own[fmt](data)
    if fmt == "txt":
        return decode_text(data)
    if fmt == "docx":
        return docx.direct_text(data)
    if fmt == "rtf":
        return rtf.extract(data)
    if fmt in EXCEL:
        return xlsx.plain_text(data, sheet_cells)
    if fmt == "pdf":
        return pdf.plain_text(data)
    if fmt in ("doc", "wps"):
        return legacy_text(data)
    raise ValueError(f"no extractor for {fmt}")


def legacy_text(data: bytes) -> str:
    """Text of a doc or wps file, by what it really is; the first reader that finds text counts."""
    if data[:8] == ole.MAGIC:
        return ole.word_text(data)
    if data[:4] == b"PK\x03\x04":
        return docx.direct_text(data)
    if data.lstrip()[:5] == b"{\\rtf":
        return rtf.extract(data)
    text = decode_text(data)
    if text.lstrip()[:1] == "<":  # HTML under another name
        text = html.unescape(re.sub(r"(?s)<(script|style).*?</\1>|<[^>]*>", " ", re.sub(r"(?i)</(p|div|tr|h\d|li)>|<br[^>]*>", "\n", text)))
    if "\x00" in text or not text.strip():
        raise ValueError("no text found")
    return "\n".join(x.strip() for x in text.strip().split("\n"))


def sheet_cells(data: bytes, fmt: str = "") -> list[tuple[int, str, int, int, str]]:
    """Cells of a workbook, zipped or compound, whatever its name says."""
    return ole.workbook_cells(data) if data[:8] == ole.MAGIC else xlsx.cells(data)


def extract_text(files: DataFrame, extractors: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """(path, text, error): a failure is reported, not hidden behind an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in slices(tuple(b.columns))):
            texts, errors = [], []
            for fmt, data, bad in zip(*map(values, part[1:])):
                text = None
                if bad is None:
                    try:
                        text = extract_bytes(fmt, data, extractors)
                    except Exception as e:  # noqa: BLE001 a broken file is data
                        bad = f"{type(e).__name__}: {e}"
                texts.append(text)
                errors.append(bad)
            yield pa.RecordBatch.from_arrays([part[0], pa.array(texts, pa.string()), pa.array(errors, pa.string())], ["path", "text", "error"])

    return validated(files).select("path", "format", "content", "error").mapInArrow(run, "path string, text string, error string")


def _rows(files: DataFrame, parse: Callable[[bytes, str], list[tuple]], schema: str) -> DataFrame:
    """What ``parse`` gives of each file's content and format, and ``error``: a file that can't be parsed is one row with the reason alone."""
    names = [*(x.split()[0] for x in schema.split(", ")), "error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = _arrow(schema)
        for part in (p for b in batches for p in slices(tuple(b.columns))):
            out = []
            for path, data, fmt, bad in zip(*map(values, part)):
                if bad is None:
                    try:
                        out += [(path, *r, None) for r in parse(data, fmt)]
                        continue
                    except Exception as e:  # noqa: BLE001 a broken file is data
                        bad = f"{type(e).__name__}: {e}"
                out.append((path, *[None] * (len(kinds) - 1), bad))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate([*kinds, pa.string()])], names)

    return validated(files).select("path", "content", "format", "error").mapInArrow(run, f"{schema}, error string")


def _arrow(schema: str) -> list[pa.DataType]:
    kinds = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "double": pa.float64()}
    return [kinds[x.split()[1]] for x in schema.split(", ")]


_ELEMENTS = "path string, seq int, text string, style string, type string, row_index int, cell_index int, is_merged boolean"


def docx_elements(files: DataFrame) -> DataFrame:
    """(path, seq, text, style, is_heading, level, type, source, table_info, error) of Word files."""
    return _elements(files.where("format = 'docx'")).withColumn("source", F.lit("docx"))


def flow_elements(files: DataFrame, extractors: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """The same of files of running text in all formats, without ``source``: paragraphs and cells of Word files, also under
    the names of doc and wps, and the lines of all others."""
    return _elements(files, extractors)


def _elements(files: DataFrame, extractors: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    own = {**EXTRACTORS, **(extractors or {})}

    def parse(data: bytes, fmt: str) -> list[tuple]:
        if fmt not in own and (fmt == "docx" or (fmt in ("doc", "wps") and data[:4] == b"PK\x03\x04")):
            return docx.elements(data)
        return [(i, line, None, "line", None, None, None) for i, line in enumerate(extract_bytes(fmt, data, own).split("\n"))]

    raw = _rows(files, parse, _ELEMENTS)
    t = F.when(F.col("type") == "line", X.strip(F.col("text"))).otherwise(X.clean_text(F.col("text")))
    e = raw.withColumn("text", t).where("text != '' or error is not null")
    head = F.coalesce((F.col("type") != "table_cell") & X.word_heading(F.col("style"), F.col("text")), F.lit(False))
    level = F.when(head | (F.col("type") == "line"), X.word_heading_level(F.col("style"), F.col("text"))).otherwise(0)
    return e.select("path", "seq", "text", "style", head.alias("is_heading"), level.alias("level"), "type", F.struct("row_index", "cell_index", "is_merged").alias("table_info"), "error")


def xlsx_cells(files: DataFrame) -> DataFrame:
    """Cells of workbooks: (doc_id = path, sheet_idx, sheet_name, row_idx, col_idx, value, error)."""
    c = _rows(files.where(F.col("format").isin(*EXCEL)), sheet_cells, "path string, sheet_idx int, sheet_name string, row_idx int, col_idx int, value string")
    return c.withColumnRenamed("path", "doc_id")


def pdf_spans(files: DataFrame) -> DataFrame:
    """Lines of digital PDF files: (path, page, seq, text, font_size, error)."""
    return _rows(files.where("format = 'pdf'"), lambda data, fmt: pdf.spans(data), "path string, page int, seq int, text string, font_size double")


def pdf_outline(files: DataFrame) -> DataFrame:
    """Outline entries of PDF files: (path, seq, level, title, page, error)."""
    return _rows(files.where("format = 'pdf'"), lambda data, fmt: pdf.outline(data), "path string, seq int, level int, title string, page int")


def pdf_elements(files: DataFrame) -> DataFrame:
    """(path, seq, text, is_heading, level, error) of PDF files: headings are the lines that the outline names on their
    page, else those of larger fonts, else those that look like one."""
    from ..operators.hierarchy import font_headings

    spans = pdf_spans(files)
    marks = pdf_outline(files).where("error is null").select("path", "page", F.col("title").alias("text"), F.col("level").alias("mark")).distinct()
    read = font_headings(spans.where("text is not null").withColumnRenamed("path", "doc_id")).withColumnRenamed("doc_id", "path")
    e = read.join(marks.groupBy("path", "page", "text").agg(F.min("mark").alias("mark")), ["path", "page", "text"], "left")
    doc = Window.partitionBy("path")
    kind = F.when(F.max("mark").over(doc).isNotNull(), "outline").when(F.max("is_heading").over(doc), "font").otherwise("pattern")
    pattern = X.legal_heading(F.col("text"))
    head = F.when(F.col("kind") == "outline", F.col("mark").isNotNull()).when(F.col("kind") == "font", F.col("is_heading")).otherwise(pattern)
    level = F.when(F.col("kind") == "outline", F.col("mark")).when(F.col("kind") == "font", F.col("level")).otherwise(X.legal_level(F.col("text")))
    good = e.withColumn("kind", kind).select("path", "seq", "text", head.alias("is_heading"), F.when(head, level).otherwise(0).alias("level"), F.lit(None).cast("string").alias("error"))
    return good.unionByName(spans.where("error is not null").select("path", "seq", "text", F.lit(False).alias("is_heading"), F.lit(0).alias("level"), "error"))


def converted(files: DataFrame, converters: dict[str, tuple[str, Callable[[bytes], bytes]]]) -> DataFrame:
    """Files of other formats made into those that are read here: format -> (new format, function(bytes) -> bytes).

    Adds ``metadata`` (original_format, original_file, conversion_method) and ``error``; a failed conversion keeps its file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in slices(tuple(b.columns))):
            out = []
            for path, fmt, data in zip(*map(values, part)):
                meta, bad = None, None
                if fmt in converters:
                    target, f = converters[fmt]
                    try:
                        data, meta, fmt = f(data), [("original_format", fmt), ("original_file", path), ("conversion_method", getattr(f, "__name__", "function"))], target
                    except Exception as e:  # noqa: BLE001 a file that can't be converted is data
                        bad = f"{type(e).__name__}: {e}"
                out.append((path, fmt, data, meta, bad))
            kinds = (pa.string(), pa.string(), pa.binary(), pa.map_(pa.string(), pa.string()), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["path", "format", "content", "metadata", "error"])

    out = files.select("path", "format", "content").mapInArrow(run, "path string, format string, content binary, metadata map<string,string>, error string")
    return out.withColumn("route", route_of(F.col("format"))).withColumn("length", F.octet_length("content").cast("bigint"))


def rtf_sections(texts: DataFrame) -> DataFrame:
    """(doc_id, seq, heading, content) of RTF text (doc_id, text): title and articles, or title and rest."""
    from ..operators.splitting import fold

    parts = fold(lambda t: rtf.sections(K.reflow_lines(t)), "array<struct<heading:string,content:string>>")(F.col("text"))
    return texts.select("doc_id", F.posexplode(parts).alias("seq", "s")).select("doc_id", "seq", "s.heading", "s.content")


def pdf_page_text(pages: DataFrame) -> DataFrame:
    """(doc_id, text) of pages (doc_id, page, text) under banners, as a parser of the user's gives them."""
    banner = F.concat(F.lit("--- 第"), F.col("page").cast("string"), F.lit("页 ---\n"), "text")
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", banner.alias("t")))), lambda x: x["t"]), "\n\n").alias("text"))


def digital_pdf(pages: DataFrame) -> DataFrame:
    """(doc_id, digital): whether one of the first three pages has over 50 characters."""
    return pages.where("page <= 3").groupBy("doc_id").agg(F.max(F.length(X.strip(F.col("text"))) > 50).alias("digital"))
