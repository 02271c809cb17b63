"""Segmenters and chunkers: (doc_id, text) -> (doc_id, chunk_id, content). One row a document goes in; nothing shuffles."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import kernels as K
from ..functions import patterns as P
from ..functions import text as X
from ..functions.slices import slices, values


def fold(kernel: Callable, result: str, *args) -> Callable[..., Column]:
    """A kernel over whole columns as an Arrow-batched UDF, in slices of a batch; nulls stay null."""

    def udf(n: int) -> Callable[..., Column]:
        kind = to_arrow_type(T.DataType.fromDDL(result))

        def run(batches):
            for batch in batches:
                for part in slices(batch if n > 1 else (batch,)):
                    rows = zip(*map(values, part))
                    yield pa.array([None if any(v is None for v in row) else kernel(*row, *args) for row in rows], kind)

        run.__annotations__ = {"batches": Iterator[tuple[pa.Array, ...]] if n > 1 else Iterator[pa.Array], "return": Iterator[pa.Array]}
        return F.arrow_udf(run, result)

    return lambda *cols: udf(len(cols))(*cols)


def exploded(docs: DataFrame, chunks: Column, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, chunk_id from 1, content)"""
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(chunks).alias("p", "content")).select("doc_id", (F.col("p") + 1).alias("chunk_id"), "content")


def _positive(limit: int, overlap: int = 0) -> None:
    if limit <= 0 or overlap < 0:
        raise ValueError("max_tokens must be positive and overlap not negative")


def sentence_rows(docs: DataFrame) -> DataFrame:
    return exploded(docs, X.sentences(F.col("text")))


def pack_sentences(docs: DataFrame, limit: int = 500, overlap: int = 50) -> DataFrame:
    """Sentence-priority packing: chunks of whole sentences with a sentence overlap."""
    _positive(limit, overlap)
    return exploded(docs, fold(K.pack_sentences, "array<string>", limit, overlap)(F.col("text")))


def natural_breaks(docs: DataFrame, limit: int = 2000) -> DataFrame:
    _positive(limit)
    return exploded(docs, fold(K.natural_breaks, "array<string>", limit)(F.col("text")))


def windows(docs: DataFrame, limit: int, overlap: int = 0) -> DataFrame:
    """Windows of ``limit`` characters; overlap 0 is the forced split. An overlap of limit is an error, more gives none."""
    _positive(limit, overlap)
    step = limit - overlap
    if step == 0:
        raise ValueError("overlap must be below max_tokens")
    if step < 0:
        return exploded(docs.where("false"), F.array(F.col("text")))
    n = F.length("text")
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(step)))
    return exploded(docs, F.transform(starts, lambda s: F.substring(F.col("text"), s + 1, F.lit(limit))))


def slide(docs: DataFrame, limit: int = 2000, overlap: int = 200, by_sentence: bool = True, structure: bool = True) -> DataFrame:
    """The dispatcher: texts within the limit stay whole, structured ones are cut at list marks (``structure``), others by sentences or windows."""
    _positive(limit, overlap)
    return exploded(docs, fold(K.slide, "array<string>", limit, overlap, by_sentence, structure)(F.col("text")))


def marker_sections(docs: DataFrame) -> DataFrame:
    return exploded(docs, fold(K.marker_sections, "array<string>")(F.col("text")))


def pack_structure(docs: DataFrame, limit: int = 2000, overlap: int = 200) -> DataFrame:
    _positive(limit, overlap)
    return exploded(docs, fold(K.pack_structure, "array<string>", limit, overlap)(F.col("text")))


_CURSOR = "array<struct<start_pos:int,end_pos:int,content:string>>"


def simple_chunks(docs: DataFrame, limit: int = 800, ratio: float = 0.1, drop_contained: bool = False) -> DataFrame:
    """Sentence-complete cursor chunks: (doc_id, chunk_id, total_chunks, start_pos, end_pos, length, content)."""
    _positive(limit)
    kernel = lambda t: [{"start_pos": a, "end_pos": b, "content": c} for a, b, c in K.cursor(t, limit, ratio, drop_contained)]
    more = ["error"] if "error" in docs.columns else []  # rows of files that can't be read go through
    chunks = docs.select("doc_id", *more, fold(kernel, _CURSOR)(F.col("text")).alias("c"))
    rows = chunks.select("doc_id", *more, F.size("c").alias("total_chunks"), F.posexplode_outer("c").alias("p", "x")).where("x is not null" + " or error is not null" * len(more))
    return rows.select("doc_id", (F.col("p") + 1).alias("chunk_id"), "total_chunks", "x.start_pos", "x.end_pos", F.length("x.content").alias("length"), "x.content", *more)


def strict_sizes(chunks: DataFrame, limit: int, overlap: int = 0) -> DataFrame:
    """Chunks over the limit are split by sentences; a longer single sentence stays. Order and numbering follow."""
    _positive(limit, overlap)
    more = ["error"] if "error" in chunks.columns else []  # rows of files that can't be read go through
    parts = F.when(F.col("content").isNull() | (F.length("content") <= limit), F.array("content")).otherwise(fold(K.split_oversized, "array<string>", limit, overlap)(F.col("content")))
    w = F.row_number().over(_by_doc("chunk_id", "p"))
    return chunks.select("doc_id", "chunk_id", *more, F.posexplode(parts).alias("p", "content")).select("doc_id", F.when(F.col("chunk_id").isNotNull(), w).alias("chunk_id"), "content", *more)


def _by_doc(*order: str):
    return Window.partitionBy("doc_id").orderBy(*order)


def repair_articles(chunks: DataFrame) -> DataFrame:
    """Joins truncated articles with the next chunk, per document."""
    ordered = chunks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_id", "content"))).alias("c"))
    return exploded(ordered, fold(K.repair, "array<string>")(F.col("c.content")))


def section_parts(sections: DataFrame, limit: int, overlap: int, *styles: str) -> DataFrame:
    """Size control of sections (doc_id, seq, heading, content, level): oversize content becomes parts.

    style: ``sibling`` numbers parts after the first, ``child`` gives an emptied section children one level down. Of several
    styles, in one pass, each row says its own. Only content over the limit goes through the kernel.
    """
    _positive(limit, overlap)
    rows = sections.select("doc_id", "seq", "heading", "content", "level", fold(K.slide, "array<string>", limit, overlap, True)(F.when(F.length("content") > limit, F.col("content"))).alias("parts"))
    heading, level = F.col("heading"), F.col("level")
    row = lambda part, name, text, lv: F.struct(part.alias("part"), name.alias("heading"), text.alias("content"), lv.alias("level"))
    name = lambda p: F.concat(heading, F.format_string(" (Part %d)", p + 1))

    def cut(style: str) -> Column:
        if style == "sibling":
            return F.transform("parts", lambda x, p: row(p, F.when(p > 0, name(p)).otherwise(heading), x, level))
        named = lambda p: F.when(heading != "", name(p)).otherwise(F.format_string("Part %d", p + 1))
        return F.concat(F.array(row(F.lit(0), heading, F.lit(""), level)), F.transform("parts", lambda x, p: row(p + 1, named(p), x, level + 1)))

    whole = F.array(row(F.lit(0), heading, F.col("content"), level))
    tagged = lambda style: F.transform(F.when(F.col("parts").isNull(), whole).otherwise(cut(style)), lambda x: F.struct(x["part"].alias("part"), x["heading"].alias("heading"), x["content"].alias("content"), x["level"].alias("level"), F.lit(style).alias("style")))
    out = rows.select("doc_id", "seq", F.explode(F.concat(*map(tagged, styles))).alias("x")).select("doc_id", "seq", "x.*")
    return out if len(styles) > 1 else out.drop("style")


def legal_sections(docs: DataFrame) -> DataFrame:
    """(doc_id, seq, heading, type, level, content, start_pos, end_pos): from every structure mark to the next."""
    pattern = P.any_legal()
    pieces = docs.select("doc_id", X.mark_split(F.col("text"), pattern).alias("p"))
    ends = fold(lambda n: list(accumulate(n)), "array<int>")(F.transform("p", lambda x: F.length(x)))
    rows = pieces.select("doc_id", F.posexplode(F.arrays_zip(F.col("p").alias("piece"), ends.alias("end_pos"))).alias("seq", "x")).select("doc_id", "seq", "x.piece", "x.end_pos")
    placed = rows.where("seq > 0").withColumn("heading", F.regexp_extract("piece", f"^(?:{pattern})", 0))
    level = X._plain_level(F.col("heading"))
    return placed.select("doc_id", "seq", "heading", X.legal_type(F.col("heading")).alias("type"), level.alias("level"), X.strip(F.col("piece")).alias("content"), (F.col("end_pos") - F.length("piece")).alias("start_pos"), "end_pos")


def reflow(docs: DataFrame) -> DataFrame:
    """(doc_id, text): flattened legal text with its lines again."""
    return docs.select("doc_id", fold(K.reflow_lines, "string")(X.reflow(F.col("text"))).alias("text"))


def articles(docs: DataFrame, method: str = "simple") -> DataFrame:
    """Article chunks: ``simple`` at each article mark, ``advanced`` with close chapters, ``chapter`` with chapter marks alone."""
    if method == "simple":
        pieces = F.filter(F.transform(X.mark_split(F.col("text"), P.ARTICLE), X.strip), lambda x: x != "")
        return exploded(docs, pieces)
    kernel = {"advanced": K.articles_advanced, "chapter": K.articles_by_chapter}[method]
    return exploded(docs, fold(kernel, "array<string>")(F.col("text")))
