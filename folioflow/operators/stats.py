"""Statistics of chunks and batches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions import patterns as P
from ..functions import text as X
from .splitting import fold

BUCKETS = ((50, "0-50"), (100, "51-100"), (200, "101-200"), (300, "201-300"), (500, "301-500"))


def chunk_stats(chunks: DataFrame, limit: int, *by: str) -> DataFrame:
    n = F.length("content")
    return chunks.groupBy(*by).agg(F.count("*").alias("chunks"), F.round(F.avg(n), 2).alias("avg_len"), F.max(n).alias("max_len"), F.min(n).alias("min_len"), F.count_if(n <= limit).alias("within_limit"))


def length_bucket(n: Column) -> Column:
    return reduce(lambda a, b: a.when(n <= b[0], b[1]), BUCKETS[1:], F.when(n <= BUCKETS[0][0], BUCKETS[0][1])).otherwise("500+")


def length_histogram(chunks: DataFrame) -> DataFrame:
    counts = chunks.groupBy(length_bucket(F.length("content")).alias("bucket")).agg(F.count("*").alias("n"))
    return counts.withColumn("percent", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy()), 2))  # six rows


def structure_kind(c: Column) -> Column:
    n = F.when(X.legal_heading(c), X.legal_level(c))
    return F.when(n.isin(1, 3), "chapter").when(n == 5, "article").when(n >= 10, "item").otherwise("content")


def structure_histogram(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy(structure_kind(F.col("content")).alias("kind")).agg(F.count("*").alias("n"))


def completion_rate(chunks: DataFrame, *by: str) -> DataFrame:
    done = X.sentence_complete(F.col("content"))
    return chunks.groupBy(*by).agg(F.count("*").alias("chunks"), F.count_if(done).alias("complete"), F.round(100 * F.avg(done.cast("int")), 2).alias("percent"))


def article_coverage(chunks: DataFrame) -> DataFrame:
    hit = F.col("content").rlike(P.ARTICLE)
    return chunks.agg(F.count("*").alias("chunks"), F.count_if(hit).alias("with_article"), F.round(F.avg(hit.cast("int")), 4).alias("share"))


def structure_counts(chunks: DataFrame) -> DataFrame:
    """Chunks that name chapters, articles or clauses, and that end with a full sentence; and the share of these."""
    c = F.col("content")
    mark, done = c.contains("第"), c.rlike(r"(?U)[。！？；]\s*$")
    return chunks.agg(
        F.count("*").alias("chunks"), F.count_if(mark & c.contains("章")).alias("chapters"), F.count_if(mark & c.contains("条")).alias("articles"),
        F.count_if(mark & X.contains_any(c, ("款", "项"))).alias("clauses"), F.count_if(done).alias("complete"), F.round(100 * F.avg(done.cast("int")), 1).alias("percent"),
    )


def batch_counters(files: DataFrame) -> DataFrame:
    """(dir, files, success, failed, chunks) for each directory and, with a null dir, in total."""
    return files.rollup("dir").agg(F.count("*").alias("files"), F.count_if(F.col("error").isNull()).alias("success"), F.count_if(F.col("error").isNotNull()).alias("failed"), F.sum("chunks").alias("chunks"))


def overlaps(chunks: DataFrame, least: int = 10) -> DataFrame:
    """Chunks that share a run of ``least`` characters with the chunk before."""
    before = F.lag("content").over(Window.partitionBy("doc_id").orderBy("chunk_id"))
    shared = fold(K.share_run, "boolean", least)(F.col("before"), F.col("content"))
    return chunks.withColumn("before", before).where(F.coalesce(shared, F.lit(False))).drop("before")


def tag_counts(chunks: DataFrame) -> DataFrame:
    return chunks.select(F.explode(X.party_tags(F.col("content"))).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def previews(chunks: DataFrame, k: int = 3) -> DataFrame:
    return chunks.where(F.col("chunk_id") <= k).select("doc_id", "chunk_id", F.substring("content", 1, 100).alias("preview"))
