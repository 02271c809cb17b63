"""Removal of near-duplicate chunks within a document: greedy, in order, by Jaccard of character sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions import text as X
from .splitting import fold


def distinct_chunks(chunks: DataFrame, head: int = 200, threshold: float = 0.7) -> DataFrame:
    """(doc_id, chunk_id, content) of the chunks that stay; ``head`` is how much of a chunk its fingerprint sees."""
    prints = X.fingerprint(X.strip(F.substring("content", 1, head)))
    doc = chunks.withColumn("f", prints).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_id", "content", "f"))).alias("c"))
    kept = doc.withColumn("k", fold(K.greedy_distinct, "array<boolean>", threshold)(F.col("c.f")))
    rows = kept.select("doc_id", F.explode(F.arrays_zip("c", "k")).alias("z")).where("z.k")
    return rows.select("doc_id", "z.c.chunk_id", "z.c.content")
