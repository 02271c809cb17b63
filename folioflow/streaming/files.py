"""The same splitting over a stream. All plans keep a document in one row, so they run in append mode without state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import splitting as C


def read_documents(spark: SparkSession, path: str, schema, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def chunk_stream(docs: DataFrame, limit: int = 500, overlap: int = 50) -> DataFrame:
    return C.pack_sentences(docs.select("doc_id", "text"), limit, overlap).withColumn("length", F.length("content"))


def write_stream(chunks: DataFrame, path: str, checkpoint: str):
    """Starts a query that takes what is there, then stops."""
    return chunks.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
