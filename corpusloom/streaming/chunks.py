"""Chunkers over streams. They keep no state, so the expressions that serve tables serve streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.functions import text as T
from corpusloom.operators import chunking


def chunk_stream(docs: DataFrame, size: int = 512, overlap: int = 50) -> DataFrame:
    """(chunk_id, doc_id, pos, content) for a stream of documents (doc_id, text)."""
    made = chunking.explode_chunks(docs, T.windows(F.col("text"), size, overlap))
    return chunking.with_ids(made).select("chunk_id", "doc_id", "pos", "content")


def write_stream(chunks: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends chunks to a Parquet table until what is there has been read."""
    return chunks.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
