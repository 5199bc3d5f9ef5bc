"""Chunk tables: a row per chunk with chunk_id, doc_id, pos and content."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions import text as T

from .staging import bound_batches, running, staged


def explode_chunks(docs: DataFrame, chunks: Column, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A row per chunk: the columns to keep, pos and content."""
    return docs.select(*keep, F.explode(chunks).alias("_c")).select(*keep, F.col("_c.pos").alias("pos"), F.col("_c.content").alias("content"))


def with_ids(chunks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """chunk_id from the document's id and the position: needs no order of the documents. A null id counts as an empty one."""
    return chunks.withColumn("chunk_id", F.concat(F.coalesce(F.col(doc).cast("string"), F.lit("")), F.lit("-"), F.col("pos").cast("string")))


def mark_chunks(docs: DataFrame, size: int, keep_title: bool = False, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keep, pos, content): chunks that open with a mark or a space, cut one after the other in Arrow batches.

    A cut is sought backwards from its window's end, so of most texts few characters are looked at; an expression over all marks, spaces
    among them, would look at each."""
    if size < 2:
        raise ValueError("the window is too small")
    n = len(keep)
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, pos, content = [], [], []
            for k, text in enumerate(b.column(n).to_pylist()):
                for i, c in enumerate(T.cut_at_marks(text or "", size, T.title_of(text or "", size) if keep_title else "")):
                    rows.append(k)
                    pos.append(i)
                    content.append(c)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(at) for k in range(n)), pa.array(pos, pa.int32()), pa.array(content, pa.string())], names=[*keep, "pos", "content"])

    kept = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    return docs.select(*keep, "text").mapInArrow(run, f"{kept}pos int, content string")


def firsts(counts: DataFrame, doc: str = "doc_id") -> DataFrame:
    """counts (doc, n), a row per document with ids of any type that has an order. Adds first: the chunks of all documents before it."""
    rows = staged(counts, "chunk-counts")
    return running(rows, [], [doc], "n", "_ends", rows.count()).withColumn("first", F.col("_ends") - F.col("n")).drop("_ends")


def chunk_name(lang: Column, number: Column) -> Column:
    return F.concat(F.lit("doc-"), lang, F.lit("-"), number.cast("string"))


def numbered(chunks: DataFrame, lang: Column, doc: str = "doc_id") -> DataFrame:
    """Adds chunk_id `doc-{lang}-{n}`, n counting all chunks by document and position.

    Only a row per document is numbered, by ranges of documents, so no task holds all of them.
    """
    first = firsts(chunks.groupBy(doc).agg(F.count("*").alias("n")), doc).select(doc, F.col("first").alias("_first"))
    number = F.col("_first") + F.row_number().over(W.partitionBy(doc).orderBy("pos")) - 1
    return chunks.join(first, doc).withColumn("chunk_id", chunk_name(lang, number)).drop("_first")


def numbered_docs(docs: DataFrame, chunks: Column, lang: Column, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """explode_chunks() of documents with distinct doc_ids, and numbered()'s chunk_id: documents meet their first number, not chunks."""
    first = firsts(docs.select("doc_id", F.size(chunks).cast("long").alias("n")).where("n > 0")).select("doc_id", "first")
    each = docs.join(first, "doc_id").select(*keep, lang.alias("_lang"), "first", F.explode(chunks).alias("_c"))
    return each.select(*keep, F.col("_c.pos").alias("pos"), F.col("_c.content").alias("content"), chunk_name(F.col("_lang"), F.col("first") + F.col("_c.pos")).alias("chunk_id"))


def numbered_positions(docs: DataFrame, n: Column, lang: Column, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """numbered_docs() without contents: n says how many chunks a document has, and no text leaves its scan."""
    rows = docs.select(*keep, *({"doc_id"} - set(keep)), lang.alias("_lang"), n.cast("long").alias("_n")).where("_n > 0")
    first = firsts(rows.select("doc_id", F.col("_n").alias("n"))).select("doc_id", "first")
    each = rows.join(first, "doc_id").select(*keep, "_lang", "first", F.explode(F.sequence(F.lit(0), (F.col("_n") - 1).cast("int"))).alias("pos"))
    return each.select(*keep, "pos", chunk_name(F.col("_lang"), F.col("first") + F.col("pos")).alias("chunk_id"))


def spans(chunks: DataFrame) -> DataFrame:
    """(doc_id, first, n): where each document's chunks begin and how many there are."""
    return chunks.groupBy("doc_id").agg(F.min("pos").alias("first"), F.count("*").alias("n"))
