"""Whole experiments: chunk, embed, search, lift, rerank, relabel, evaluate. Language is a column, not a loop.

Plans are lazy but for the search, which writes and counts its queries when it is called.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import chunking, evaluation, labels, retrieval, semantic

from . import config


def chunk(docs: DataFrame, method: str, max_length: int = 512, overlap: int = 0, encoder: Callable[[], semantic.Encoder] = lambda: semantic.hashed_ngrams) -> DataFrame:
    """(chunk_id, doc_id, pos, content) of documents (doc_id, text) by any of config.SEGMENTS.

    Documents shorter than max_length stay whole, whatever the method; the two kinds go separate ways, so that short ones
    never reach an encoder.
    """
    config.chosen(method, config.SEGMENTS, "segment method")
    text = F.col("text")
    whole = F.array(F.struct(F.lit(0).alias("pos"), text.alias("content")))
    if method == "no_segment":
        made = chunking.explode_chunks(docs, whole)
    elif method == "easy_chunk":
        made = chunking.explode_chunks(docs, T.gated(text, T.windows(text, max_length, overlap), max_length))
    elif method == "chunk":
        made = chunking.explode_chunks(docs, T.gated(text, T.greedy(text, max_length), max_length))
    else:
        short = chunking.explode_chunks(docs.where(F.length(text) < max_length), whole)
        long = semantic.semantic_chunks(docs.where(F.length(text) >= max_length), "threshold" if method == "bert" else "slide_window", window=max_length, max_length=max_length, encoder=encoder)
        made = short.unionByName(long.select("doc_id", F.col("pos").cast("int").alias("pos"), "content"))
    return chunking.with_ids(made).select("chunk_id", "doc_id", "pos", "content")


def air_chunk(docs: DataFrame, method: str, max_length: int = 512, overlap: int = 0, keep_title: bool = True, at_marks: bool = True) -> DataFrame:
    """The same for config.AIR_SEGMENTS: windows, or windows with titles, cut at marks or at fixed places."""
    config.chosen(method, config.AIR_SEGMENTS, "segment method")
    text = F.col("text")
    whole = F.array(F.struct(F.lit(0).alias("pos"), text.alias("content")))
    short = chunking.explode_chunks(docs.where(F.length(text) < max_length), whole)
    long = docs.where(F.length(text) >= max_length)
    if method == "easy_chunk":
        made = chunking.explode_chunks(long, T.windows(text, max_length, overlap))
    elif at_marks:
        made = chunking.mark_chunks(long, max_length, keep_title)
    else:
        made = chunking.explode_chunks(long, T.titled_windows(text, max_length, overlap, keep_title))
    return chunking.with_ids(short.unionByName(made)).select("chunk_id", "doc_id", "pos", "content")


def embed_and_search(chunks: DataFrame, queries: DataFrame, hits: int = 1000, encoder: Callable[[], semantic.Encoder] = lambda: semantic.hashed_ngrams) -> tuple[DataFrame, DataFrame]:
    """(chunk run, document run) for queries (qid, query)."""
    index = semantic.encoded(chunks.select("chunk_id", "content"), "content", encoder=encoder).select(F.col("chunk_id").alias("docid"), "embedding")
    asked = semantic.encoded(queries.select("qid", "query"), "query", encoder=encoder).select("qid", "embedding")
    run = retrieval.search(asked, index, hits)
    return run, retrieval.lift(run, chunks.select("chunk_id", F.col("doc_id").cast("string").alias("doc_id")))


def rerank(run: DataFrame, queries: DataFrame, chunks: DataFrame, top_k: int = 100, scorer: Callable = lambda: retrieval.shared_words, normalise: bool = False) -> tuple[DataFrame, DataFrame]:
    """(chunk run, document run) of the first top_k hits, scored anew."""
    found = retrieval.pairs(retrieval.cut(run, top_k), queries, chunks.select(F.col("chunk_id").alias("docid"), "content"))
    again = retrieval.reranked(retrieval.scored(found, scorer, normalise))
    return again, retrieval.lift(again, chunks.select("chunk_id", F.col("doc_id").cast("string").alias("doc_id")))


def relabel(positives: DataFrame, hard_negatives: DataFrame, runs: list[DataFrame], judge: Callable[[DataFrame], DataFrame], triplets: DataFrame, corpus: DataFrame, old: DataFrame | None = None) -> dict[str, DataFrame]:
    """The pairs judged (all, or those that failed before), their counts and the new benchmark."""
    asked = labels.all_pairs(positives, labels.rerank_filter(runs, positives, hard_negatives))
    todo, done = labels.to_label(asked, old)
    judged = judge(todo).select("qid", "docid", "type", "llm_label", "llm_raw_label")
    pairs = judged if old is None else done.unionByName(judged)
    made = labels.new_triplets(triplets, pairs, corpus)
    return {"pairs": pairs, "counts": labels.label_counts(pairs), "corpus": labels.new_corpus(corpus, pairs), "triplets": made, "qrels": labels.new_qrels(made)}


def evaluate_languages(runs: DataFrame, qrels: DataFrame, metrics: list[str]) -> DataFrame:
    """(lang, metric, score) with averages, for runs and qrels with a column lang. Query ids are unique over languages."""
    lang = qrels.select("qid", "lang").distinct()
    each = evaluation.all_per_query(runs, qrels, metrics).join(lang, "qid").groupBy("lang", "metric").agg(F.avg("score").alias("score"))
    return evaluation.macro(each)
