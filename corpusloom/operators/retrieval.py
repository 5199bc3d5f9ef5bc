"""Runs: tables (qid, docid, rank, score) from search, lifting to documents, reranking and sharding."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .staging import bound_batches, running, staged

#: Queries that are sent to all tasks at once, at most; more are searched block by block. A block's vectors and the hits that a
#: task holds for it are bounded too, in numbers.
QUERY_BLOCK, BLOCK_VALUES, BLOCK_HITS = 10_000, 4_000_000, 2_000_000
#: Products that a task computes at once: queries of a block times rows.
PRODUCTS = 1_000_000
#: Share of two vectors' lengths by which a product of matrices may differ from the sum in order of dimensions.
ROUNDING = 1e-9
#: Files of an index whose tasks' hits meet in one step; those of more meet in lots first.
MERGED = 512


def ranked(hits: DataFrame, k: int | None = None, ties: str = "docid") -> DataFrame:
    """(qid, docid, rank, score) by score, then by the tie column; the first k of each query."""
    place = F.row_number().over(W.partitionBy("qid").orderBy(F.col("score").desc(), ties))
    rows = hits.withColumn("rank", place)
    return (rows if k is None else rows.where(F.col("rank") <= k)).select("qid", "docid", "rank", "score")


def search(queries: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """queries (qid, embedding) against all of index (docid, embedding) by inner product: the best k of each.

    Exact: a matrix product finds the pairs that can be among the best, and their products are summed in double precision in the order
    of dimensions. Equal scores go by docid. Queries are staged and go to the tasks that hold the index, in blocks of a counted size; a
    task keeps k of each before the shuffle. Vectors meet those of their own width. Vectors that are null or empty, or hold a null, a
    NaN or an infinite element, neither find nor are found, and rows without a docid are not found. Runs a job for the queries when
    it is called; the index is read when the result is.
    """
    return _in_blocks(queries, k, lambda block: _hits(block, index, k), len(index.inputFiles()))


#: The same: blocks are how search() works.
search_blocks = search


def _in_blocks(queries: DataFrame, k: int, hits: Callable[[DataFrame], DataFrame], files: int) -> DataFrame:
    """hits() of the queries, block by block, ranked. An index of many files makes many tasks with k hits a query each."""
    if k < 1:
        raise ValueError("k must be positive")
    bound_batches(queries.sparkSession)
    asked = staged(queries.select("qid", "embedding", F.monotonically_increasing_id().alias("_row")).where("size(embedding) > 0"), "asked")
    n, width = asked.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(1))).first()
    blocks = max(1, -(-n // max(1, min(QUERY_BLOCK, BLOCK_VALUES // width, BLOCK_HITS // k))))
    out = None
    for b in range(blocks):
        found = hits(asked.where(F.pmod(F.xxhash64("_row"), F.lit(blocks)) == b).select("qid", "embedding"))
        out = found if out is None else out.unionByName(found)
    if files > MERGED:
        lot = W.partitionBy("qid", F.pmod("_task", F.lit(int(files**0.5)))).orderBy(F.col("score").desc(), "docid")
        out = out.withColumn("_place", F.row_number().over(lot)).where(F.col("_place") <= k)
    return ranked(out.select("qid", "docid", "score"), k)


def _matrix(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, vectors) of the vectors of each width whose elements are all finite."""
    sizes = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(column), 0))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # a null element is a NaN; null lists have none
    starts = np.cumsum(sizes) - sizes
    for width in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == width)
        vectors = flat[starts[at][:, None] + np.arange(width)] if len(at) < len(sizes) else flat.reshape(len(sizes), width)
        good = np.isfinite(vectors).all(axis=1)
        yield (at, vectors) if good.all() else (at[good], vectors[good])


class _Best:
    """The best k of some queries among the vectors that add() is given: columns of hits, not a list per query.

    Hits wait until they are as many as those that are held; then the best are taken, and what is less is no longer looked at. So they
    are sorted a number of times that grows with the logarithm of the vectors' number.
    """

    def __init__(self, queries: np.ndarray, k: int) -> None:
        self.q, self.k = queries, k
        self.lengths = np.linalg.norm(queries, axis=1)
        self.least = np.full(len(queries), -np.inf)
        self.rows, self.scores, self.ids = np.zeros(0, np.int32), np.zeros(0), None
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, vectors: np.ndarray, ids: np.ndarray) -> None:
        step = max(1, PRODUCTS // len(self.q))
        for s in range(0, len(vectors), step):
            v = vectors[s : s + step]
            rough = self.q @ v.T
            slack = ROUNDING * (1 + self.lengths * np.linalg.norm(v, axis=1).max())
            floor = self.least - slack
            if len(v) > self.k:
                floor = np.maximum(floor, np.partition(rough, len(v) - self.k, axis=1)[:, len(v) - self.k] - slack)
            row, at = np.nonzero(rough >= floor[:, None])
            exact = np.zeros(len(row))
            for d in range(v.shape[1]):
                exact += self.q[row, d] * v[at, d]
            self.waiting.append((row.astype(np.int32), exact, ids[s + at]))
            if sum(len(x) for x, _, _ in self.waiting) >= max(PRODUCTS, len(self.rows)) or np.isneginf(self.least).any():
                self.take()

    def take(self) -> None:
        """The best of those held and those that wait."""
        held = [] if self.ids is None else [(self.rows, self.scores, self.ids)]
        rows, scores, ids = (np.concatenate(x) for x in zip(*held, *self.waiting, strict=True)) if held or self.waiting else (self.rows, self.scores, np.zeros(0))
        self.waiting = []
        order = np.lexsort((ids, -scores, rows))
        sizes = np.bincount(rows, minlength=len(self.q))
        first = np.cumsum(sizes) - sizes
        order = order[np.arange(len(order)) - first[rows[order]] < self.k]
        self.rows, self.scores, self.ids = rows[order], scores[order], ids[order]
        full = np.flatnonzero(sizes >= self.k)
        ends = np.cumsum(np.minimum(sizes, self.k)) - 1
        self.least[full] = self.scores[ends[full]]


def _hits(queries: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """(qid, docid, score, _task): the best k of each query in each task of the index."""
    held = queries.toArrow()  # a block of queries, its size is bounded
    column = held["embedding"].combine_chunks() if held.num_rows else pa.array([], pa.list_(pa.float64()))
    by_width = {m.shape[1]: (at, m) for at, m in _matrix(column) if len(at)}
    qids = held["qid"].combine_chunks()
    shipped = queries.sparkSession.sparkContext.broadcast((qids, by_width))
    q, d = queries.schema["qid"].dataType, index.schema["docid"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, asked = shipped.value
        best = {width: _Best(m, k) for width, (_, m) in asked.items()}
        kind = None
        for b in batches:
            kind = b.schema.field(0).type
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for at, vectors in _matrix(b.column(1)):
                if len(at) and vectors.shape[1] in best:
                    best[vectors.shape[1]].add(vectors, ids[at])
        for width, found in best.items():
            found.take()
            for s in range(0, len(found.rows), PRODUCTS):
                rows = asked[width][0][found.rows[s : s + PRODUCTS]]
                yield pa.RecordBatch.from_arrays([names.take(pa.array(rows)), pa.array(found.ids[s : s + PRODUCTS], kind), pa.array(found.scores[s : s + PRODUCTS])], names=["qid", "docid", "score"])

    hits = index.where("docid is not null and size(embedding) > 0").select("docid", "embedding").mapInArrow(run, f"qid {q.simpleString()}, docid {d.simpleString()}, score double")
    return hits.withColumn("_task", F.spark_partition_id())


def cut(run: DataFrame, k: int) -> DataFrame:
    """The first k ranks."""
    return run.where(F.col("rank") <= k)


def lift(run: DataFrame, chunk_to_doc: DataFrame) -> DataFrame:
    """A chunk run as a document run: each document by its best chunk. chunk_to_doc: (chunk_id, doc_id). Ranks are dense."""
    found = run.join(chunk_to_doc, run["docid"] == chunk_to_doc["chunk_id"])
    best = found.groupBy("qid", "doc_id").agg(F.max("score").alias("score"), F.min("rank").alias("_first"))
    return ranked(best.select("qid", F.col("doc_id").alias("docid"), "score", "_first"), ties="_first")


def unmatched(run: DataFrame, chunk_to_doc: DataFrame) -> DataFrame:
    """Hits whose chunk is unknown; a strict run has none."""
    return run.join(chunk_to_doc, run["docid"] == chunk_to_doc["chunk_id"], "left_anti")


def pairs(run: DataFrame, queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """(qid, docid, rank, score, query, passage) for queries (qid, query) and corpus (docid, content)."""
    return run.join(queries, "qid").join(corpus.withColumnRenamed("content", "passage"), "docid").select("qid", "docid", "rank", "score", "query", "passage")


def scored(candidates: DataFrame, scorer: Callable[[], Callable[[list[str], list[str]], np.ndarray]], normalise: bool = False) -> DataFrame:
    """Replaces score by the scorer's for (query, passage); normalise maps it to 0 to 1. The model is made once per task."""
    names = candidates.columns
    bound_batches(candidates.sparkSession)
    q, p, s = (names.index(c) for c in ("query", "passage", "score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = scorer()
        for b in batches:
            got = np.asarray(model(b.column(q).to_pylist(), b.column(p).to_pylist()), np.float64)
            columns = list(b.columns)
            columns[s] = pa.array(1 / (1 + np.exp(-got)) if normalise else got)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return candidates.mapInArrow(run, candidates.schema)


def shared_words(queries: list[str], passages: list[str]) -> list[float]:
    """The default scorer: the share of the query's words that the passage has."""
    out = []
    for q, p in zip(queries, passages, strict=True):
        words = set((q or "").lower().split())
        out.append(len(words & set((p or "").lower().split())) / len(words) if words else 0.0)
    return out


def reranked(candidates: DataFrame) -> DataFrame:
    """New ranks by score; equal scores keep the order they had."""
    rows = candidates.withColumnRenamed("rank", "prior")
    return ranked(rows, ties="prior")


def sharded(queries: DataFrame, n: int) -> DataFrame:
    """Adds shard: sorted qids in n runs of equal length, the last of which takes what is over. No task holds all queries."""
    rows = staged(queries.withColumns({"_one": F.lit(1), "_row": F.monotonically_increasing_id()}), "queries")
    total = rows.count()
    place = running(rows, [], ["qid", "_row"], "_one", "_place", total)
    shard = F.lit(n - 1) if total < n else F.least(F.floor((F.col("_place") - 1) / (total // n)), F.lit(n - 1)).cast("int")
    return place.withColumn("shard", shard.cast("int")).select(*queries.columns, "shard")


def prefixed(queries: DataFrame, instruction: str | None) -> DataFrame:
    """Queries with an instruction before them, if there is one."""
    return queries.withColumn("query", F.concat(F.lit(instruction), "query")) if instruction else queries


def score_column(c: Column, digits: int = 6) -> Column:
    """A score as text, for sinks only."""
    return F.format_string(f"%.{digits}f", c)
