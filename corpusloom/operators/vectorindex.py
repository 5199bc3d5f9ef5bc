"""An exact index of vectors in blocks, of which a search reads those that can hold a hit.

A block holds the vectors nearest to its centre. No vector in it scores more than q.c + |q| r against a query q, where c is the centre and r
the distance of its farthest vector; a block whose bound is below the query's k-th score needn't be read. Centres are fitted on a sample
of bounded size; every vector is in a block, and radii are of all of them. The table is partitioned by block, so that blocks that
aren't needed are neither listed nor opened.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import retrieval
from .staging import bound_batches, staged

#: Vectors of a block, as far as the number of blocks allows; blocks; vectors that the centres are fitted on.
BLOCK_ROWS, MOST_BLOCKS, SAMPLE = 20_000, 4096, 20_000
#: Rows of one file.
FILE_ROWS = 200_000
ROUNDS = 5
#: Bounds that are computed at once.
BOUNDS = 1_000_000


def _nearest(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each vector, in steps of bounded size."""
    out, half = np.zeros(len(vectors), np.int64), (centres * centres).sum(1) / 2
    step = max(1, BOUNDS // len(centres))
    for s in range(0, len(vectors), step):
        out[s : s + step] = (vectors[s : s + step] @ centres.T - half).argmax(1)
    return out


def centres_of(sample: np.ndarray, n: int) -> np.ndarray:
    """n centres, or fewer, of a sample: some rounds of means from evenly taken vectors."""
    sample = np.unique(sample, axis=0)
    centres = sample[np.linspace(0, len(sample) - 1, min(n, len(sample))).astype(np.int64)] if len(sample) else np.zeros((0, 0))
    for _ in range(ROUNDS if len(centres) else 0):
        at = _nearest(sample, centres)
        sizes = np.bincount(at, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, at, sample)
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
    return centres


def write(vectors: DataFrame, path: str, block_rows: int = BLOCK_ROWS, overwrite: bool = False) -> None:
    """Writes vectors (docid, embedding) to path/rows, by block, and path/heads (block, centre, radius, n).

    Rows that search() never finds (no docid, no vector, elements that aren't finite) are left out; widths may differ, each has blocks of
    its own. A vector that stands in very many rows makes one large block, which is written and read as many files.
    """
    bound_batches(vectors.sparkSession)
    good = ~F.coalesce(F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(True))
    rows = staged(vectors.select("docid", "embedding").where("docid is not null and size(embedding) > 0").where(good), "vectors")
    widths = {r[0]: r[1] for r in rows.groupBy(F.size("embedding")).count().collect()}
    # A sample by hash, so that it depends on the rows alone.
    taken = rows.orderBy(F.xxhash64("docid"), "docid").limit(SAMPLE).select("embedding").toArrow()
    fitted: dict[int, np.ndarray] = {}
    for _, m in retrieval._matrix(taken["embedding"].combine_chunks() if taken.num_rows else pa.array([], pa.list_(pa.float64()))):
        fitted[m.shape[1]] = centres_of(m, max(1, min(MOST_BLOCKS // max(1, len(widths)), -(-widths[m.shape[1]] // block_rows))))
    first, at = {}, 0
    for width in sorted(widths):
        first[width] = at
        at += len(fitted.setdefault(width, np.zeros((1, width))))
    shipped = vectors.sparkSession.sparkContext.broadcast((fitted, first))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, start = shipped.value
        for b in batches:
            block, far = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows)
            for place, m in retrieval._matrix(b.column(1)):
                own = centres[m.shape[1]]
                near = _nearest(m, own)
                block[place], far[place] = near + start[m.shape[1]], np.linalg.norm(m - own[near], axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(block), pa.array(far)], names=["docid", "embedding", "block", "far"])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("docid", "embedding"))
    dealt = staged(rows.mapInArrow(run, f"{kinds}, block int, far double"), "dealt")
    heads = {r[0]: (r[1], r[2]) for r in dealt.groupBy("block").agg(F.max("far"), F.count("*")).collect()}  # MOST_BLOCKS rows or so
    table = [(block, fitted[w][block - first[w]].tolist(), *heads[block]) for w in sorted(widths) for block in range(first[w], first[w] + len(fitted[w])) if block in heads]
    lots = {block: -(-n // FILE_ROWS) for block, (_, n) in heads.items() if n > FILE_ROWS}
    lot = F.lit(0)
    if lots:
        lot = F.pmod(F.xxhash64("docid"), F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in lots.items() for x in pair)), F.col("block")), F.lit(1)))
    mode = "overwrite" if overwrite else "errorifexists"
    dealt.repartition(max(1, sum(-(-n // FILE_ROWS) for _, n in heads.values())), "block", lot).sortWithinPartitions("block").select("docid", "embedding", "block").write.mode(mode).partitionBy("block").parquet(f"{path}/rows")
    dealt.limit(0).select("docid", "embedding").write.mode(mode).parquet(f"{path}/schema")  # also of an index without a vector
    vectors.sparkSession.createDataFrame(table, "block int, centre array<double>, radius double, n long").coalesce(1).write.mode(mode).parquet(f"{path}/heads")


class Index:
    """An index that write() wrote. read: blocks that the last search's blocks of queries read, for tests and logs."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        schema = spark.read.parquet(f"{path}/schema").schema.add("block", "integer")
        self.rows = spark.read.schema(schema).parquet(f"{path}/rows")
        held = spark.read.parquet(f"{path}/heads").orderBy("block").collect()  # MOST_BLOCKS rows or so
        self.blocks = np.array([r.block for r in held], np.int64)
        self.sizes = np.array([r.n for r in held], np.int64)
        self.radii = np.array([r.radius for r in held])
        self.centres = [np.array(r.centre) for r in held]
        self.read: list[set[int]] = []

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """retrieval.search() of the whole index, with the same result. Reads each query's most promising blocks, and then those that can
        still hold one of its best k. Runs both when it is called."""
        self.read = []
        return retrieval._in_blocks(queries, k, lambda block: self._hits(block, k), len(self.rows.inputFiles()))

    def _some(self, blocks: set[int]) -> DataFrame:
        return self.rows.where(F.col("block").isin(sorted(blocks))).select("docid", "embedding")

    def _bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of blocks of this width, bound of each query and block), with room for rounding."""
        at = np.flatnonzero([len(c) == queries.shape[1] for c in self.centres])
        if not len(at):
            return at, np.zeros((len(queries), 0))
        centres = np.stack([self.centres[i] for i in at])
        bound = queries @ centres.T + np.linalg.norm(queries, axis=1)[:, None] * self.radii[at]
        return at, bound + retrieval.ROUNDING * (1 + np.abs(bound))

    def _hits(self, queries: DataFrame, k: int) -> DataFrame:
        held = queries.toArrow()  # a block of queries, its size is bounded
        groups = [] if not held.num_rows else [(at, m) for at, m in retrieval._matrix(held["embedding"].combine_chunks()) if len(at)]
        steps = [(places[s : s + step], m[s : s + step]) for places, m in groups for step in [max(1, BOUNDS // max(1, len(self.blocks)))] for s in range(0, len(m), step)]
        promising: set[int] = set()
        for _, m in steps:
            at, bound = self._bounds(m)
            order = np.argsort(-bound, axis=1)
            # As many blocks as hold k rows.
            enough = (np.cumsum(self.sizes[at][order], axis=1) < k).sum(1) + 1
            promising |= {int(b) for row, n in zip(order, enough.tolist(), strict=True) for b in self.blocks[at[row[:n]]]}
        first = staged(retrieval._hits(queries, self._some(promising), k), "first-hits")
        kth = first.withColumn("_place", F.row_number().over(retrieval.W.partitionBy("qid").orderBy(F.col("score").desc()))).where(F.col("_place") == k)
        least = {r.qid: r.score for r in kth.select("qid", "score").collect()}  # a number for each query of a block
        needed: set[int] = set()
        for places, m in steps:
            at, bound = self._bounds(m)
            floor = np.array([least.get(x, -np.inf) for x in held["qid"].take(pa.array(places)).to_pylist()])
            needed |= set(self.blocks[at[(bound >= floor[:, None]).any(0)]].tolist())
        self.read.append(promising | needed)
        return first.unionByName(retrieval._hits(queries, self._some(needed - promising), k))
