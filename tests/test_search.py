"""Exact search: odd vectors, bounded memory, and the index in blocks against the whole scan."""

import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import retrieval, vectorindex

VECTORS = "docid long, embedding array<float>"


def score(a, b):
    total = 0.0
    for x, y in zip(a, b, strict=True):
        total += float(np.float32(x)) * float(np.float32(y))
    return total


def plain(queries, index, k):
    """All pairs of one width, of vectors whose elements are finite."""
    good = lambda v: bool(v) and all(x is not None and np.isfinite(x) for x in v)
    out = set()
    for q, v in queries:
        if good(v):
            found = sorted((-score(v, w), d) for d, w in index if d is not None and good(w) and len(w) == len(v))
            out |= {(q, d, n + 1, -s) for n, (s, d) in enumerate(found[:k])}
    return out


def tuples(df):
    return {(r.qid, r.docid, r["rank"], r.score) for r in df.collect()}


def odd_rows():
    rng = np.random.default_rng(7)
    rows = [(k, rng.normal(size=4).astype(np.float32).tolist()) for k in range(50)]
    rows += [(50, [float("nan"), 1.0, 1.0, 1.0]), (51, [None, 1.0, 1.0, 1.0]), (52, []), (53, None), (54, [float("inf")] * 4), (None, [9.0] * 4), (55, [1.0, 2.0]), (56, [3.0, 0.0]), (57, [0.0] * 4)]
    queries = [(0, rows[0][1]), (1, [1.0, 1.0]), (2, [float("nan")] * 4), (3, [None, 1.0]), (4, []), (5, None), (6, [1.0, 2.0, 3.0]), (7, [0.0] * 4)]
    return rows, queries


def test_vectors_that_are_none(spark):
    rows, queries = odd_rows()
    index, asked = spark.createDataFrame(rows, VECTORS), spark.createDataFrame(queries, "qid long, embedding array<float>")
    want = plain(queries, rows, 5)
    assert len({q for q, *_ in want}) == 3 and len(want) == 12
    for parts in (1, 3):
        assert tuples(retrieval.search(asked, index.repartition(parts), 5)) == want


def test_lots_of_tasks(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(retrieval, "MERGED", 3)
    monkeypatch.setattr(retrieval, "PRODUCTS", 7)
    rows, queries = odd_rows()
    spark.createDataFrame(rows, VECTORS).repartition(9).write.parquet(f"{tmp_path}/i")
    assert tuples(retrieval.search(spark.createDataFrame(queries, "qid long, embedding array<float>"), spark.read.parquet(f"{tmp_path}/i"), 5)) == plain(queries, rows, 5)


def test_queries_are_encoded_once(spark):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("array<float>")
    def encode(k):
        calls.add(1)
        return [float(k % 7), 1.0]

    asked = spark.range(60).select(F.col("id").alias("qid"), encode("id").alias("embedding"))
    index = spark.createDataFrame([(k, [float(k), 0.5]) for k in range(9)], VECTORS)
    retrieval.QUERY_BLOCK, was = 20, retrieval.QUERY_BLOCK
    try:
        assert retrieval.search(asked, index, 2).count() == 120
    finally:
        retrieval.QUERY_BLOCK = was
    assert calls.value == 60


def test_memory_of_many_queries():
    """10,000 queries and 10,000 rows of one batch."""
    code = """
import resource, numpy as np
from corpusloom.operators.retrieval import _Best
rng = np.random.default_rng(1)
q, v = rng.normal(size=(10_000, 16)), rng.normal(size=(10_000, 16))
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
best = _Best(q, 100)
best.add(v, np.arange(10_000))
best.take()
assert len(best.rows) == 1_000_000
assert (best.ids[:100] == np.argsort(-(q[0] @ v.T), kind="stable")[:100]).all()
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parent.parent, capture_output=True, text=True, check=True)
    assert int(out.stdout) < 300


def clustered(n, seed=1, width=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, width)) * 8
    return [(k, (centres[k % 12] + rng.normal(size=width) * 0.3).astype(np.float32).tolist()) for k in range(n)]


def test_index_in_blocks(spark, tmp_path):
    rows = clustered(3000)
    vectorindex.write(spark.createDataFrame(rows, VECTORS).repartition(4), f"{tmp_path}/i", block_rows=100)
    index = vectorindex.Index(spark, f"{tmp_path}/i")
    assert index.sizes.sum() == 3000 and 20 <= len(index.blocks) <= 30
    asked = spark.createDataFrame([(k, rows[k][1]) for k in (0, 12, 24)], "qid long, embedding array<float>")
    want = tuples(retrieval.search(asked, spark.createDataFrame(rows, VECTORS), 10))
    assert tuples(index.search(asked, 10)) == want == plain([(k, rows[k][1]) for k in (0, 12, 24)], rows, 10)
    (read,) = index.read
    assert 1 <= len(read) < len(index.blocks) / 2, "queries near one centre need few of the blocks"


@pytest.mark.parametrize("k", [1, 7, 40, 5000])
def test_index_of_spread_vectors(spark, tmp_path, k):
    rng = np.random.default_rng(k)
    rows = [(n, rng.normal(size=5).astype(np.float32).tolist()) for n in range(400)] + [(n, [1.0] * 5) for n in range(400, 460)]
    asked = [(n, rows[n][1]) for n in range(0, 400, 50)]
    vectorindex.write(spark.createDataFrame(rows, VECTORS), f"{tmp_path}/i", block_rows=20)
    got = tuples(vectorindex.Index(spark, f"{tmp_path}/i").search(spark.createDataFrame(asked, "qid long, embedding array<float>"), k))
    assert got == plain(asked, rows, k)


def test_index_of_odd_vectors(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vectorindex, "FILE_ROWS", 10)
    rows, queries = odd_rows()
    rows += [(100 + k, [2.0, 2.0, 2.0, 2.0]) for k in range(50)]  # one vector, many files
    vectorindex.write(spark.createDataFrame(rows, VECTORS), f"{tmp_path}/i", block_rows=5)
    index = vectorindex.Index(spark, f"{tmp_path}/i")
    asked = spark.createDataFrame(queries, "qid long, embedding array<float>")
    assert tuples(index.search(asked, 4)) == plain(queries, rows, 4)
    assert len(index.rows.inputFiles()) > len(index.blocks)
    assert index.search(asked.limit(0), 4).count() == 0
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        vectorindex.write(spark.createDataFrame(rows, VECTORS), f"{tmp_path}/i")
    vectorindex.write(spark.createDataFrame([], VECTORS), f"{tmp_path}/none")
    assert vectorindex.Index(spark, f"{tmp_path}/none").search(asked, 4).count() == 0
