"""Golden cases for segmentation by similarity."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import vector as V
from corpusloom.operators import semantic

PARTS, SIMS = ["s0", "s1", "s2", "s3"], [0.2, 0.9, 0.4]


def cut(spark, limit, compat=False):
    rows = spark.createDataFrame([(1, k, p, s) for k, (p, s) in enumerate(zip(PARTS, [*SIMS, None], strict=True))], "d int, pos int, part string, sim double")
    got = semantic.segments(semantic.cut_below(rows, "d", "pos", F.lit(limit), compat), "d", "pos", "part").orderBy("segment").collect()
    return [r.content for r in got]


def test_threshold(spark):
    assert cut(spark, 0.5) == ["s0", "s1s2", "s3"]
    assert cut(spark, 0.5, compat=True) == ["s0s1", "s2s3"]
    assert cut(spark, 0.4) == ["s0", "s1s2s3"]
    assert cut(spark, 0.1) == ["s0s1s2s3"]


def test_kth_smallest(spark):
    df = spark.createDataFrame([(SIMS,), ([],)], "sims array<double>")
    got = df.select(*(V.kth_smallest(F.col("sims"), F.lit(k)).alias(f"k{k}") for k in (0, 1, 2, 9))).collect()
    assert tuple(got[0]) == (0.2, 0.2, 0.4, 0.9) and tuple(got[1]) == (None,) * 4


@pytest.mark.parametrize("window, limit, want", [(100, 0.5, ["s0", "s1s2", "s3"]), (100, 0.9, ["s0", "s1", "s2", "s3"]), (4, 0.0, ["s0s1", "s2s3"]), (1, 0.0, PARTS)])
def test_greedy_segments(spark, window, limit, want):
    df = spark.createDataFrame([(PARTS, SIMS)], "parts array<string>, sims array<double>")
    row = df.select(semantic.greedy_segments(F.col("parts"), F.col("sims"), window, F.lit(limit)).alias("c")).first()
    assert [x.content for x in row.c] == want


def test_merge_neighbours():
    place = {"a": 0.0, "b": 0.1, "c": 1.5, "d": 1.4}

    def encoder(texts):
        angle = np.array([np.mean([place[c] for c in t]) for t in texts])
        return np.stack([np.cos(angle), np.sin(angle)], 1)

    assert semantic.merge_neighbours(["a", "b", "c", "d"], encoder, 10) == ["ab", "cd"]
    assert semantic.merge_neighbours(["a", "b", "c", "d"], encoder, 2) == ["a", "b", "c", "d"]
    assert semantic.merge_neighbours(["a"], encoder, 10) == ["a"]
    assert semantic.merge_neighbours([], encoder, 10) == []


def test_vectors(spark):
    df = spark.createDataFrame([([[3.0, 4.0], [3.0, 4.0], [0.0, 0.0]],)], "v array<array<float>>")
    row = df.select(V.adjacent(F.col("v")).alias("d"), V.adjacent(F.col("v"), V.cosine).alias("c"), V.mean(V.adjacent(F.col("v"))).alias("m")).first()
    assert row.d == [25.0, 0.0] and row.c == [pytest.approx(1.0), None] and row.m == 12.5


@pytest.mark.parametrize("kind", ["threshold", "slide_window", "k"])
def test_semantic_chunks_lose_nothing(spark, kind):
    texts = ["One. Two two. Three three three! Four? Five five.", "No sentence here", "Only one.", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in semantic.semantic_chunks(docs, kind, window=20, k=2 if kind == "k" else None).orderBy("doc_id", "pos").collect():
        got[r.doc_id] = got.get(r.doc_id, "") + r.content
    assert got == {k: t for k, t in enumerate(texts) if t}


def test_encoder_is_deterministic(spark):
    df = spark.createDataFrame([("abc",), ("abc",), (None,)], "t string")
    a, b, c = [r.embedding for r in semantic.encoded(df, "t").collect()]
    assert a == b and len(a) == len(c) == 64 and abs(sum(x * x for x in a) - 1) < 1e-5


def test_merging_many_documents_encodes_together():
    calls = []

    def encoder(texts):
        calls.append(len(texts))
        return semantic.hashed_ngrams(texts)

    documents = [[f"w{k} {j} {'x' * (j * k % 7)}." for j in range(k % 6)] for k in range(40)]
    together = semantic.merge_all(documents, encoder, 30)
    rounds = len(calls)
    assert together == [semantic.merge_neighbours(d, encoder, 30) for d in documents]
    assert rounds <= 6 < max(calls) and any(len(a) < len(b) for a, b in zip(together, documents, strict=True))


@pytest.mark.parametrize("make", [semantic.semantic_chunks, semantic.buffered_chunks])
def test_texts_are_split_once_and_in_python(spark, make):
    """The expression for sentences, evaluated twice, took most of the time."""
    texts = ["One. Two, two. 三。Four", "No sentence here", "!!", "", None, "😀. é? tail"]
    assert [semantic.parts_of(t) for t in texts] == [["One.", " Two,", " two.", " 三。"], ["No sentence here"], ["!!"], [], [], ["😀.", " é?"]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    made = make(docs)
    assert "regexp_extract_all" not in made._jdf.queryExecution().toString()
    got = {}
    for r in made.orderBy("doc_id", "pos").collect():
        got[r.doc_id] = got.get(r.doc_id, "") + r.content
    assert got == {k: "".join(semantic.parts_of(t)) for k, t in enumerate(texts) if t}


def test_memory_of_hashing_is_bounded():
    """The arrays of a batch of texts took some 90 bytes for each of its characters."""
    import tracemalloc

    texts = [f"{k} some words of a text " * 20 for k in range(8000)]
    tracemalloc.start()
    made = semantic.hashed_ngrams(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(map(len, texts)) > 3_500_000 and peak < 80_000_000
    assert (made == np.concatenate([semantic.hashed_ngrams([t]) for t in texts])).all()
    assert semantic.hashed_ngrams([]).shape == (0, 64)
