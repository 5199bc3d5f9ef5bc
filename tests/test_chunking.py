"""Golden cases, properties and plain loops for the chunkers."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import chunking


def contents(spark, text, make):
    row = spark.createDataFrame([(text,)], "text string").select(make(F.col("text")).alias("c")).first()
    return [x.content for x in row.c]


@pytest.mark.parametrize(
    "text, size, overlap, want",
    [
        ("abcdefghij", 4, 0, ["abcd", "efgh", "ij"]),
        ("abcdefghij", 4, 1, ["abcd", "defg", "ghij", "j"]),
        ("abcdefghij", 10, 0, ["abcdefghij"]),
        ("abcdefghij", 10, 2, ["abcdefghij", "ij"]),
        ("abcdefghij", 12, 0, ["abcdefghij"]),
        ("", 4, 0, []),
        ("你好😀世界", 2, 0, ["你好", "😀世", "界"]),
        (None, 4, 0, []),
    ],
)
def test_windows(spark, text, size, overlap, want):
    assert contents(spark, text, lambda c: T.windows(c, size, overlap)) == want


@pytest.mark.parametrize("size, overlap", [(4, 4), (4, 5), (0, 0), (4, -1)])
def test_window_that_never_ends(size, overlap):
    with pytest.raises(ValueError):
        T.checked_window(size, overlap)


def loop(text, size, overlap):
    out, start = [], 0
    while start + size <= len(text):
        out.append(text[start : start + size])
        start += size - overlap
    return [*out, text[start:]] if start < len(text) else out


def test_windows_against_a_loop(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab é你😀\n") for _ in range(rng.randrange(60))) for _ in range(80)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    for size, overlap in ((7, 0), (7, 3), (1, 0)):
        got = {r.k: [c.content for c in r.c] for r in df.select("k", T.windows(F.col("text"), size, overlap).alias("c")).collect()}
        assert got == {k: loop(t, size, overlap) for k, t in enumerate(texts)}


def test_titles(spark):
    text = "Hi. abcdefghijklmnopqrstuvwxyz"
    assert contents(spark, text, lambda c: T.titled_windows(c, 20, 0)) == ["Hi. abcdefghijklmnop", "Hi qrstuvwxyz"]
    assert contents(spark, "abcdefghij", lambda c: T.titled_windows(c, 4, 0)) == ["abcd", "efgh", "ij"]
    assert contents(spark, "A very long title indeed. x", lambda c: T.titled_windows(c, 10, 0, keep_title=False)) == ["A very lon", "g title in", "deed. x"]
    assert contents(spark, "", lambda c: T.titled_windows(c, 10, 0)) == []


def test_marks():
    assert T.cut_at_marks("aa bb cc dd", 5) == ["aa bb", " cc", " dd"]
    assert T.cut_at_marks("abcdefgh", 3) == ["abc", "def", "gh"]
    assert T.cut_at_marks("", 3) == []
    assert "".join(T.cut_at_marks("one two. three? four five six", 9)) == "one two. three? four five six"


def test_mark_chunks(spark):
    docs = spark.createDataFrame([(1, "aa bb cc dd"), (2, None), (3, "")], "doc_id long, text string")
    rows = chunking.mark_chunks(docs, 5).collect()
    assert [(r.doc_id, r.pos, r.content) for r in rows] == [(1, 0, "aa bb"), (1, 1, " cc"), (1, 2, " dd")]


def test_sentences(spark):
    text = "...Hi there. 你好，世界。\nx! tail"
    row = spark.createDataFrame([(text,)], "text string").select(T.sentences(F.col("text")).alias("s")).first()
    assert row.s == ["Hi there.", " 你好，世界。", "\nx!"]


@pytest.mark.parametrize(
    "text, size, want, compat",
    [
        ("ab.cdef.gh", 6, ["ab.", "cdef."], ["ab.", "cdef."]),
        ("abcdefgh.i.", 5, ["abcdefgh.", "i."], ["", "abcdefgh.", "i."]),
        ("abc", 3, ["abc"], ["abc"]),
        ("abc", 2, ["abc"], ["", "abc"]),
        ("", 2, [], []),
    ],
)
def test_greedy(spark, text, size, want, compat):
    assert contents(spark, text, lambda c: T.greedy(c, size)) == want
    assert contents(spark, text, lambda c: T.greedy(c, size, drop_empty=False)) == compat


def test_greedy_keeps_all_sentences(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("abc. !，?") for _ in range(rng.randrange(1, 120))) for _ in range(60)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in df.select("text", T.sentences(F.col("text")).alias("s"), T.greedy(F.col("text"), 20).alias("c")).collect():
        assert "".join(x.content for x in r.c) == ("".join(r.s) or r.text)
        assert all(len(x.content) <= 20 or x.content in [*r.s, r.text] for x in r.c)


def test_long_unterminated_tail_is_linear(spark):
    text = "a." + "b" * 200_000
    row = spark.createDataFrame([(text,)], "text string").select(F.size(T.sentences(F.col("text"))).alias("n")).first()
    assert row.n == 1


def test_numbering_ignores_partitions(spark):
    docs = spark.createDataFrame([(k, "x" * (k % 4) * 3, "en") for k in range(50)], "doc_id long, text string, lang string")
    made = chunking.explode_chunks(docs, T.windows(F.col("text"), 3), keep=("doc_id", "lang"))
    one = {(r.doc_id, r.pos): r.chunk_id for r in chunking.numbered(made.repartition(7), F.col("lang")).collect()}
    ids = sorted(one.items())
    assert [v for _, v in ids] == [f"doc-en-{n}" for n in range(len(ids))]


@pytest.mark.parametrize("kind", ["string", "long"])
def test_numbering_of_any_ids_over_many_ranges(spark, monkeypatch, kind):
    from corpusloom.operators import staging

    monkeypatch.setattr(staging, "RANGE_ROWS", 7)
    ids = [f"d{(k * 37) % 101:03d}é" if kind == "string" else (k * 37) % 101 - 50 for k in range(101)]
    docs = spark.createDataFrame([(i, "x" * (n % 5), "en") for n, i in enumerate(ids)], f"doc_id {kind}, text string, lang string")
    want, n = {}, 0
    for i, text, _ in sorted(map(tuple, docs.collect())):
        for pos in range(-(-len(text) // 2)):
            want[i, pos] = f"doc-en-{n}"
            n += 1
    made = chunking.explode_chunks(docs, T.windows(F.col("text"), 2), keep=("doc_id", "lang"))
    assert {(r.doc_id, r.pos): r.chunk_id for r in chunking.numbered(made, F.col("lang")).collect()} == want
    whole = chunking.numbered_docs(docs, T.windows(F.col("text"), 2), F.col("lang")).collect()
    assert {(r.doc_id, r.pos): r.chunk_id for r in whole} == want and all(r.content in ("x", "xx") for r in whole)
    ids = chunking.numbered_positions(docs, T.window_count(F.col("text"), 2), F.col("lang")).collect()
    assert {(r.doc_id, r.pos): r.chunk_id for r in ids} == want
    assert chunking.numbered_docs(docs.limit(0), T.windows(F.col("text"), 2), F.col("lang")).count() == 0
