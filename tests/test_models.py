"""Batches for a model, pairs for a reranker, table functions, long texts and plain versions of the semantic chunkers."""

import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import batching, chunking, semantic, tablefunctions
from corpusloom.plans import experiments


def test_batches_are_bounded():
    rng = random.Random(1)
    for most, texts in ((64, 8), (1000, 256), (10, 3)):
        lengths = [rng.choice([0, 1, 5, 30, rng.randrange(200)]) for _ in range(300)]
        made = batching.length_batches(lengths, most, texts)
        assert sorted(k for b in made for k in b) == list(range(300))
        for b in made:
            assert len(b) <= texts and (len(b) == 1 or len(b) * max(1, *(lengths[k] for k in b)) <= most)
        assert [lengths[k] for b in made for k in b] == sorted(lengths, reverse=True)
    assert batching.length_batches([]) == []


def words():
    return lambda text: [len(w) for w in text.split()]


def sums():
    return lambda ids, mask: np.stack([np.where(mask, ids, 0).sum(1), mask.sum(1), (np.where(mask, ids, 0) ** 2).sum(1)], 1)


def test_encoding_in_batches_equals_one_by_one(spark):
    rng = random.Random(2)
    texts = [" ".join("x" * rng.randrange(1, 9) for _ in range(rng.randrange(40))) for _ in range(200)] + [None, "", "long " * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").repartition(3)
    got = {r.k: (r.n_tokens, r.v) for r in batching.encoded(df, "t", words, sums, "sums", out="v", max_tokens=25, batch_tokens=60, batch_texts=7).collect()}
    for k, t in enumerate(texts):
        ids = words()(t or "")[:25]
        one = sums()(np.array([ids or [0]]), np.array([[True] * len(ids) or [False]]))[0]
        assert got[k] == (len(ids), one.tolist())


def test_a_model_is_loaded_once_a_worker(spark, tmp_path):
    def model():
        with open(f"{tmp_path}/loads", "a") as f:
            f.write(f"{__import__('os').getpid()}\n")
        return sums()

    df = spark.range(100).select(F.col("id").cast("string").alias("t")).repartition(12)
    for _ in range(2):
        assert batching.encoded(df, "t", words, model, "counted").count() == 100
        batching.encoded(df, "t", words, model, "counted").collect()
    loads = (tmp_path / "loads").read_text().split()
    assert len(loads) == len(set(loads))


def test_pairs_are_cut_and_scored_once(spark):
    assert batching.pair_ids([1, 2, 3], [4, 5, 6], 2, 5) == [1, 2, 0, 4, 5]
    assert batching.pair_ids([1], [], 2, 5) == [1, 0] and batching.pair_ids([1, 2, 3, 4], [9], 4, 5) == [1, 2, 3, 4, 0]
    calls = spark.sparkContext.accumulator(0)

    def model():
        def score(ids, mask):
            calls.add(len(ids))
            return mask.sum(1)

        return score

    rows = [(f"q{q}", f"d{d}", r, 0.0, "a b c" if q % 2 else None, "x y z " * (d % 3)) for q in range(4) for d in range(6) for r in (1, 2)]
    df = spark.createDataFrame(rows, "qid string, docid string, rank int, score double, query string, passage string").withColumn("pair", F.lit("own"))
    got = batching.scored(df, words, model, "counted pairs", max_query=2, max_length=7).collect()
    assert calls.value == 2 * 3 and len(got) == len(rows)
    assert all(r.score == len(batching.pair_ids([1] * len((r["query"] or "").split()), [1] * len(r.passage.split()), 2, 7)) and r.pair == "own" for r in got)
    with pytest.raises(ValueError):
        batching.scored(df, words, model, "n", max_query=7, max_length=7)


def test_table_functions(spark):
    tablefunctions.register(spark)
    texts = [None, "", "abcdefghij", "One. Two, three! tail", "😀é" * 20, "no end " * 9]
    df = spark.createDataFrame([(k, t, f"l{k % 2}") for k, t in enumerate(texts)], "k int, text string, lang string")
    df.createOrReplaceTempView("given")
    for method, made in (("easy_chunk", T.windows(F.col("text"), 8, 3)), ("chunk", T.greedy(F.col("text"), 8))):
        want = sorted((r.k, r.pos, r.content) for r in chunking.explode_chunks(df, made, keep=("k",)).collect())
        overlap = 3 if method == "easy_chunk" else 0
        lateral = spark.sql(f"SELECT k, c.pos, c.content FROM given, LATERAL chunk_text(text, '{method}', 8, {overlap}) c").collect()
        assert sorted(map(tuple, lateral)) == want
        table = spark.sql(f"SELECT * FROM chunk_table(TABLE(given) PARTITION BY (lang), '{method}', 8, {overlap})")
        assert table.columns == ["k", "lang", "pos", "content"]
        assert sorted((r.k, r.pos, r.content) for r in table.collect()) == want
    for wrong in ("'else', 8, 0", "'chunk', 8, 8", "lang, 8, 0", "'marks', 1, 0"):
        with pytest.raises(Exception, match="one of|overlap|constant|too small"):
            spark.sql(f"SELECT k, c.* FROM given, LATERAL chunk_text(text, {wrong}) c").collect()
    with pytest.raises(Exception, match="column text"):
        spark.sql("SELECT * FROM chunk_table(TABLE(SELECT k FROM given), 'chunk', 8, 0)")
    with pytest.raises(Exception, match="already"):
        spark.sql("SELECT * FROM chunk_table(TABLE(SELECT text, 1 AS pos FROM given), 'chunk', 8, 0)")


def test_string_chunkers_equal_the_columns(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab.。 !é你😀\n,") for _ in range(rng.randrange(80))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    c = F.col("text")
    row = lambda made: {r.k: [x.content for x in r.c] for r in df.select("k", made.alias("c")).collect()}
    assert row(T.windows(c, 9, 4)) == {k: T.windows_of(t, 9, 4) for k, t in enumerate(texts)}
    assert row(T.greedy(c, 9)) == {k: T.greedy_of(t, 9) for k, t in enumerate(texts)}
    assert {r.k: r.s for r in df.select("k", T.sentences(c).alias("s")).collect()} == {k: T.sentences_of(t) for k, t in enumerate(texts)}


# Long texts


def seconds(spark, text, made):
    df = spark.createDataFrame([(text,)], "text string").cache()
    df.count()
    start = time.perf_counter()
    rows = chunking.explode_chunks(df.withColumn("doc_id", F.lit(1)), made).agg(F.count("*"), F.sum(F.length("content"))).first()
    return time.perf_counter() - start, tuple(rows)


@pytest.mark.parametrize("made", [lambda c: T.windows(c, 512, 50), lambda c: T.pieces(c, 50), lambda c: T.titled_windows(c, 512, 50), lambda c: T.windows(c, 5000, 100)], ids=["windows", "pieces", "titled", "long"])
def test_windows_take_linear_time(spark, made):
    text = "Ein Titel. " + "wörter mit 😀 und mehr " * 200_000
    c = F.col("text")
    seconds(spark, text[:100_000], made(c))
    small, large = text[:1_000_000], text[:4_000_000]
    short = min(seconds(spark, small, made(c))[0] for _ in range(2))
    long = min(seconds(spark, large, made(c))[0] for _ in range(2))
    assert long < 4 * short * 2 + 1
    _, (n, chars) = seconds(spark, large, T.windows(c, 5000, 100))
    want = T.windows_of(large, 5000, 100)
    assert (n, chars) == (len(want), sum(map(len, want)))


def test_a_text_of_20_megabytes(spark):
    text = "0123456789" * 2_000_000
    for made, want in ((T.windows(F.col("text"), 512, 50), T.windows_of(text, 512, 50)), (T.pieces(F.col("text")), T.windows_of(text, 50))):
        took, (n, chars) = seconds(spark, text, made)
        assert (n, chars) == (len(want), sum(map(len, want))) and took < 60


@pytest.mark.parametrize("size, overlap", [(1024, 0), (1025, 0), (1500, 700), (3000, 2999), (1023, 1022)])
def test_windows_on_both_sides_of_a_block(spark, size, overlap):
    rng = random.Random(size)
    texts = ["".join(rng.choice("aé你😀\n") for _ in range(n)) for n in (0, 1, 1023, 1024, 1025, 2048, 3100, 5000)]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    got = {r.k: [x.content for x in r.c] for r in df.select("k", T.windows(F.col("text"), size, overlap).alias("c")).collect()}
    assert got == {k: T.windows_of(t, size, overlap) for k, t in enumerate(texts)}


# Plain versions of the semantic chunkers


def plain_sentences(text, ends="。！？,.?!"):
    return re.findall(f"[^{ends}]+[{ends}]", text) or [text]


def plain_semantic(text, kind, window, max_length, k=None, ends="。！？,.?!"):
    """Sentences; neighbours joined by kind; then inner segments join the neighbour that is more like them."""
    code = lambda x: semantic.hashed_ngrams([x]).astype(np.float32).astype(np.float64)[0]
    parts = plain_sentences(text, ends)
    vectors = [code(p) for p in parts]
    sims = [float(np.sum(a * b)) for a, b in zip(vectors, vectors[1:], strict=False)]
    out = parts[:1]
    if sims:
        limit = sum(sims) / len(sims) if kind != "k" else sorted(sims)[min(max(k or sum(map(len, parts)) // 50 + 1, 1), len(sims)) - 1]
        for p, s in zip(parts[1:], sims, strict=True):
            if (len(out[-1]) + len(p) <= window and s > limit) if kind == "slide_window" else s >= limit - 1e-12:
                out[-1] += p
            else:
                out.append(p)
    i = 1
    while i < len(out) - 1:
        left, here, right = (semantic.hashed_ngrams([x])[0] for x in out[i - 1 : i + 2])
        a, b = (i - 1, i) if float(left @ here) > float(right @ here) else (i, i + 1)
        if len(out[a]) + len(out[b]) < max_length:
            out[a : b + 1] = [out[a] + out[b]]
        else:
            i += 1
    return out


def some_texts(n=30):
    rng = random.Random(9)
    topics = [["cat", "cats", "catnip", "kitten"], ["rain", "rainy", "snow", "cloud"], ["bread", "butter", "jam"]]
    return ["".join(" ".join(rng.choice(topics[(j // 4) % 3]) for _ in range(rng.randrange(1, 9))) + rng.choice([". ", "! ", "。", "? "]) for j in range(rng.randrange(1, 25))) for _ in range(n)]


@pytest.mark.parametrize("kind", ["threshold", "slide_window", "k"])
def test_semantic_chunks_against_a_plain_version(spark, kind):
    texts = [*some_texts(), "no sentence"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {}
    for r in semantic.semantic_chunks(df, kind, window=80, max_length=120).orderBy("doc_id", "pos").collect():
        got.setdefault(r.doc_id, []).append(r.content)
    assert got == {k: [c for c in plain_semantic(t, kind, 80, 120) if c] for k, t in enumerate(texts)}


def test_the_older_variant_against_a_plain_version(spark):
    texts = [t.replace(".", "。") if k % 2 else t for k, t in enumerate(some_texts())]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {}
    for r in semantic.semantic_chunks(df, "slide_window", window=90, max_length=90, ends=T.SENTENCE_END_NARROW).orderBy("doc_id", "pos").collect():
        got.setdefault(r.doc_id, []).append(r.content)
    assert got == {k: plain_semantic(t, "slide_window", 90, 90, ends="。！？") for k, t in enumerate(texts)}


def plain_buffered(text, buffer, share):
    parts = plain_sentences(text)
    if len(parts) < 2:
        return parts
    code = lambda x: semantic.hashed_ngrams([x])[0]
    vectors = [code("".join(parts[max(0, k - buffer) : k + buffer + 1])) for k in range(len(parts))]
    gaps = [1 - float(a @ b) for a, b in zip(vectors, vectors[1:], strict=False)]
    at = share * (len(gaps) - 1)
    s, low = sorted(gaps), int(at)
    limit = s[low] + (s[min(low + 1, len(s) - 1)] - s[low]) * (at - low)
    out = [parts[0]]
    for p, g in zip(parts[1:], gaps, strict=True):
        if g > limit + 1e-12:
            out.append(p)
        else:
            out[-1] += p
    return out


@pytest.mark.parametrize("buffer, share", [(1, 0.95), (0, 0.5), (3, 0.8)])
def test_buffered_splitter_against_a_plain_version(spark, buffer, share):
    texts = [*some_texts(), "no sentence", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {}
    for r in semantic.buffered_chunks(df, buffer, share).orderBy("doc_id", "pos").collect():
        got.setdefault(r.doc_id, []).append(r.content)
    want = {k: plain_buffered(t, buffer, share) for k, t in enumerate(texts) if t}
    assert got == want and any(len(c) > 1 for c in want.values())
    with pytest.raises(ValueError):
        semantic.buffered_chunks(df, -1)


def test_retrieval_experiment_against_a_plain_version(spark):
    texts = some_texts(12)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    asked = [("a", "cats and a kitten"), ("b", "snow and rain")]
    chunks = experiments.chunk(docs, "easy_chunk", max_length=40)
    _, found = experiments.embed_and_search(chunks, spark.createDataFrame(asked, "qid string, query string"), hits=25)
    code = lambda x: semantic.hashed_ngrams([x]).astype(np.float32)[0].tolist()

    def dot(a, b):
        total = 0.0
        for x, y in zip(a, b, strict=True):
            total += x * y
        return total

    pieces = [(f"{k}-{n}", str(k), c) for k, t in enumerate(texts) for n, c in enumerate([t] if len(t) < 40 else T.windows_of(t, 40))]
    want = set()
    for q, text in asked:
        hits = sorted((-dot(code(text), code(c)), i, d) for i, d, c in pieces)[:25]
        best = {}
        for n, (s, _, d) in enumerate(hits):
            best.setdefault(d, (s, n))
        want |= {(q, d, n + 1, -s) for n, (d, (s, _)) in enumerate(sorted(best.items(), key=lambda x: x[1]))}
    assert {(r.qid, r.docid, r["rank"], r.score) for r in found.collect()} == want
