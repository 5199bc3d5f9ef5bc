"""Runs, evaluation, relabelling and files."""

import gzip
import json
import math

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import evaluation, labels, retrieval
from corpusloom.plans import config, experiments
from corpusloom.sources import files


def run_of(spark, *rows):
    return spark.createDataFrame([(q, d, k, float(s)) for q, d, k, s in rows], "qid string, docid string, rank int, score double")


def tuples(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_search_both_ways(spark):
    index = spark.createDataFrame([(f"d{k}", [float(k % 5), 1.0]) for k in range(23)], "docid string, embedding array<float>")
    queries = spark.createDataFrame([("q1", [1.0, 0.0]), ("q2", [-1.0, 0.5])], "qid string, embedding array<float>")
    want = []
    for q, v in (("q1", (1, 0)), ("q2", (-1, 0.5))):
        best = sorted((-(v[0] * (k % 5) + v[1]), f"d{k}") for k in range(23))[:6]
        want += [(q, d, n + 1, -s) for n, (s, d) in enumerate(best)]
    for search in (retrieval.search, retrieval.search_blocks):
        assert tuples(search(queries, index.repartition(4), 6), "qid", "docid", "rank", "score") == sorted(want)


def test_lift_cut_and_unmatched(spark):
    run = run_of(spark, ("q1", "d1#0", 1, 0.9), ("q1", "d1#1", 2, 0.8), ("q1", "d2#0", 3, 0.7))
    of = spark.createDataFrame([("d1#0", "d1"), ("d1#1", "d1"), ("d2#0", "d2")], "chunk_id string, doc_id string")
    assert tuples(retrieval.lift(run, of), "qid", "docid", "rank", "score") == [("q1", "d1", 1, 0.9), ("q1", "d2", 2, 0.7)]
    assert tuples(retrieval.cut(run, 2), "rank") == [(1,), (2,)]
    assert tuples(retrieval.unmatched(run, of.where("doc_id = 'd2'")), "docid") == [("d1#0",), ("d1#1",)]


def test_rerank_keeps_the_order_of_ties(spark):
    run = run_of(spark, ("q", "a", 1, 0.5), ("q", "b", 2, 0.7), ("q", "c", 3, 0.5))
    assert [r.docid for r in retrieval.reranked(run).orderBy("rank").collect()] == ["b", "a", "c"]


@pytest.mark.parametrize("qids, n, want", [("abcde", 2, [0, 0, 1, 1, 1]), ("ab", 3, [2, 2])])
def test_shards(spark, qids, n, want):
    rows = retrieval.sharded(spark.createDataFrame([(q,) for q in qids], "qid string"), n).orderBy("qid").collect()
    assert [r.shard for r in rows] == want
    assert files.complete(spark.createDataFrame([(s,) for s in want], "shard int"), n) == (len(set(want)) == n)


def test_metrics(spark):
    run = run_of(spark, ("q", "d2", 1, 3), ("q", "d1", 2, 2), ("q", "d3", 3, 1))
    qrels = spark.createDataFrame([("q", "d1", 1), ("q", "d3", 1), ("q", "d9", 0), ("none", "d1", 1)], "qid string, docid string, relevance int")
    got = {r.qid: r.score for r in evaluation.per_query(run, qrels, "ndcg@10").collect()}
    want = (1 / math.log2(3) + 0.5) / (1 + 1 / math.log2(3))
    assert got["q"] == pytest.approx(want) and got["q"] == pytest.approx(0.69343, abs=1e-5) and got["none"] == 0
    assert {r.qid: r.score for r in evaluation.per_query(run, qrels, "recall@2").collect()} == {"q": 0.5, "none": 0}
    assert [(r.metric, r.score) for r in evaluation.evaluate(run, qrels, "recall@2").collect()] == [("recall@2", 0.25)]
    for bad in ("ndcg", "map@10", "ndcg@x", "ndcg@0"):
        with pytest.raises(ValueError):
            evaluation.parse_metric(bad)


def test_macro_average_needs_all_languages(spark):
    scores = spark.createDataFrame([("en", "m", 0.5), ("zh", "m", 0.7), ("en", "n", 0.1), ("zh", "n", None)], "lang string, metric string, score double")
    got = {(r.lang, r.metric): r.score for r in evaluation.macro(scores).collect()}
    assert got["average", "m"] == pytest.approx(0.6) and got["average", "n"] is None


def pairs_of(spark, *rows):
    return spark.createDataFrame(rows, "qid string, docid string, type string, llm_label int, llm_raw_label int")


def test_counts_and_resume(spark):
    pairs = pairs_of(spark, ("q", "a", "original_pos", 0, 0), ("q", "b", "potential_pos", 1, 1), ("q", "c", "false_hard_neg", 0, -1))
    assert tuple(labels.label_counts(pairs).first()) == (3, 1, 1, 1, 1, 1, 1, 0)
    todo, done = labels.to_label(pairs, pairs)
    assert tuples(todo, "docid") == [("c",)] and tuples(done, "docid") == [("a",), ("b",)]
    assert labels.to_label(pairs, None)[1].isEmpty()
    judged = labels.from_table(todo, spark.createDataFrame([("q", "c", 1)], "qid string, docid string, llm_label int"))
    assert tuples(labels.resumed(pairs, judged.select(pairs.columns)), "docid", "llm_raw_label") == [("a", 0), ("b", 1), ("c", 1)]


def test_new_benchmark(spark, tmp_path):
    doc = lambda d: {"docid": d, "text": f"text {d}"}
    corpus = spark.createDataFrame([(f"d{k}", f"text d{k}") for k in range(10)], "docid string, text string")
    triplets = spark.createDataFrame([("q1", [doc("d0")], [doc("d1")]), ("q2", [doc("d1")], [doc("d9"), doc("d5")]), ("q3", [], [])], files.TRIPLETS)
    pairs = pairs_of(spark, ("q1", "d0", "original_pos", 0, 0), ("q2", "d4", "potential_pos", 1, 1), ("q2", "d5", "potential_pos", 1, 1), ("q2", "d5", "false_hard_neg", 1, 1))
    made = labels.new_triplets(triplets, pairs, corpus)
    assert tuples(made.select("qid", F.col("pos.docid").alias("p"), F.col("hard_neg.docid").alias("n")), "qid", "p", "n") == [("q2", ["d1", "d4"], ["d9"]), ("q3", [], [])]
    qrels = labels.new_qrels(made)
    assert tuples(qrels, "qid", "docid", "relevance") == [("q2", "d1", 1), ("q2", "d4", 1), ("q2", "d9", 0)]
    left = labels.new_corpus(corpus, pairs)
    assert left.count() == 9 and left.where("docid = 'd5'").isEmpty()
    files.write_benchmark(left, made, qrels, f"{tmp_path}/b")
    assert tuples(files.read_qrels(spark, files.benchmark_folder(spark, f"{tmp_path}/b", "qrels")), "qid", "docid", "relevance") == tuples(qrels, "qid", "docid", "relevance")


def test_rerank_filter(spark):
    a = run_of(spark, *(("q", f"d{k}", k, 1 / k) for k in range(1, 31)))
    b = run_of(spark, *(("q", f"d{k}", k, 1 / k) for k in range(2, 31)))
    known = lambda *d: spark.createDataFrame([("q", x) for x in d], "qid string, docid string")
    got = tuples(labels.rerank_filter([a, b], known("d2"), known("d15", "d25", "d1")), "docid", "type")
    assert got == sorted([(f"d{k}", "potential_pos") for k in range(3, 11)] + [("d15", "false_hard_neg")])


def test_files(spark, tmp_path):
    with gzip.open(tmp_path / "p.jsonl.gz", "wt") as f:
        f.write(json.dumps({"positive_passages": [{"docid": "1", "text": "first"}, {"docid": "2", "text": "second"}]}) + "\n")
        f.write(json.dumps({"positive_passages": []}) + "\n")
    assert [r.text for r in files.read_passages(spark, f"{tmp_path}/p.jsonl.gz").collect()] == ["first", None]
    run = run_of(spark, ("007", "01", 1, 0.25), ("007", "02", 2, 0.125))
    files.write_run(run, f"{tmp_path}/run", max_hits=1, decimals=6)
    assert spark.read.text(f"{tmp_path}/run").first().value == "007 Q0 01 1 0.250000 Faiss"
    files.write_run(run, f"{tmp_path}/run")
    assert files.read_run(spark, f"{tmp_path}/run").count() == 1, "an output that is there stays"
    files.write_run(run, f"{tmp_path}/run", overwrite=True)
    assert tuples(files.read_run(spark, f"{tmp_path}/run", 5), "qid", "docid", "rank", "score") == [("007", "01", 1, 0.25), ("007", "02", 2, 0.125)]
    files.write_run(run.withColumn("qid", F.lit("8")), f"{tmp_path}/run2")
    assert files.read_shards(spark, [f"{tmp_path}/run", f"{tmp_path}/run2"]).count() == 4
    files.write_metrics(spark.createDataFrame([("en", "ndcg@10", 0.5)], "lang string, metric string, score double"), f"{tmp_path}/m")
    assert json.loads(spark.read.text(f"{tmp_path}/m").first().value) == {"lang": "en", "scores": {"ndcg@10": 0.5}}
    (tmp_path / "q.json").write_text(json.dumps({"query_id": 7, "query": "what"}) + "\n")
    assert tuple(files.read_queries(spark, f"{tmp_path}/q.json", "json", "Find: ").first()) == ("7", "Find: what")


def test_names():
    assert config.encoder_name("a/b/checkpoint-100/") == "b_checkpoint-100"
    assert config.run_path("r", "m/enc", "bert", "zh", True, "x/rr", (0, 2)) == "r/enc-rr/bert/zh_0-of-2_real_doc.txt"
    assert config.chosen(None, config.TASKS, "task") == ["qa", "long-doc"]
    with pytest.raises(ValueError):
        config.chosen("xx", config.LANGUAGES, "language")
    with pytest.raises(ValueError):
        config.index_path("i", "e", "no segment", "zh")


@pytest.mark.parametrize("method", config.SEGMENTS)
def test_every_method_maps_chunks_to_documents(spark, method):
    docs = spark.createDataFrame([(1, "Short."), (2, "A longer one. " * 12), (3, None)], "doc_id long, text string")
    rows = experiments.chunk(docs, method, max_length=40).collect()
    assert {r.doc_id for r in rows} >= {1, 2} and all(r.chunk_id == f"{r.doc_id}-{r.pos}" for r in rows)
    assert [r.content for r in rows if r.doc_id == 1] == ["Short."]


def test_air_methods(spark):
    docs = spark.createDataFrame([(1, "Short."), (2, "T. " + "word " * 30)], "doc_id long, text string")
    for method, marks in (("easy_chunk", True), ("chunk_with_title", True), ("chunk_with_title", False)):
        rows = experiments.air_chunk(docs, method, max_length=40, at_marks=marks).collect()
        assert len({r.chunk_id for r in rows}) == len(rows) > 2
    with pytest.raises(ValueError):
        experiments.air_chunk(docs, "bert")


def test_whole_experiment(spark):
    docs = spark.createDataFrame([(1, "red apple pie. " * 10), (2, "blue sky above. " * 10), (3, "green grass. " * 10)], "doc_id long, text string")
    chunks = experiments.chunk(docs, "chunk", max_length=60)
    queries = spark.createDataFrame([("q1", "red apple pie."), ("q2", "green grass.")], "qid string, query string")
    run, lifted = experiments.embed_and_search(chunks, queries, hits=8)
    assert [(r.qid, r.docid) for r in lifted.where("rank = 1").orderBy("qid").collect()] == [("q1", "1"), ("q2", "3")]
    _, again = experiments.rerank(run, queries, chunks, top_k=8, normalise=True)
    qrels = spark.createDataFrame([("q1", "1", 1, "en"), ("q2", "3", 1, "de")], "qid string, docid string, relevance int, lang string")
    scores = {(r.lang, r.metric): r.score for r in experiments.evaluate_languages(again, qrels, ["ndcg@10", "recall@1"]).collect()}
    assert scores["average", "ndcg@10"] == 1.0 and scores["en", "recall@1"] == 1.0


def test_relabel(spark):
    run = run_of(spark, ("q", "a", 1, 1.0), ("q", "b", 2, 0.5), ("q", "c", 3, 0.2))
    pos, neg = (spark.createDataFrame([("q", d)], "qid string, docid string") for d in "ab")
    corpus = spark.createDataFrame([(d, d) for d in "abc"], "docid string, text string")
    triplets = spark.createDataFrame([("q", [{"docid": "a", "text": "a"}], [{"docid": "b", "text": "b"}])], files.TRIPLETS)
    judge = lambda todo: labels.from_table(todo, spark.createDataFrame([("q", d, 1) for d in "abc"], "qid string, docid string, llm_label int"))
    out = experiments.relabel(pos, neg, [run], judge, triplets, corpus)
    assert tuples(out["qrels"], "docid", "relevance") == [("a", 1), ("c", 1)]
    assert tuples(out["corpus"], "docid") == [("a",), ("c",)]


def test_stream_equals_table(spark, tmp_path):
    from corpusloom.streaming import chunks as stream

    docs = spark.createDataFrame([(k, "x" * k * 7) for k in range(20)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/in")
    made = stream.chunk_stream(spark.readStream.schema("doc_id long, text string").parquet(f"{tmp_path}/in"), 10, 2)
    stream.write_stream(made, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    assert tuples(spark.read.parquet(f"{tmp_path}/out"), "chunk_id", "content") == tuples(stream.chunk_stream(docs, 10, 2), "chunk_id", "content")


def test_search_with_nulls_and_ties(spark):
    rows = [(f"d{k:04d}", [1.0, 2.0]) for k in range(3000)] + [("a", None), ("best", [5.0, 5.0]), ("z", [-1.0, 0.0])]
    index = spark.createDataFrame(rows, "docid string, embedding array<float>").repartition(3)
    queries = spark.createDataFrame([(1, [1.0, 1.0]), (2, None), (3, [0.0, 0.0])], "qid int, embedding array<float>")
    got = [(r.qid, r.docid, r["rank"], r.score) for r in retrieval.search(queries, index, 3).orderBy("qid", "rank").collect()]
    assert got == [(1, "best", 1, 10.0), (1, "d0000", 2, 3.0), (1, "d0001", 3, 3.0), (3, "best", 1, 0.0), (3, "d0000", 2, 0.0), (3, "d0001", 3, 0.0)]
    assert retrieval.search(queries, index.limit(0), 3).count() == 0 and retrieval.search(queries.limit(0), index, 3).count() == 0
    with pytest.raises(ValueError):
        retrieval.search(queries, index, 0)


def test_search_against_all_pairs(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(400, 16)).astype(np.float32)
    vectors[50:60] = vectors[40]
    index = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "docid long, embedding array<float>").repartition(5)
    queries = spark.createDataFrame([(k, vectors[k].tolist()) for k in range(0, 400, 9)] + [(40, vectors[40].tolist())], "qid long, embedding array<float>")

    def score(a, b):
        total = 0.0
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            total += x * y
        return total

    want = {}
    for q in [*range(0, 400, 9), 40]:
        want[q] = sorted((-score(vectors[q], v), k) for k, v in enumerate(vectors))[:12]
    got = {}
    for r in retrieval.search(queries, index, 12).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append((-r.score, r.docid))
    assert got == want


def test_paths():
    from corpusloom.plans import config

    assert config.chunk_folder("chunk_with_title", 512, True, 50) == "chunk_with_title_512_True_50"
    assert config.label_path("qa", "wiki", "en", "d1") == "qa/wiki/en/d1"
    with pytest.raises(ValueError):
        config.label_path("qa", "nowhere", "en", "d1")
