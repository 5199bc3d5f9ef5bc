"""Registered queries work on whole tables: small ones, and plain versions of the same rows."""

import collections

from corpusloom.operators import labels, retrieval
from corpusloom.plans import registry


def documents(spark, folder, n):
    texts = {k: " ".join(f"w{(k * j) % 11}" for j in range(1, 20)) for k in range(n)}
    rows = [(k, t, "en", "s", len(t)) for k, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    return texts


def test_all_documents_are_paired_and_scored(spark, tmp_path):
    texts = documents(spark, tmp_path, 290)
    asked = {k: f"w{k % 11} W{k % 7}" for k in range(40)}
    spark.createDataFrame(list(asked.items()), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r.qid, r.docid, r["rank"], r["query"], r.passage) for r in registry.QUERIES["query_passage_pairs"](spark, str(tmp_path)).collect()}
    assert got == {(str(k % 40), str(k), k // 40 + 1, asked[k % 40], t) for k, t in texts.items()}
    of = collections.defaultdict(list)
    for k, t in texts.items():
        words = set(asked[k % 40].lower().split())
        of[k % 40].append((-len(words & set(t.split())) / len(words), k))
    want = {(str(q), str(k), n + 1, -s) for q, found in of.items() for n, (s, k) in enumerate(sorted(found))}
    assert {(r.qid, r.docid, r["rank"], r.score) for r in registry.QUERIES["rerank_scored"](spark, str(tmp_path)).collect()} == want


def test_the_new_corpus_has_whole_texts(spark, tmp_path):
    texts = documents(spark, tmp_path, 30)
    spark.createDataFrame([(k, k % 2, 0) for k in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    gone = {k for k in range(30) if k % 3 == 2 and k % 2 and k % 7}
    got = {(r.docid, r.text) for r in registry.QUERIES["rebuild_corpus"](spark, str(tmp_path)).collect()}
    assert got == {(str(k), t) for k, t in texts.items() if k not in gone} and min(len(t) for _, t in got) > 40
    _, _, triplets = registry._triplets(spark, str(tmp_path))
    assert all(d.text == texts[int(d.docid)] for r in triplets.collect() for d in [*r.pos, *r.hard_neg])


def test_every_query_with_a_bad_original_goes(spark, tmp_path):
    documents(spark, tmp_path, 120)
    # Originals (doc_id % 3 = 0) are good but for doc_id 18, of q18; those of doc_id % 7 = 0 have failed and count as bad.
    spark.createDataFrame([(k, int(k != 18), 0) for k in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    bad = {f"q{k % 20}" for k in range(0, 120, 3) if k == 18 or k % 7 == 0}
    gone = {k for k in range(120) if k % 3 == 2 and k % 7}
    kept = [k for k in range(120) if f"q{k % 20}" not in bad and k not in gone]
    want = {(f"q{k % 20}", str(k), int(k % 3 < 2)) for k in kept if k % 3 != 1 or k % 7}
    assert any(int(q[1:]) >= 12 for q in bad) and want
    got = {(r.qid, r.docid, r.relevance) for r in registry.QUERIES["rebuild_qrels"](spark, str(tmp_path)).collect()}
    assert got == want
    ids = lambda q, relevance: ",".join(sorted(d for q2, d, r in want if (q2, r) == (q, relevance)))
    made = {(r.qid, r.pos, r.hard_neg) for r in registry.QUERIES["rebuild_triplets"](spark, str(tmp_path)).collect()}
    assert made == {(q, ids(q, 1), ids(q, 0)) for q in {f"q{k % 20}" for k in range(120)} - bad}


def test_more_queries_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 3)
    index = spark.createDataFrame([(k, [float(k % 5), 1.0]) for k in range(12)], "docid long, embedding array<float>")
    queries = spark.createDataFrame([(k, [float(k - 4), 0.5]) for k in range(10)], "qid long, embedding array<float>")
    want = {tuple(r) for r in retrieval.search(queries, index, 4).collect()}
    assert len(want) == 40 and {tuple(r) for r in retrieval.search_blocks(queries, index, 4).collect()} == want


def test_labelled_pairs_stream_past_the_hits(spark):
    """Labelled pairs are neither made distinct nor sorted for the filter: only those that are hits are aggregated."""
    run = lambda rows: spark.createDataFrame(rows, "qid string, docid string, rank int")
    pairs = lambda rows: spark.createDataFrame(rows, "qid string, docid string")
    one = run([("q", "a", 1), ("q", "b", 2), ("q", "c", 15), ("q", "d", 15), ("q", "e", 3), ("q", "f", 25), ("q", None, 4), ("q", "g", 5)])
    other = run([("q", "a", 9), ("q", "b", 1), ("q", "c", 1), ("q", "d", 1), ("q", "e", 11), ("q", "f", 1), ("q", None, 4)])
    got = labels.rerank_filter([one, other], pairs([("q", "a"), ("q", "a"), ("q", "z")]), pairs([("q", "d"), ("q", "d"), ("q", "f"), ("q", "a")]))
    assert sorted(map(tuple, got.collect()), key=str) == [("q", "a", "false_hard_neg"), ("q", "b", "potential_pos"), ("q", "d", "false_hard_neg"), ("q", None, "potential_pos")]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "LeftSemi, BuildRight" in plan and "LeftAnti" not in plan
