"""Lines with any id, outputs that appear whole, merged inputs, the log of judgements and the data source."""

import gzip
import json
import os

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import judgements, labels
from corpusloom.sources import commit, dataset, files

ODD_IDS = ['"d1', 'd"2"', "#d3", "\\d4", "d\\", "'", "é你😀", "a,b", "-1", "0x", "null", '""', "a\u0001b"]


def test_runs_with_any_id(spark, tmp_path):
    rows = [(q, d, k + 1, 1.0 / (k + 1)) for q in ODD_IDS for k, d in enumerate(ODD_IDS)]
    run = spark.createDataFrame(rows, "qid string, docid string, rank int, score double")
    files.write_run(run, f"{tmp_path}/run")
    assert sorted(map(tuple, files.read_run(spark, f"{tmp_path}/run").collect())) == sorted(rows)
    qrels = run.select("qid", "docid", F.col("rank").alias("relevance"))
    files.write_benchmark(spark.createDataFrame([(d, d) for d in ODD_IDS], "docid string, text string"), spark.createDataFrame([], files.TRIPLETS), qrels, f"{tmp_path}/b")
    back = files.read_qrels(spark, files.benchmark_folder(spark, f"{tmp_path}/b", "qrels"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, qrels.collect()))


@pytest.mark.parametrize("wrong", ["a b", "a\tb", "a\nb", "", None, "a b", "a　b", "a b"])
def test_ids_that_no_line_can_hold(spark, tmp_path, wrong):
    run = spark.createDataFrame([("q", wrong, 1, 1.0)], "qid string, docid string, rank int, score double")
    with pytest.raises(Exception, match="can't be written to a line"):
        files.write_run(run, f"{tmp_path}/run")
    with pytest.raises(Exception, match="can't be written to a line"):
        files.qrels_lines(run.select("qid", "docid", F.col("rank").alias("relevance"))).collect()


def test_foreign_lines(spark, tmp_path):
    (tmp_path / "run").write_text('q1 Q0 d 3 1 0.9 Faiss\n\nq1\tQ0\t"d1\t2\t0.5\ttag\n  q1  Q0  #x  3  1e-3  t  \n')
    assert [tuple(r) for r in files.read_run(spark, f"{tmp_path}/run").collect()] == [("q1", "d 3", 1, 0.9), ("q1", '"d1', 2, 0.5), ("q1", "#x", 3, 0.001)]
    (tmp_path / "qrels").write_text('q1\tQ0\t"d1\t1\nq1 0 d2 0\n')
    assert [tuple(r) for r in files.read_qrels(spark, f"{tmp_path}/qrels").collect()] == [("q1", '"d1', 1), ("q1", "d2", 0)]
    (tmp_path / "short").write_text("q1 Q0 d1 1 0.9\n")
    with pytest.raises(Exception, match="no such line is expected"):
        files.read_run(spark, f"{tmp_path}/short").collect()


def benchmark(spark, n):
    corpus = spark.createDataFrame([(f"d{k}", f"text {k}") for k in range(n)], "docid string, text string")
    qrels = spark.createDataFrame([("q", f"d{k}", 1) for k in range(n)], "qid string, docid string, relevance int")
    return corpus, spark.createDataFrame([("q", [], [])], files.TRIPLETS), qrels


def test_a_run_that_fails_half_way_leaves_nothing(spark, tmp_path):
    path = f"{tmp_path}/b"
    corpus, triplets, qrels = benchmark(spark, 4)
    with pytest.raises(Exception, match="can't be written"):
        files.write_benchmark(corpus, triplets, qrels.withColumn("docid", F.lit("a b")), path)
    assert commit.manifest(spark, path) is None
    with pytest.raises(FileNotFoundError):
        files.benchmark_folder(spark, path, "corpus")
    assert files.write_benchmark(corpus, triplets, qrels, path)
    assert commit.rows(spark, path) == {"corpus": 4, "test_data": 1, "qrels": 4}
    assert not files.write_benchmark(*benchmark(spark, 9), path), "an output that exists is kept"
    assert files.read_qrels(spark, files.benchmark_folder(spark, path, "qrels")).count() == 4
    with pytest.raises(Exception, match="can't be written"):
        files.write_benchmark(corpus, triplets, qrels.withColumn("docid", F.lit("a b")), path, overwrite=True)
    assert commit.rows(spark, path)["corpus"] == 4, "the old one stays until the new one is whole"
    assert files.write_benchmark(*benchmark(spark, 9), path, overwrite=True) and commit.rows(spark, path)["corpus"] == 9
    assert files.read_json(spark, files.benchmark_folder(spark, path, "corpus"), files.HUB_CORPUS).count() == 9


def test_a_shard_that_has_lost_a_file(spark, tmp_path):
    path = f"{tmp_path}/s"
    run = spark.createDataFrame([(f"q{k}", "d", 1, 0.5) for k in range(9)], "qid string, docid string, rank int, score double").repartition(3)
    shards = [run.where(f"cast(substr(qid, 2) as int) % 3 = {k}") for k in range(3)]
    assert files.write_sharded(shards, path) and not files.write_sharded(shards, path)
    assert files.read_sharded(spark, path, 3).count() == 9
    with pytest.raises(FileNotFoundError, match="3 of 4"):
        files.read_sharded(spark, path, 4)
    lost = next(f for f in (tmp_path / "s").rglob("part-*") if "shard-1" in str(f) and f.stat().st_size)
    os.rename(lost, tmp_path / "elsewhere")
    with pytest.raises(FileNotFoundError, match="lacks"):
        files.read_sharded(spark, path, 3)


def test_the_last_input_wins(spark):
    frame = lambda *rows: spark.createDataFrame(rows, "id string, content string")
    a, b, c = frame(("1", "a"), ("2", "a"), (None, "a"), ("3", None)), frame(("2", "b"), ("2", "bb"), (None, None)), frame(("2", "c"), ("4", "c"), ("4", "b"))
    got = lambda *x: sorted(map(tuple, files.last_wins(list(x), "id").collect()), key=str)
    assert got(a, b, c) == sorted([("1", "a"), ("2", "c"), (None, None), ("3", None), ("4", "c")], key=str)
    assert got(c, b, a) == sorted([("1", "a"), ("2", "a"), (None, "a"), ("3", None), ("4", "c")], key=str)
    assert got(a, b.select("content", "id"))[1] == ("2", "bb") and got(a.limit(0)) == []
    with pytest.raises(ValueError):
        files.last_wins([], "id")


class Breaks:
    """A judge that dies at one pair, and fails at another."""

    def __init__(self, dies=None, fails=None):
        self.dies, self.fails = dies, fails

    def __call__(self):
        def judge(b):
            if self.dies in set(b["docid"]):
                raise RuntimeError("the judge is gone")
            raw = [labels.FAILED if d == self.fails else 1 for d in b["docid"]]
            return b[["qid", "docid", "type"]].assign(llm_label=[max(0, x) for x in raw], llm_raw_label=raw)

        return judge


def test_a_judge_that_breaks_half_way(spark, tmp_path):
    log = judgements.JudgementLog(spark, f"{tmp_path}/log")
    pairs = spark.createDataFrame([("q", f"d{k}", "original_pos") for k in range(40)] * 2, "qid string, docid string, type string")
    assert log.latest().count() == 0 and log.missing(pairs).count() == 40
    with pytest.raises(Exception, match="the judge is gone"):
        log.judge(pairs, Breaks(dies="d7", fails="d3"), batch_pairs=5)
    done = log.latest().where("llm_raw_label <> -1").count()
    before = log.entries().count()
    assert 0 < before < 40 and log.missing(pairs).count() == 40 - done
    got = log.judge(pairs, Breaks(fails="d11"), batch_pairs=5)
    assert {r.docid: r.llm_raw_label for r in got.collect()} == {f"d{k}": -1 if k == 11 and not log.entries().where("docid = 'd11' and llm_raw_label = 1").count() else 1 for k in range(40)}
    asked = log.entries().count() - before
    assert asked == 40 - done, "what was judged isn't asked again"
    assert log.judge(pairs, Breaks(), batch_pairs=50).where("llm_raw_label = 1").count() == 40
    assert log.entries().agg(F.countDistinct("seq"), F.max("seq")).first()[0] > 5
    count = log.entries().count()
    log.judge(pairs, Breaks(dies="d0"))
    assert log.entries().count() == count, "nothing is missing"
    log.append(spark.createDataFrame([("q", "d0", "original_pos", 0, 0)], judgements.SCHEMA))
    assert [r.llm_label for r in log.latest().where("docid = 'd0'").collect()] == [0], "the latest counts"


def test_dataset(spark, tmp_path, monkeypatch):
    docs = [{"docid": f"d{k}", "text": f'text {k} é  "{k}"', "more": k} for k in range(300)]
    (tmp_path / "corpus").mkdir()
    (tmp_path / "corpus" / "a.jsonl").write_text("\n".join(json.dumps(d, ensure_ascii=k % 2 == 0) for k, d in enumerate(docs[:200])) + "\n\n")
    with gzip.open(tmp_path / "corpus" / "b.jsonl.gz", "wt") as f:
        f.write("\n".join(json.dumps(d) for d in docs[200:]))
    (tmp_path / "corpus" / "_SUCCESS").write_text("")
    of = lambda *k: [{"docid": f"d{x}", "text": f"t{x}"} for x in k]
    lines = [{"qid": "q1", "query": "what", "pos": of(1, 2), "hard_neg": of(3)}, {"qid": "q2", "query": None, "pos": [], "hard_neg": []}, {"qid": "q3", "pos": None}]
    (tmp_path / "test_data.jsonl").write_text("\n".join(map(json.dumps, lines)))
    read = lambda table: sorted((tuple(r) for r in dataset.read(spark, str(tmp_path), table).collect()), key=str)
    assert read("corpus") == sorted(((d["docid"], d["text"]) for d in docs), key=str)
    assert read("queries") == sorted([("q1", "what"), ("q2", None), ("q3", None)], key=str)
    assert read("positives") == [("q1", "d1"), ("q1", "d2")] and read("negatives") == [("q1", "d3")]
    assert read("pairs") == [("q1", "d1", "original_pos"), ("q1", "d2", "original_pos")]
    assert [(q, p, n) for q, p, n in read("triplets")][1:] == [("q2", [], []), ("q3", None, None)]
    # Ranges that end anywhere, also within a line or at its end.
    reader = dataset.Reader(str(tmp_path), "corpus")
    for size in (1, 37, 64, 1 << 20):
        monkeypatch.setattr(dataset, "RANGE_BYTES", size)
        rows = [r for part in reader.partitions() for b in reader.read(part) for r in b.to_pylist()]
        assert sorted(r["docid"] for r in rows) == sorted(d["docid"] for d in docs)
    with pytest.raises(Exception, match="table is one of"):
        dataset.read(spark, str(tmp_path), "else")
    with pytest.raises(Exception, match="has no corpus"):
        dataset.read(spark, str(tmp_path / "corpus"), "corpus").collect()
