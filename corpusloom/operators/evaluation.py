"""Retrieval quality: nDCG@k, recall@k and averages over languages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def parse_metric(name: str) -> tuple[str, int]:
    """`ndcg@10` as (ndcg, 10)."""
    kind, _, k = name.partition("@")
    if kind not in ("ndcg", "recall") or not k.isdigit() or int(k) < 1:
        raise ValueError(f"unknown metric {name}")
    return kind, int(k)


def by_score(run: DataFrame) -> DataFrame:
    """Ranks anew by score, ties by descending docid, as the usual evaluation tool does; the run's own ranks don't count."""
    return run.withColumn("place", F.row_number().over(W.partitionBy("qid").orderBy(F.col("score").desc(), F.col("docid").desc())))


def _gain(relevance: Column, place: Column) -> Column:
    return relevance / F.log2(place + F.lit(1.0))


def all_per_query(run: DataFrame, qrels: DataFrame, metrics: list[str]) -> DataFrame:
    """(qid, metric, score) for each query with a relevant document, 0 for one that the run lacks. The run is ranked once for all metrics."""
    wanted = [(m, *parse_metric(m)) for m in ([metrics] if isinstance(metrics, str) else metrics)]
    deepest = max(k for _, _, k in wanted)
    relevant = qrels.where("relevance > 0").select("qid", "docid", F.col("relevance").cast("double").alias("relevance"))
    found = by_score(run.select("qid", "docid", "score")).where(F.col("place") <= deepest).join(relevant, ["qid", "docid"])
    ideal = relevant.withColumn("place", F.row_number().over(W.partitionBy("qid").orderBy(F.col("relevance").desc(), "docid")))
    within = lambda value, k: F.sum(F.when(F.col("place") <= k, value))
    gain = _gain(F.col("relevance"), F.col("place"))
    best = ideal.groupBy("qid").agg(F.count("*").alias("n"), *(within(gain, k).alias(f"_best{i}") for i, (_, _, k) in enumerate(wanted)))
    got = found.groupBy("qid").agg(*(F.coalesce(within(gain if kind == "ndcg" else F.lit(1.0), k), F.lit(0.0)).alias(f"_got{i}") for i, (_, kind, k) in enumerate(wanted)))
    ratio = lambda i, kind: F.coalesce(f"_got{i}", F.lit(0.0)) / F.col("n" if kind == "recall" else f"_best{i}")
    each = F.array(*(F.struct(F.lit(m).alias("metric"), ratio(i, kind).alias("score")) for i, (m, kind, _) in enumerate(wanted)))
    return best.join(got, "qid", "left").select("qid", F.explode(each).alias("e")).select("qid", "e.metric", "e.score")


def per_query(run: DataFrame, qrels: DataFrame, metric: str) -> DataFrame:
    """(qid, score) for each query with a relevant document; one that the run lacks scores 0."""
    return all_per_query(run, qrels, [metric]).select("qid", "score")


def evaluate(run: DataFrame, qrels: DataFrame, metrics: list[str]) -> DataFrame:
    """(metric, score): means over the queries."""
    return all_per_query(run, qrels, metrics).groupBy("metric").agg(F.avg("score").alias("score"))


def macro(scores: DataFrame) -> DataFrame:
    """scores (lang, metric, score): with rows of lang `average`, the mean over languages; null if a language has none."""
    mean = scores.groupBy("metric").agg(F.when(F.count("score") == F.count("*"), F.avg("score")).alias("score"))
    return scores.select("lang", "metric", "score").unionByName(mean.select(F.lit("average").alias("lang"), "metric", "score"))


def at_level(chunk_run: DataFrame, doc_run: DataFrame | None) -> DataFrame:
    """The document run where there is one."""
    return chunk_run if doc_run is None else doc_run
