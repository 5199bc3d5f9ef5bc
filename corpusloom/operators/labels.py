"""Relabelling: which pairs to judge, what the judgements change, and the benchmark made anew.

Pairs: (qid, docid, type, llm_label, llm_raw_label), type one of TYPES; a raw label of -1 is a failed judgement.
Triplets: (qid, pos, hard_neg), both arrays of struct<docid, text>.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values.
TYPES = ("original_pos", "potential_pos", "false_hard_neg")
FAILED = -1


def label_counts(pairs: DataFrame) -> DataFrame:
    """One row of eight counts."""
    of = lambda kind, label=None: F.count_if((F.col("type") == kind) & (F.lit(True) if label is None else F.coalesce(F.col("llm_label") == label, F.lit(False))))
    return pairs.agg(
        F.count("*").alias("total_pairs"),
        F.count_if(F.col("llm_raw_label") == FAILED).alias("failed_pairs"),
        of("original_pos").alias("original_pos_pairs"),
        of("original_pos", 0).alias("bad_original_pos_pairs"),
        of("potential_pos").alias("potential_pos_pairs"),
        of("potential_pos", 1).alias("real_potential_pos_pairs"),
        of("false_hard_neg").alias("false_hard_neg_pairs"),
        of("false_hard_neg", 1).alias("real_false_hard_neg_pairs"),
    )


def split(pairs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(bad originals, real potential positives, real false hard negatives)."""
    bad, real, false = (pairs.where((F.col("type") == t) & (F.col("llm_label") == label)) for t, label in zip(TYPES, (0, 1, 1), strict=True))
    return bad, real, false


def to_label(pairs: DataFrame, old: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(pairs to judge, finished pairs): without old judgements all; else those that failed."""
    if old is None:
        return pairs, pairs.sparkSession.createDataFrame([], "qid string, docid string, type string, llm_label int, llm_raw_label int")
    return old.where(F.col("llm_raw_label") == FAILED), old.where(F.col("llm_raw_label") != FAILED)


def resumed(old: DataFrame, new: DataFrame) -> DataFrame:
    """Finished judgements and the new ones."""
    return old.where(F.col("llm_raw_label") != FAILED).unionByName(new)


def labelled(pairs: DataFrame, labeler: Callable[[], Callable], schema: str) -> DataFrame:
    """Judges pairs in pandas batches; labeler makes the judge once per task."""

    def run(batches: Iterator) -> Iterator:
        judge = labeler()
        for b in batches:
            yield judge(b)

    return pairs.mapInPandas(run, schema)


def from_table(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The default judge: labels (qid, docid, llm_label); a pair without one has failed."""
    known = labels.select("qid", "docid", F.col("llm_label").alias("_l"))
    return pairs.drop("llm_label", "llm_raw_label").join(known, ["qid", "docid"], "left").select("*", F.coalesce("_l", F.lit(0)).cast("int").alias("llm_label"), F.coalesce("_l", F.lit(FAILED)).cast("int").alias("llm_raw_label")).drop("_l")


def rerank_filter(runs: list[DataFrame], positives: DataFrame, hard_negatives: DataFrame, pos_rank: int = 10, neg_rank: int = 20) -> DataFrame:
    """(qid, docid, type): unlabelled documents that every run has within pos_rank are potential positives; hard negatives that
    every run has within neg_rank may be false ones."""
    each = None
    for r in runs:
        one = r.groupBy("qid", "docid").agg(F.min("rank").alias("rank"))
        each = one if each is None else each.unionByName(one)
    worst = each.groupBy("qid", "docid").agg(F.max("rank").alias("worst"), F.count("*").alias("n")).where(F.col("n") == len(runs))
    worst = worst.where(F.col("worst") <= max(pos_rank, neg_rank))
    # The labelled pairs can be far more than the hits: they stream past these, and are neither sorted nor aggregated.
    marked = positives.select("qid", "docid", F.lit(False).alias("hard")).unionByName(hard_negatives.select("qid", "docid", F.lit(True).alias("hard")))
    marked = marked.join(worst.select("qid", "docid").hint("shuffle_hash"), ["qid", "docid"], "left_semi")
    found = worst.join(marked.groupBy("qid", "docid").agg(F.max("hard").alias("hard")), ["qid", "docid"], "left")
    potential = F.when(F.col("hard").isNull() & (F.col("worst") <= pos_rank), TYPES[1])
    false = F.when(F.col("hard") & (F.col("worst") <= neg_rank), TYPES[2])
    return found.select("qid", "docid", F.coalesce(potential, false).alias("type")).where("type is not null")


def all_pairs(positives: DataFrame, filtered: DataFrame) -> DataFrame:
    """All pairs to judge: original positives, potential positives and suspected negatives."""
    return positives.select("qid", "docid", F.lit(TYPES[0]).alias("type")).unionByName(filtered.select("qid", "docid", "type"))


def new_corpus(corpus: DataFrame, pairs: DataFrame) -> DataFrame:
    """corpus (docid, text) without the false hard negatives, whichever query they were found for."""
    return corpus.join(split(pairs)[2].select("docid").distinct(), "docid", "left_anti")


def new_triplets(triplets: DataFrame, pairs: DataFrame, corpus: DataFrame) -> DataFrame:
    """Triplets of queries without a bad original: potential positives join pos, false hard negatives leave hard_neg."""
    bad, real, false = split(pairs)
    gone = false.select("docid").distinct()
    kept = triplets.join(bad.select("qid").distinct(), "qid", "left_anti")
    added = real.select("qid", "docid").join(gone, "docid", "left_anti").join(corpus.select("docid", "text"), "docid")
    added = added.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("docid", "text"))).alias("_more"))
    negatives = kept.select("qid", F.posexplode("hard_neg").alias("_n", "h")).withColumn("docid", F.col("h.docid")).join(gone, "docid", "left_anti")
    negatives = negatives.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("_n", "h"))).alias("_left"))
    rows = kept.join(added, "qid", "left").join(negatives, "qid", "left")
    none = F.expr("cast(array() as array<struct<docid:string,text:string>>)")
    return rows.select("qid", F.concat("pos", F.coalesce("_more", none)).alias("pos"), F.coalesce(F.transform("_left", lambda x: x["h"]), none).alias("hard_neg"))


def new_qrels(triplets: DataFrame) -> DataFrame:
    """(qid, docid, relevance): positives 1, hard negatives 0."""
    pos = triplets.select("qid", F.explode("pos.docid").alias("docid"), F.lit(1).alias("relevance"))
    neg = triplets.select("qid", F.explode("hard_neg.docid").alias("docid"), F.lit(0).alias("relevance"))
    return pos.unionByName(neg)
