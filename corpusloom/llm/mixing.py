"""Mixing sources to target weights by weighted fair queueing. DataFrame functions only.

Every source queues its documents in a shuffled order that depends on their ids alone. A document's virtual finish
time is the number of its source's words up to and including it, divided by the source's target. All entries are
sorted by that time, whatever their source, and taken until the total budget is used.

Defined results: a null or empty text has size 0 and is never taken; a null source is a source of its own and comes
last; repeated rows are queued one by one, and each is given what it takes itself; rows with one id are queued by size and text;
an empty table gives an empty one. Further columns of the input are ignored by mixed() and kept by take_mix().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import columns_of, n_words, running, staged, unused


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """sizes: (source, source_size), a row per source. Adds target.

    Sources by code point, null last, have the weights in turn and share `share` of all words; no target exceeds `most`
    times its source, and what is above goes to the others by weight until none is above. That is a water level: with
    sources ordered by cap / weight, the first k are capped and the rest get level * weight.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    by_fill = W.orderBy("_fill", "_n")
    rows = (
        sizes.withColumn("_n", F.row_number().over(by_name))
        .withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_n") - 1) % len(weights) + 1))
        .withColumn("_cap", F.col("source_size") * float(most))
        .withColumn("_fill", F.col("_cap") / F.col("_w"))
        .withColumn("_all", F.sum("source_size").over(W.partitionBy()) * F.lit(share))
        .withColumn("_capped", F.coalesce(F.sum("_cap").over(by_fill.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("_rest", F.sum("_w").over(by_fill.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("_level", (F.col("_all") - F.col("_capped")) / F.col("_rest"))
        .withColumn("_level", F.max(F.when(F.col("_level") <= F.col("_fill"), F.col("_level"))).over(W.partitionBy()))
    )
    target = F.least(F.col("_cap"), F.coalesce(F.col("_level") * F.col("_w"), F.col("_cap")))
    return rows.select("source", "source_size", target.alias("target"), F.col("_all").alias("budget"))


def sized(docs: DataFrame, row: Column | None = None, seed: str = "") -> DataFrame:
    """(row, doc_id, source, skey, size, turn, hash): turn is the place in the source's shuffled queue, from the id alone."""
    return docs.select(
        (F.monotonically_increasing_id() if row is None else row).alias("row"),
        F.col("doc_id"),
        F.col("source"),
        F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("skey"),
        n_words(F.col("text")).alias("size"),
        F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(seed))), 1, 15), 16, 10).cast("long").alias("turn"),
        F.xxhash64("text").alias("hash"),
    )


def fair_queue(rows: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2) -> tuple[DataFrame, DataFrame]:
    """rows: sized(), staged. Returns (the mix, the sources' targets).

    The mix has a row per taken entry: row, doc_id, source, pass, size, finish (virtual time) and ends (the mix's words
    up to and including it), which orders it.
    """
    sources = rows.groupBy("skey", "source").agg(F.sum("size").alias("source_size"))
    targets = staged(source_targets(sources, weights, share, most).withColumn("skey", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))), "mix-targets")
    queue = rows.where("size > 0")
    n = queue.count()
    place = ["turn", "doc_id", "size", "hash", "row"]
    queue = running(queue, ["skey"], place, "size", "_served", n)
    queue = queue.join(targets.select("skey", "source_size", "target", "budget"), "skey").where("target > 0")
    entries = queue.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(most - 1)))).withColumn("finish", (F.col("pass") * F.col("source_size") + F.col("_served")) / F.col("target"))
    mix = running(staged(entries, "mix-entries"), [], ["finish", "skey", "pass", *place], "size", "ends", most * n).where("ends <= budget")
    return mix.select("row", "doc_id", "source", "pass", "size", "finish", "ends"), targets


def mixed(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """A row per document: doc_id, source, size, source_size, target, taken (words that the mix takes, repeats counted)."""
    rows = staged(sized(docs), "mix-sizes")
    mix, targets = fair_queue(rows, weights, share, most)
    taken = mix.groupBy("row").agg(F.sum("size").alias("taken"))
    return (
        rows.join(targets.select("skey", "source_size", "target"), "skey")
        .join(taken, "row", "left")
        .select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    )


def take_mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """The mix itself: the documents' own rows, with all their columns, each as often as it is taken."""
    row_, times_, copy_ = unused(docs, "row", "times", "copy")
    held = staged(docs.select(*columns_of(docs), F.monotonically_increasing_id().alias(row_)), "mix-texts")
    mix, _ = fair_queue(staged(sized(held, F.col(row_)), "mix-sizes"), weights, share, most)
    times = mix.groupBy(F.col("row").alias(row_)).agg(F.count("*").cast("int").alias(times_))
    return held.join(times, row_).withColumn(copy_, F.explode(F.sequence(F.lit(1), F.col(times_)))).select(*columns_of(docs))
