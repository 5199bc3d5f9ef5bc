"""A log of judgements in a folder, so that a judge that fails half-way is asked only for what is missing.

Each batch of pairs is one append, a folder seq=N whose number is above all before it; of a pair's judgements the latest counts. A batch whose
job fails leaves nothing that is read. Pairs whose latest judgement has failed, or that have none, are asked again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .labels import FAILED, labelled
from .staging import parts_for, staged

SCHEMA = "qid string, docid string, type string, llm_label int, llm_raw_label int"
KEY = ["qid", "docid", "type"]
#: Pairs that are judged and appended at once.
BATCH_PAIRS = 100_000


class JudgementLog:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def entries(self) -> DataFrame:
        """All judgements, with the seq of their batch."""
        try:
            found = self.spark.read.option("basePath", self.path).schema(f"{SCHEMA}, seq long").parquet(f"{self.path}/seq=*")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            found = self.spark.createDataFrame([], f"{SCHEMA}, seq long")
        return found

    def append(self, judged: DataFrame) -> int:
        """Appends judgements; returns their seq."""
        last = self.entries().agg(F.max("seq")).first()[0]
        seq = 0 if last is None else last + 1
        judged.select(*KEY, "llm_label", "llm_raw_label").write.mode("overwrite").parquet(f"{self.path}/seq={seq}")  # what an aborted job left has no rows
        return seq

    def latest(self) -> DataFrame:
        """The last judgement of each pair; within a batch, one that hasn't failed, and then the larger label."""
        answer = F.struct("llm_label", "llm_raw_label")
        order = F.struct("seq", F.col("llm_raw_label"), F.col("llm_label"))
        best = self.entries().groupBy(*KEY).agg(F.max_by(answer, order).alias("_a"))
        return best.select(*KEY, "_a.llm_label", "_a.llm_raw_label")

    def missing(self, pairs: DataFrame) -> DataFrame:
        """Of pairs (qid, docid, type), each once, those without a judgement that hasn't failed."""
        done = self.latest().where(F.col("llm_raw_label") != FAILED)
        return pairs.select(*KEY).distinct().join(done.select(*KEY), KEY, "left_anti")

    def judge(self, pairs: DataFrame, labeler: Callable[[], Callable], batch_pairs: int = BATCH_PAIRS) -> DataFrame:
        """Judges what is missing, batch by batch, and returns latest() of the pairs. labeler makes the judge once per task."""
        todo = staged(self.missing(pairs), "missing-pairs")
        n = parts_for(todo.count(), batch_pairs, 0)
        for b in range(n):
            some = todo.where(F.pmod(F.xxhash64(*KEY), F.lit(n)) == b)
            self.append(labelled(some, labeler, SCHEMA))
        return pairs.select(*KEY).distinct().join(self.latest(), KEY)
