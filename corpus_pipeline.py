"""The corpus pipeline: quality rules, line dedup, SimHash near-dedup, mixing of sources, byte-level BPE.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns the columns of documents;
the last returns the tokens. run() writes each stage's rows as Parquet in the shared folder and reads them again.

Common to all stages: further columns, whatever their names, are kept by all but the last; a null text is an empty one; an empty
table gives an empty one; results depend neither on partitions nor on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import bpe, entries, linededup, mixing, nearcopies, quality
from corpusloom.llm.common import staged


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality rules reject: texts of fewer than 50 words (null and empty ones too), and repetitive ones.
    Repeated rows are judged one by one, and so are rows with one id. Texts of any length are judged whole."""
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes lines that stand on many sites out of all but the first document; drops documents left without a line.

    The first is that of the smallest doc_id, null before others; repeated rows of it all keep the line. A null source is a site of
    its own. Lines without a word stay. n_chars follows the text."""
    return linededup.remove_boilerplate(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the smallest id, of each group of near copies: five-word similarity 0.8 or more.
    Candidates are SimHashes that meet in BK-trees and sets that share one of their first runs; each is checked on the whole sets.

    Null ids come last; of rows that tie in id and text one stays, whatever their other columns; null and empty texts are copies of
    each other."""
    return nearcopies.keep_one(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, each as often as it is taken: never, once or twice.

    Texts without a word are never taken; a null source is a source of its own; rows that tie in id are queued by size and text, and
    repeated rows one by one, each with what it is given itself."""
    return mixing.take_mix(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document, with digests of the ids and of what they decode to. A row for each row, repeats included; a
    text without a character has no tokens. Only doc_id and source are kept beside them."""
    return bpe.tokenize(docs, *entries.byte_bpe(), keep=["doc_id", "source"], outputs=["n_tokens", "ids", "ids_sha256", "decoded_sha256"])


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("simhash near-dedup", simhash_dedup), ("source mix", source_mix), ("byte bpe", byte_bpe)]

#: Suffix arrays, SimHash components and BPE have no SQL; tests/llm checks run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to the documents in sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, f"pipeline-{name.replace(' ', '-')}")
    return docs
