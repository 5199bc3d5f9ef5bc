"""Importance resampling towards a target text: documents that look like the target are drawn more often.

Features are runs of consecutive words, hashed into buckets. Two passes over the texts:

1. Every Arrow partition counts its features with np.bincount into one vector of `buckets` numbers; treeReduce merges the vectors.
   The target's texts are counted in the same way. A bucket's gain is floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))).
2. The gains (`buckets` numbers, whatever the data) are broadcast; each document sums those of its features with np.bincount, by
   row. Its weight is the floored mean; a Gumbel number from its id and the seed is added, and the highest scores are drawn.

The draw is a running count over ranges of Spark's range sort, so neither ties nor a hot id meet in one task.

Cases: a null or empty text has no features and the weight 0; a null doc_id counts as an empty id and as the smallest; repeated rows
are drawn one by one, and rows with one id have one random number; an empty table gives an empty one, and without a target or
documents the gains are those of counts of zero. Texts are read whole, in blocks that end between words. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, running, staged, text_bytes

BUCKETS, SEED, LEAST_WORDS, PERCENT = 10_000, 2024, 20, 10
#: Bytes of a text that are split into words at once.
BLOCK = 1 << 20
#: Vectors that one step of the tree merges.
FAN = 16
#: Features that wait for one np.bincount.
WAITING = 1 << 20

#: Words of a lower-cased text in UTF-8: letters a-z, digits and all beyond ASCII.
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_GAP = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]")


def word_blocks(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, A-Z lower-cased, block by block."""
    start = 0
    while start < len(text):
        end = start + BLOCK
        if end < len(text):
            gap = _GAP.search(text, end)
            end = gap.start() if gap else len(text)
        yield _WORD.findall(text[start:end].lower())
        start = end


def feature_buckets(text: bytes, run: int = 1, buckets: int = BUCKETS) -> Iterator[tuple[int, np.ndarray]]:
    """(new words, buckets of the features that end in them), block by block; features are runs of 1 to `run` words."""
    held: list[bytes] = []
    for words in word_blocks(text):
        new = len(words)
        features = words
        if run > 1:
            both = held + words
            features = [b" ".join(both[k - n : k]) for k in range(len(held) + 1, len(both) + 1) for n in range(1, run + 1) if n <= k]
            held = both[len(both) - run + 1 :] if len(both) >= run else both
        yield new, np.fromiter(map(zlib.crc32, features), np.uint32, len(features)) % np.uint32(buckets)


def counts(texts: DataFrame, run: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket's features stand in all of texts (text): a vector per partition, merged by treeReduce."""
    bound_batches(texts.sparkSession)

    def partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for text in text_bytes(b.column(0)):
                for _, found in feature_buckets(text, run, buckets):
                    total += np.bincount(found, minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["counts"])

    vectors = texts.select("text").mapInArrow(partition, "counts binary").rdd.map(lambda r: np.frombuffer(bytes(r["counts"]), np.int64))
    n = vectors.getNumPartitions()
    # Levels of the tree, so that the driver merges FAN vectors or so, whatever the number of partitions.
    return np.zeros(buckets, np.int64) if n == 0 else vectors.treeReduce(np.add, max(2, math.ceil(math.log(n, FAN))))


def gains(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log of how much likelier each bucket is in the target."""
    b, n, t = len(own), int(own.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((y + 1) * (n + b) / ((x + 1) * (t + b)))) for x, y in zip(own.tolist(), target.tolist(), strict=True)], np.int64)


def luck(doc_id: object, seed: int = SEED) -> int:
    """Thousandths of a Gumbel number, from the id and the seed alone."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighed(docs: DataFrame, gain: np.ndarray, run: int = 1, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of each document."""
    bound_batches(docs.sparkSession)
    buckets, shipped = len(gain), docs.sparkSession.sparkContext.broadcast(gain.astype(np.float64))

    def run_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worth = shipped.value
        for b in batches:
            n = b.num_rows
            words, features, sums = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
            rows, found = [], []

            def add() -> None:
                if rows:
                    at = np.repeat(np.array(rows), [len(x) for x in found])
                    np.add(features, np.bincount(at, minlength=n), out=features)
                    np.add(sums, np.bincount(at, worth[np.concatenate(found)], n), out=sums)  # whole numbers far below 2 ** 53: exact
                    rows.clear()
                    found.clear()

            waiting = 0
            for k, text in enumerate(text_bytes(b.column(1))):
                for new, at in feature_buckets(text, run, buckets):
                    words[k] += new
                    rows.append(k)
                    found.append(at)
                    waiting += len(at)
                    if waiting >= WAITING:
                        add()
                        waiting = 0
            add()
            weight = sums.astype(np.int64) // np.maximum(features, 1)
            score = weight + np.array([luck(x, seed) for x in b.column(0).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, (words, features, weight, score))], names=["doc_id", "n_words", "n_features", "weight", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run_, f"doc_id {kind}, n_words long, n_features long, weight long, score long")


def drawn(scores: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """Adds rank, 1, 2, 3 and so on along falling scores, to the best `percent` of a hundred rows of at least `least_words` words."""
    fit = (F.col("n_words") >= least_words).cast("long")
    rows = staged(scores.withColumns({"fit": fit, "_back": -F.col("score"), "_row": F.monotonically_increasing_id()}), "importance-scores")
    total, able = rows.agg(F.count("*"), F.coalesce(F.sum("fit"), F.lit(0))).first()
    placed = running(rows.withColumn("_unfit", 1 - F.col("fit")), [], ["_unfit", "_back", "doc_id", "_row"], "fit", "_place", total)
    taken = (F.col("fit") == 1) & (F.col("_place") <= percent * able // 100)
    return placed.withColumn("rank", F.when(taken, F.col("_place")).cast("long")).select(*scores.columns, "rank")


def resampled(docs: DataFrame, target: DataFrame, run: int = 1, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of docs (doc_id, text) drawn towards target (text)."""
    gain = gains(counts(docs, run, buckets), counts(target, run, buckets))
    return drawn(weighed(docs, gain, run, seed), percent, least_words)
