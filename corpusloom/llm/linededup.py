"""Line dedup: lines that stand on many sites are boilerplate and stay only where they come first.

A sketch of its sites (HyperLogLog) per line hash is built and merged by aggregation, so a line that stands everywhere is
still one small row per task. Lines whose estimate is within NEAR of the threshold get an exact count of distinct sites;
further away, twenty standard errors of the sketch, the estimate decides. A boilerplate line keeps its first place (the
smallest doc_id, then the smallest position) and goes from all others.

Defined results: lines are split at \\n and compared as they are, line ends of \\r\\n included; lines without a word stay; a
null source is a site of its own; of fewer than twenty sites a share is enough, three of them at least; a null text stays null and has no lines; repeated rows of the first document all keep the
line; a null doc_id comes before others; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from .common import WORD, bound_batches, columns_of, map_positions, staged, unused, worker_state

#: Sites on which a line is boilerplate: SHARE of all sites, but LEAST_SITES at least and MOST_SITES at most, as a line on so many is
#: boilerplate however many sites there are.
SHARE, LEAST_SITES, MOST_SITES = 0.4, 3, 8
#: Share of the threshold within which estimates are checked, and the sketch's log2 of registers (error 1.6 %).
NEAR, SKETCH_K = 0.33, 12
#: Boilerplate hashes that are broadcast at most (16 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 100_000


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, site, pos, line): a row per line with a word, as its hash."""
    each = docs.select(
        "doc_id",
        F.xxhash64("text").alias("text_hash"),
        F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("site"),
        F.posexplode(F.split("text", "\n")).alias("pos", "_line"),
    )
    return each.where(F.col("_line").rlike(WORD)).select("doc_id", "text_hash", "site", "pos", F.xxhash64("_line").alias("line"))


def threshold(docs: DataFrame) -> int:
    """The number of sites that makes a line boilerplate in these documents. Reads their sources only."""
    sites = docs.agg((F.countDistinct("source") + F.max(F.col("source").isNull().cast("long"))).alias("n")).first()["n"] or 0
    return max(LEAST_SITES, min(MOST_SITES, ceil(SHARE * sites)))


def boilerplate(rows: DataFrame, min_sites: int) -> DataFrame:
    """rows: lines(). (line, first): hashes of lines on at least min_sites sites, and the (doc_id, pos) that keeps them."""
    sketches = rows.groupBy("line").agg(F.hll_sketch_agg("site", F.lit(SKETCH_K)).alias("sites"), F.min(F.struct("doc_id", "pos")).alias("first"))
    spread = staged(sketches.select("line", "first", F.hll_sketch_estimate("sites").alias("estimate")).where(F.col("estimate") >= min_sites * (1 - NEAR)), "line-spread")
    near = spread.where(F.col("estimate") < min_sites * (1 + NEAR))
    exact = rows.join(_sized(near.select("line")), "line", "left_semi").groupBy("line").agg(F.countDistinct("site").alias("sites")).where(F.col("sites") >= min_sites)
    sure = spread.where(F.col("estimate") >= min_sites * (1 + NEAR))
    return staged(sure.unionByName(near.join(exact.select("line"), "line", "left_semi")).select("line", "first"), "boilerplate")


def _sized(small: DataFrame) -> DataFrame:
    """Broadcast if a count shows that it is small; otherwise the join shuffles and skewed lines are split."""
    return F.broadcast(small) if small.count() <= BROADCAST_ROWS else small


def remove_boilerplate(docs: DataFrame, min_sites: int | None = None, counts: bool = False) -> DataFrame:
    """The rows, with all their columns, without boilerplate lines, those on min_sites sites (threshold() where none are given); n_chars,
    where there is one, follows the text.

    A document all of whose lines with a word go is dropped. With counts, all rows stay, and n_lines (lines with a word) and
    n_removed are added.
    """
    bound_batches(docs.sparkSession)
    rows = lines(docs)
    known = boilerplate(rows, threshold(docs) if min_sites is None else min_sites)
    here = rows.join(_sized(known), "line").where(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("pos") == F.col("first.pos"))))
    gone_, id_, hash_ = unused(docs, "gone", "id", "hash")
    gone = here.groupBy(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_)).agg(F.collect_set("pos").alias(gone_))
    texts = docs.join(gone, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.xxhash64("text") == F.col(hash_)), "left").select(*columns_of(docs), gone_)
    at, n = docs.columns.index("text"), len(docs.columns)
    chars = docs.columns.index("n_chars") if "n_chars" in docs.columns else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("linededup")
        for b in batches:
            texts, keep, held, removed = [], [], [], []
            for text, gone in zip(b.column(at).to_pylist(), b.column(n).to_pylist(), strict=True):
                if counts or gone:
                    parts = (text or "").split("\n")
                    full = [k for k, x in enumerate(parts) if x.strip(" \t\n\x0b\x0c\r")]
                    out = set(gone or ())
                    held.append(len(full))
                    removed.append(len(out))
                    keep.append(counts or len(out) < len(full))
                    texts.append("\n".join(x for k, x in enumerate(parts) if k not in out) if gone else text)
                else:
                    keep.append(True)
                    texts.append(text)
            columns = [b.column(k) for k in range(n)]
            columns[at] = pa.array(texts, columns[at].type)
            if chars >= 0:
                columns[chars] = pa.array([len(t) if g else old for t, g, old in zip(texts, b.column(n).to_pylist(), columns[chars].to_pylist(), strict=True)], columns[chars].type)
            if counts:
                columns += [pa.array(held, pa.int64()), pa.array(removed, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[f"c{k}" for k in range(len(columns))]).filter(pa.array(keep, pa.bool_()))

    more = [StructField("n_lines", LongType()), StructField("n_removed", LongType())][: 2 * counts]
    return map_positions(texts, run, [*docs.schema.fields, *more])
