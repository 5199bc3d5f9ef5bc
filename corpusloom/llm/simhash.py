"""SimHash near-duplicates: fingerprints, links found in BK-trees, and connected components.

Fingerprints within `radius` bits agree on at least one of radius + 1 bands of their bits, so each distinct fingerprint
goes to one shard per band, keyed by the band's bits, and every link lies within a shard. A shard's fingerprints form a
BK-tree (children keyed by their distance to the parent) and each looks for its partners in it, following only edges
within the radius. The tree is built where its queries are: broadcasting all trees would grow with the data. A shard of
more than SHARD fingerprints is divided again by bands of its free bits, which again loses no link; as fingerprints in a
shard are distinct, shards run out after a few rounds. A shard gives a spanning forest of its links, and not all pairs.

Defined results: a null or empty text has fingerprint zero and is linked like any other; a null doc_id is never the
smallest of its component unless all are null; repeated rows each give a row; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bound_batches, columns_of, staged, text_bytes, unused, worker_state

SHINGLE, RADIUS, SEED = 3, 2, 42
#: Most fingerprints in one tree.
SHARD = 4096


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the lower-cased words' shingles, repeats included."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    digest, join, n = xxhash.xxh64_intdigest, b" ".join, len(words) - shingle + 1
    hashes = np.fromiter((digest(join(x), SEED) for x in zip(*(words[k:] for k in range(shingle)), strict=False)), np.dtype(">u8"), n)
    return fingerprint_of(hashes)


def fingerprint_of(hashes: np.ndarray) -> int:
    """64-bit SimHash of hashes, big-endian unsigned."""
    n, ones = len(hashes), np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, text_hash): fp holds the 64 bits as a long; text_hash is xxhash64 of the text, null as empty."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("simhash")
        for b in batches:
            texts = text_bytes(b.column(1))
            prints = np.array([fingerprint(t, shingle) for t in texts], np.uint64)
            hashes = np.array([xxhash.xxh64_intdigest(t, SEED) for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints.view(np.int64)), pa.array(hashes.view(np.int64))], names=["doc_id", "fp", "text_hash"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long, text_hash long")


class BKTree:
    """Distinct integers under Hamming distance."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def search(self, value: int, radius: int) -> list[int]:
        """Numbers of the values within radius."""
        found, open_ = [], [0] if self.values else []
        values, children = self.values, self.children
        while open_:
            at = open_.pop()
            d = (values[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            edges = children[at]
            if len(edges) <= 2 * radius + 1:
                open_.extend(child for k, child in edges.items() if -radius <= k - d <= radius)
            else:
                open_.extend(edges[k] for k in range(d - radius, d + radius + 1) if k in edges)
        return found

    def add(self, value: int) -> int:
        number = len(self.values)
        self.values.append(value)
        self.children.append({})
        at = 0
        while at != number:
            at = self.children[at].setdefault((self.values[at] ^ value).bit_count(), number)
        return number


def forest(values: list[int], radius: int, direct: bool = False) -> list[tuple[int, int]]:
    """(value, root) for each value linked to others, but for the roots themselves: a spanning forest of the links. direct: the forest's
    own links instead, (value, earlier value) within the radius."""
    tree, root, joined = BKTree(), list(range(len(values))), []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for value in values:
        near = tree.search(value, radius)
        number = tree.add(value)
        for other in near:
            a, b = sorted((find(other), find(number)))
            if a != b:
                joined.append((value, values[other]))
            root[b] = a
    if direct:
        return joined
    return [(v, values[r]) for k, v in enumerate(values) if (r := find(k)) != k]


def _bands(free: list[int], n: int) -> list[list[int]]:
    cuts = [len(free) * k // n for k in range(n + 1)]
    return [free[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def _signed(bits: list[int]) -> int:
    x = sum(1 << b for b in bits)
    return x - (1 << 64) if x >> 63 else x


def links(prints: DataFrame, radius: int = RADIUS, shard: int = SHARD, direct: bool = False) -> DataFrame:
    """prints: distinct fp, staged. (a, b): a spanning forest of each shard's links, as forest() gives it."""
    spark = prints.sparkSession
    out = None
    #: Paths of bands chosen so far, with the bits that are still free.
    paths = {0: list(range(64))}
    rows = prints.select(F.lit(0).alias("path"), "fp")
    while paths:
        grown: dict[int, list[int]] = {}
        keys: dict[int, list[Column]] = {}
        for path, free in paths.items():
            for k, band in enumerate(_bands(free, radius + 1)):
                child = path * (radius + 1) + k + 1
                grown[child] = [b for b in free if b not in band]
                fixed = [b for b in range(64) if b not in grown[child]]
                keys.setdefault(path, []).append(F.struct(F.lit(child).alias("path"), F.col("fp").bitwiseAND(F.lit(_signed(fixed))).alias("key")))
        to = F.array(*keys[0]) if list(paths) == [0] else F.coalesce(*[F.when(F.col("path") == p, F.array(*k)) for p, k in keys.items()])
        rows = rows.select("fp", F.explode(to).alias("to")).select("to.path", "to.key", "fp")
        sizes = staged(rows.groupBy("path", "key").agg(F.count("*").alias("n")).where("n > 1"), "simhash-shards")
        small = rows.join(sizes.where(F.col("n") <= shard).select("path", "key"), ["path", "key"])
        found = _search(small, radius, direct)
        out = found if out is None else out.unionByName(found)
        big = {r.path for r in sizes.where(F.col("n") > shard).select("path").distinct().collect()}  # paths, at most (radius + 1) ** rounds
        paths = {p: grown[p] for p in big}
        if paths:
            rows = staged(rows.join(sizes.where(F.col("n") > shard).select("path", "key"), ["path", "key"]).select("path", "fp").distinct(), "simhash-big")
    return out if out is not None else spark.createDataFrame([], "a long, b long")


def _search(rows: DataFrame, radius: int, direct: bool = False) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("simhash")
        now, held = None, []

        def flush() -> pa.RecordBatch:
            pairs = forest(held, radius, direct)
            return pa.RecordBatch.from_arrays([pa.array(np.array([p[k] for p in pairs], np.uint64).view(np.int64)) for k in (0, 1)], names=["a", "b"])

        for b in batches:
            for path, key, fp in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_numpy().view(np.uint64).tolist(), strict=True):
                if (path, key) != now:
                    if len(held) > 1:
                        yield flush()
                    now, held = (path, key), []
                held.append(fp)
        if len(held) > 1:
            yield flush()

    return rows.repartition("path", "key").sortWithinPartitions("path", "key", "fp").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the smallest node of node's component, for the nodes of edges (a, b) that aren't roots.

    Alternating large and small stars: rounds grow with the logarithm of the nodes. Each round is a table in the shared folder.
    """
    edges = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges = staged(small.select("e.a", "e.b").where("a <> b").distinct(), "components")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, text_hash, root, component_id) for each row: component_id is the smallest doc_id reachable over links, root a
    fingerprint that names the component."""
    prints = staged(fingerprints(docs, shingle), "simhash-prints")
    each = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = components(links(each, radius))
    of = each.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = of.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(of.join(smallest, "root").select("fp", "root", "component_id"), "fp").select("doc_id", "fp", "text_hash", "root", "component_id")


def hex_print(fp: Column) -> Column:
    """16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row, with all its columns, of each component: that of the smallest doc_id (nulls last), then the smallest text hash."""
    return keep_least(docs, near_duplicates(docs, shingle, radius))


def keep_least(docs: DataFrame, found: DataFrame) -> DataFrame:
    """keep_one() for groups found: (doc_id, text_hash, root) for each row."""
    id_, hash_, place_ = unused(docs, "id", "hash", "place")
    least = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("k"))
    # Null ids in structs are equal, so that join and window ask for the same keys, and texts are shuffled once.
    least = least.select(F.struct("k.doc_id").alias(id_), F.col("k.text_hash").alias(hash_))
    kept = docs.withColumns({id_: F.struct("doc_id"), hash_: F.xxhash64(F.coalesce(F.col("text"), F.lit("")))}).join(least, [id_, hash_])
    # Rows that repeat both are the same document.
    order = W.partitionBy(id_, hash_).orderBy(F.lit(0))
    return kept.withColumn(place_, F.row_number().over(order)).where(F.col(place_) == 1).select(*columns_of(docs))
