"""Near copies by SimHash and BK-trees, checked by the exact similarity of their word runs; then every pair that is left.

A text is the set of its lower-cased runs of SHINGLE words (a shorter text is one run); texts are linked whose sets have Jaccard
similarity LEAST or more, and components of links are groups. Candidates are first those that op8's method gives: sets whose 64-bit
SimHashes differ in RADIUS bits or fewer, found in BK-trees over bands of bits. At 0.8 two SimHashes differ in some 10 bits, which no
bands find without loss, so the others don't depend on them: with one order of all runs, sets this similar share one of the first
n - ceil(0.8 n) + 1 of their n runs. The order puts runs that are frequent in a sample last, so that sets which share a shard, a
run, are few; any order loses nothing. The sample is a share of the table, so that no run of some thousand texts is missed, whatever the
table's size. Shards of runs that are frequent all the same are dealt to as many lots as their size asks for. In a shard, neighbours in the order of the fingerprint, turned four ways, are compared
first, which joins large groups by a linear number of pairs; then, of the sets in a shard, those outside its largest group are
compared with all that are not in their own group. Each candidate is checked on the whole sets. What keeps the second step from all pairs of a group are a set's own runs: one of its first runs that
is no other set's first run, and comes before the last of the other set's first runs, is not in the other set at all. Copies with
many changes have many of these, and pairs whose own runs leave less than the least similarity are never made. Neither are pairs
that differ in more lanes than similar sets differ in runs: a lane is one bit, whether an odd number of runs falls into it.

Defined results: null and empty texts are the empty set and equal; equal sets are linked; a null doc_id is kept only where all of
a group are null; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bound_batches, staged, text_bytes, worker_state
from .simhash import SEED, components, fingerprint_of, keep_least, links

# The stage's parameters: words of a run, and the least similarity as a fraction.
SHINGLE, LEAST = 5, (4, 5)
#: Bits in which the SimHashes of sets differ at most that meet in a BK-tree: four bands of 16 bits lose none of these.
RADIUS = 3
#: Texts in the sample that gives the order, or one in SAMPLED of the table if that is more; how many of them must have a run for it
#: to count as frequent; and the runs that the order goes by, the most frequent ones, 16 bytes each in a broadcast.
SAMPLE, SAMPLED, FREQUENT, MOST_FREQUENT = 10_000, 1000, 4, 1_000_000
#: Sets of a shard that one lot may be expected to hold.
LOT = 2000
#: Turns of the fingerprint, in bits, by which a shard's sets are put in order.
TURNS = (0, 16, 32, 48)
#: Lanes, by a number of a run's highest bits, and the 64-bit words that hold them.
LANE_BITS = 10
LANE_WORDS = (1 << LANE_BITS) // 64
#: Bits, at most, of the map by which a task tells the texts that are asked for (8 MB), and bits of one of its blocks, as Spark cuts it.
MARKS, BLOCK = 1 << 26, 1 << 15


_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def runs(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of the text's runs of words, repeats included: words are hashed one by one, and their hashes folded in order."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    each = np.fromiter((digest(w, SEED) for w in words), np.uint64, len(words))
    width = min(shingle, len(words))
    out = np.full(len(words) - width + 1, width, np.uint64)
    for k in range(width):
        out = (out ^ each[k : k + len(out)]) * _A
        out ^= out >> np.uint64(32)
    out *= _B
    return out ^ out >> np.uint64(29)


def lanes(held: np.ndarray) -> np.ndarray:
    """The lanes of a set, as LANE_WORDS numbers: sets whose lanes differ in k bits differ in k runs at least."""
    odd = np.bincount((held >> np.uint64(64 - LANE_BITS)).astype(np.int64), minlength=1 << LANE_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _name(held: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(held.tobytes(), SEED)


def _sets(texts: list[bytes]) -> tuple[list[np.ndarray], list[pa.Array]]:
    """Each text's set in order, and columns: the set's name, its SimHash and its size."""
    held = [np.unique(runs(t)) for t in texts]
    names = [_name(h) for h in held]
    prints = [fingerprint_of(h.astype(">u8")) for h in held]
    longs = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (names, prints)]
    return held, [*longs, pa.array([len(h) for h in held], pa.int32())]


def sets_of(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, sid, fp, n, lanes, runs): sid names the set, fp is its SimHash, runs are its n hashes in order, as bytes."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("nearcopies")
        for b in batches:
            texts = text_bytes(b.column(1))
            held, columns = _sets(texts)
            hashes = pa.array(np.array([xxhash.xxh64_intdigest(t, SEED) for t in texts], np.uint64).view(np.int64))
            apart = pa.array([lanes(h) for h in held], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), hashes, *columns, apart, pa.array([h.tobytes() for h in held], pa.binary())], names=["doc_id", "text_hash", "sid", "fp", "n", "lanes", "runs"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, text_hash long, sid long, fp long, n int, lanes array<long>, runs binary")


def frequent(docs: DataFrame, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs that FREQUENT or more texts of a sample have, in order, and how many of all `rows` texts are expected to have each."""
    one_in = max(1, min(rows // SAMPLE, SAMPLED))
    some = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(one_in)) == 0).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("nearcopies")
        for b in batches:
            held = [np.zeros(0, np.uint64), *(np.unique(runs(t)) for t in text_bytes(b.column(0)))]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(held).view(np.int64))], names=["run"])

    counted = some.mapInArrow(run, "run long").groupBy("run").agg(F.count("*").alias("n")).where(F.col("n") >= FREQUENT)
    held = counted.orderBy(F.col("n").desc(), "run").limit(MOST_FREQUENT).toArrow()
    found, counts = held["run"].to_numpy().view(np.uint64), held["n"].to_numpy()
    order = np.argsort(found)
    return found[order], counts[order] * one_in


def by_trees(keys: DataFrame) -> DataFrame:
    """(a, b): candidates by SimHash, a spanning forest of those within RADIUS bits in each BK-tree; sets of one SimHash meet the least
    of them. keys: sets_of(docs) without the runs, staged."""
    sets = keys.where("n > 0").select("fp", "sid").distinct()
    prints = staged(sets.groupBy("fp").agg(F.min("sid").alias("sid")), "nearcopies-prints")
    met = links(prints.select("fp"), RADIUS, direct=True).distinct()
    apart = met.join(prints.toDF("a", "x"), "a").join(prints.toDF("b", "y"), "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    same = sets.join(prints.toDF("fp", "a"), "fp").where("sid <> a").select("a", F.col("sid").alias("b"))
    return apart.unionByName(same)


ROW = ["run", "sid", "fp", "n", "at", "own", "deep", "lots"]


def shards(docs: DataFrame, rows: int) -> DataFrame:
    """ROW without fp and n, which go by the set: the sets that share one of their first runs. at is the run's place in the set's order;
    own counts those of the set's first runs, among the infrequent, that no other set has among its first; deep is whether its first
    runs reach the frequent; lots is how many lots the run's shard is dealt to. A task gives each set once, so that copies are a row a
    task."""
    bound_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(frequent(docs, rows))
    up, down = LEAST

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("nearcopies")
        known, counts = shipped.value
        seen: set[int] = set()
        for b in batches:
            sets = [np.unique(runs(t)) for t in text_bytes(b.column(0))]
            names = np.array([_name(x) for x in sets], np.uint64).view(np.int64)
            firsts, rows, places, lots, rare = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], np.zeros(len(sets), np.int32)
            for k, (held, sid) in enumerate(zip(sets, names.tolist(), strict=True)):
                if not len(held) or sid in seen:
                    continue
                seen.add(sid)
                rare[k] = len(held)
                times = np.zeros(len(held), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, held), len(known) - 1)
                    times = np.where(known[at] == held, counts[at], 0)
                    order = np.argsort(times, kind="stable")
                    held, times, rare[k] = held[order], times[order], np.count_nonzero(times == 0)
                first = held[: len(held) + up * len(held) // -down + 1]
                firsts.append(first)
                rows.append(np.full(len(first), k))
                places.append(np.arange(len(first), dtype=np.int32))
                lots.append((1 + times[: len(first)] // LOT).astype(np.int32))
            pick, place = np.concatenate(rows), np.concatenate(places)
            deep = np.array([up * len(x) // -down + 1 + len(x) for x in sets], np.int64) > rare
            picked = [pa.array(x) for x in (np.concatenate(firsts).view(np.int64), names[pick], place, place < rare[pick], deep[pick], np.concatenate(lots))]
            yield pa.RecordBatch.from_arrays(picked, names=["run", "sid", "at", "rare", "deep", "lots"])

    made = docs.select("text").mapInArrow(run, "run long, sid long, at int, rare boolean, deep boolean, lots int")
    made = made.withColumn("lot", F.pmod("sid", "lots").cast("int")).repartition("run", "lot").dropDuplicates(["run", "lot", "sid"])
    # A run of many lots is frequent, and so shared.
    here = W.partitionBy("run", "lot")
    made = made.select("*", ((F.col("lots") > 1) | (F.min("sid").over(here) != F.max("sid").over(here))).alias("shared"))
    # A set's rare first runs that stand alone are counted, and go. All columns are asked for, so that both readers share one exchange.
    whole = " and ".join(f"{c} is not null" for c in ("at", "deep", "lots"))
    alone = made.where(f"rare and not shared and {whole}").groupBy("sid").agg(F.count("*").cast("int").alias("own"))
    met = made.where("shared and rare is not null").select("run", "sid", "at", "deep", "lots")
    return met.join(alone, "sid", "left").select("run", "sid", "at", F.coalesce("own", F.lit(0)).alias("own"), "deep", "lots")


def _possible() -> str:
    """Whether two rows of a shard, the second's columns ending in 2, can be of similar sets: by their sizes, by the run's places,
    and by their own runs, which the other set lacks if its first runs go further than they do."""
    up, down = LEAST
    both = "(least(at, at2) + least(n - at, n2 - at2))"
    own, own2 = "if(deep2, own, 0)", "if(deep, own2, 0)"
    return (
        f"{down} * least(n, n2) >= {up} * greatest(n, n2) AND {up + down} * {both} >= {up} * (n + n2)"
        f" AND {down - up} * least(n - {own}, n2 - {own2}) >= {up} * ({own} + {own2})"
    )


def _near() -> str:
    """Whether lanes and lanes2 differ in no more bits than sets of sizes n and n2 that are similar differ in runs."""
    up, down = LEAST
    apart = " + ".join(f"bit_count(lanes[{k}] ^ lanes2[{k}])" for k in range(LANE_WORDS))
    return f"{up + down} * ({apart}) <= {down - up} * (n + n2)"


def _enough(shared: DataFrame) -> DataFrame:
    """(a, b) of shared, a row (a, b, n, n2, at, at2) for each of the first runs that a and b share, that can be similar: beyond the
    last of them they share only what is in the rest of both, and the first runs of the one whose first runs end earlier hold no
    more of it."""
    up, down = LEAST
    rest = lambda n: f"(ceil({up} * {n} / {down}) - 1)"
    beyond = f"greatest(least({rest('n')}, n2 - at2 - 1), least(n - at - 1, {rest('n2')}))"
    each = shared.groupBy("a", "b").agg(F.count("*").alias("c"), *(F.max(x).alias(x) for x in ("n", "n2", "at", "at2")))
    return each.where(f"{up + down} * (c + {beyond}) >= {up} * (n + n2)").select("a", "b")


def neighbours(rows: DataFrame) -> DataFrame:
    """(a, b): candidates that are neighbours in a shard, in the order of the fingerprint turned by TURNS. The lots of a large shard are
    ranges of that order, and the last of each is a neighbour of the next one's first."""
    out = None
    held = [c for c in ROW if c not in ("run", "fp", "lots")]
    lag = lambda order: [F.lag(c).over(order).alias(f"{c}2") for c in held]
    # One exchange for all turns; a window's own would come after its order is made.
    small, large = rows.where("lots = 1").repartition("run"), rows.where("lots > 1")
    for turn in TURNS:
        turned = F.expr(f"shiftleft(fp, {turn}) | shiftrightunsigned(fp, {64 - turn})") if turn else F.col("fp")
        one = small.select(*held, *lag(W.partitionBy("run").orderBy(turned, "sid")))
        lot = F.call_function("shiftrightunsigned", F.col("turned"), 64 - F.ceil(F.log2("lots")).cast("int"))
        dealt = large.withColumn("turned", turned).withColumn("lot", lot)
        whole = F.struct("turned", *dict.fromkeys(["sid", *held]))
        ends = dealt.groupBy("run", "lot").agg(F.min(whole).alias("first"), F.max(whole).alias("last"))
        before = ends.withColumn("before", F.lag("last").over(W.partitionBy("run").orderBy("lot")))
        across = before.select(*(F.col(f"first.{c}").alias(c) for c in held), *(F.col(f"before.{c}").alias(f"{c}2") for c in held))
        one = one.unionByName(dealt.select(*held, *lag(W.partitionBy("run", "lot").orderBy("turned", "sid")))).unionByName(across)
        one = one.where("sid2 IS NOT NULL AND " + _possible()).select(F.least("sid", "sid2").alias("a"), F.greatest("sid", "sid2").alias("b"))
        out = one if out is None else out.unionByName(one)
    left, right = rows.select("run", F.col("sid").alias("a"), "n", "at"), rows.select("run", F.col("sid").alias("b"), F.col("n").alias("n2"), F.col("at").alias("at2"))
    return _enough(out.distinct().join(left, "a").join(right, ["run", "b"]))


def remaining(rows: DataFrame, roots: DataFrame, keys: DataFrame) -> DataFrame:
    """(a, b): all candidates whose groups, by roots (node, root), still differ. keys: sets_of(docs) without the runs.

    Of a shard's sets, those outside its largest group meet all others: a shard that is one group but for a few sets takes pairs in
    proportion to its size.
    """
    rows = rows.join(roots, F.col("sid") == F.col("node"), "left").select(*ROW, F.coalesce("root", "sid").alias("root")).drop("fp", "lots")
    groups = rows.groupBy("run", "root").agg(F.count("*").alias("c"))
    largest = groups.groupBy("run").agg(F.max(F.struct("c", "root"))["root"].alias("largest"), F.count("*").alias("groups")).where("groups > 1").drop("groups")
    rows = rows.join(largest, "run").join(keys.select("sid", "lanes").dropDuplicates(["sid"]), "sid")
    right = rows.drop("largest").toDF(*(c if c == "run" else f"{c}2" for c in rows.columns if c != "largest"))
    some = rows.where("root <> largest")
    # Two sets outside the largest group meet twice; one of the two is enough.
    met = some.join(right, (some["run"] == right["run"]) & F.expr(f"root <> root2 AND (sid < sid2 OR root2 = largest) AND {_possible()} AND {_near()}"))
    held = lambda c, d, name: F.expr(f"if(sid < sid2, {c}, {d})").alias(name)
    return _enough(met.select(held("sid", "sid2", "a"), held("sid2", "sid", "b"), held("n", "n2", "n"), held("n2", "n", "n2"), held("at", "at2", "at"), held("at2", "at", "at2")))


def marks(hashes: DataFrame, bits: int) -> np.ndarray:
    """A map of bits, a power of two and BLOCK at least, as bytes: those at the lowest bits of each of hashes (hash) are set."""
    at = F.pmod("hash", F.lit(bits)) + 1  # Spark numbers bits from 1
    blocks = hashes.select(F.bitmap_bucket_number(at).alias("block"), F.bitmap_bit_position(at).alias("bit")).repartition("block")
    held = blocks.groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits")).toArrow()
    out = np.zeros((bits // BLOCK, BLOCK // 8), np.uint8)
    for block, each in zip(held["block"].to_pylist(), held["bits"].to_pylist(), strict=True):
        out[block - 1] = np.frombuffer(each, np.uint8)
    return out.reshape(-1)


def runs_of(docs: DataFrame, hashes: DataFrame, expected: int) -> DataFrame:
    """(sid, runs) for texts with one of hashes (hash), as text_hash, of which some `expected` are expected, and for a few others, which
    have the same place in a map: of the texts, what isn't asked for never leaves its task. A task gives each text once."""
    bound_batches(docs.sparkSession)
    bits = min(MARKS, max(BLOCK, 1 << (32 * expected).bit_length()))
    shipped = docs.sparkSession.sparkContext.broadcast(marks(hashes, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("nearcopies")
        marked, seen = shipped.value, set()
        for b in batches:
            texts = text_bytes(b.column(0))
            hashes = np.array([xxhash.xxh64_intdigest(t, SEED) for t in texts], np.uint64)
            at = (hashes & np.uint64(bits - 1)).astype(np.int64)
            held = []
            for k in np.flatnonzero(marked[at >> 3] >> (at & 7) & 1).tolist():
                if hashes[k] not in seen:
                    seen.add(hashes[k])
                    held.append(np.unique(runs(texts[k])))
            names = pa.array(np.array([_name(h) for h in held], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([names, pa.array([h.tobytes() for h in held], pa.binary())], names=["sid", "runs"])

    return docs.select("text").mapInArrow(run, "sid long, runs binary")


def similar(pairs: DataFrame, docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Those of pairs (a, b) whose whole sets are similar. keys: sets_of(docs) without the runs."""
    pairs = staged(pairs, "nearcopies-pairs")
    needed = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
    texts = keys.join(needed, "sid").groupBy("sid").agg(F.min("text_hash").alias("hash")).select("hash")
    found = runs_of(docs, texts, 2 * pairs.count()).join(needed, "sid", "left_semi")
    held = staged(found.dropDuplicates(["sid"]), "nearcopies-needed")
    both = pairs.join(held.toDF("a", "runs_a"), "a").join(held.toDF("b", "runs_b"), "b").select("a", "b", "runs_a", "runs_b")
    up, down = LEAST

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("nearcopies")
        for b in batches:
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(down * shared >= up * (len(x) + len(y) - shared))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return staged(both.mapInArrow(run, "a long, b long"), "nearcopies-links")


def near_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, root) for each row: root names the group."""
    keys = staged(sets_of(docs).drop("runs"), "nearcopies-sets")
    # Of a set, only what its runs need goes with each of them; the rest joins those that are shared.
    each = keys.select("sid", "fp", "n").dropDuplicates(["sid"])
    rows = staged(shards(docs, keys.count()).join(each, "sid").select(*ROW), "nearcopies-shards")
    near = similar(by_trees(keys).unionByName(neighbours(rows)).distinct(), docs, keys)
    rest = similar(remaining(rows, components(near), keys), docs, keys)
    roots = components(near.unionByName(rest))
    return keys.select("doc_id", "text_hash", "sid").join(roots, F.col("sid") == F.col("node"), "left").select("doc_id", "text_hash", F.coalesce("root", "sid").alias("root"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row, with all its columns, of each group: that of the smallest doc_id (nulls last), then the smallest text hash."""
    return keep_least(docs, near_copies(docs))
