"""Language-model scoring by context-tree weighting over bytes, and an add-one unigram base.

A text's words, lower-cased and joined by single spaces, and an end byte are predicted byte by byte, eight binary decisions
each. Every decision has a node per context of 0 to DEPTH preceding bytes with a Krichevsky-Trofimov estimate, and the
estimates of all depths are mixed with context-tree weights: Pw = (KT + product of the children's Pw) / 2 at inner nodes.
With the counts of the training texts, a decision's probability is the mixture along its context's path.

No task needs the whole model, which grows with the corpus:

1. Each block of texts (a piece of an input split) counts its distinct byte strings of DEPTH + 1 and its words.
2. Parts, by a string's last TOP context bytes or a word's hash, add up the blocks' counts. Their number grows with the text.
   Levels DEPTH to TOP of the trees lie within parts; their sums for the level above, at most 256 ** TOP nodes, give the upper
   levels to all. A part of more than KEYS strings, that of a common context, is worked through by its next older byte, and
   so on, so that the trees in memory are bounded; only its strings and counts, 16 bytes each, are held as a whole.
3. Parts answer each block's keys, in the block's order, with code lengths and counts.
4. Blocks meet their answers, the texts' only shuffle, and add up each text.

A string of DEPTH + 1 bytes is one 64-bit key, so contexts have 7 bytes at most. Columns bytes_scored and bits_per_byte are of the
form above: the words joined by single spaces, with the end byte.

Words are keyed by 64-bit hashes: below 2**32 distinct words, less than one pair is expected to collide.

Defined results: a null or empty text is its end token alone; a null doc_id is hashed as the empty string; repeated rows
train and are scored one by one; with no training text every byte has probability 2**-8; an empty table gives an empty one.
Further columns are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bound_batches, parts_for, staged, text_bytes, worker_state

DEPTH = 6
#: Context bytes that parts go by. 3 keeps common pairs of bytes apart, and bounds the nodes that all share by 2 ** 24; texts have
#: some 10 ** 5 of them. A depth below it takes its place.
TOP = 3
END = b"\n"
#: Bytes on disk of an input split per block, and bytes of text whose strings are sorted at once.
BLOCK_BYTES, SLICE = 16 << 20, 1 << 20
GRAM, TOKEN = 0, 1
#: Bytes of text per part, the most parts (distinct strings grow slower than text), strings whose trees are held at once,
#: and keys in a row of the model.
PART_BYTES, MOST_PARTS, KEYS, ROW_KEYS = 4 << 20, 1 << 16, 1 << 18, 1 << 20
#: Code lengths travel as whole numbers of 1 / UNIT decimal digits in three bytes; one of 32 digits or more would count as 32.
UNIT = 1 << 19
#: Blocks that are numbered by a broadcast table, 16 bytes each; beyond, they are dealt by hash.
NUMBERED = 1_000_000


def _lgamma(x: np.ndarray) -> np.ndarray:
    y = x + 6
    out = (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    for k in range(6):
        out = out - np.log(x + k)
    return out


_SMALL = np.arange(1 << 16, dtype=np.float64)
_HALVES, _WHOLES = _lgamma(_SMALL + 0.5), _lgamma(_SMALL + 1.0)


def _looked_up(known: np.ndarray, n: np.ndarray, more: float) -> np.ndarray:
    """Log gamma of whole numbers n and more; known has those of small ones."""
    out = known[np.minimum(n, len(known) - 1).astype(np.int64)]
    large = np.flatnonzero(n >= len(known))
    out[large] = _lgamma(n[large] + more)
    return out


def kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    return _looked_up(_HALVES, n0, 0.5) + _looked_up(_HALVES, n1, 0.5) - _looked_up(_WHOLES, n0 + n1, 1.0) - math.log(math.pi)


def _leaf(k: np.ndarray, below: np.ndarray) -> np.ndarray:
    """The weight of a node's own estimate against its children's."""
    return 1 / (1 + np.exp(np.clip(below - k, -700, 700)))


def _one(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return (n1 + 0.5) / (n0 + n1 + 1)


def _up(nodes: np.ndarray, depth: int) -> np.ndarray:
    """Numbers of the nodes' parents at depth: the context's oldest byte goes. A node is its context's bytes, then the bits so far."""
    return ((nodes >> 8) & ((1 << (8 * depth)) - 1)) << 8 | (nodes & 255)


class Trees:
    """Levels depth to `top` of the trees over byte strings (context and byte, as integers, in order) with their counts."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, depth: int, top: int) -> None:
        byte, context = (grams & np.uint64(255)).astype(np.int64), (grams >> np.uint64(8)).astype(np.int64)
        self.bit = np.concatenate([(byte >> (7 - i)) & 1 for i in range(8)])
        # Strings are in order, so those of a deepest node stand together.
        nodes = [context << 8 | 1 << i | byte >> (8 - i) for i in range(8)]
        first = [np.concatenate(([True], x[1:] != x[:-1]))[: len(x)] for x in nodes]
        node, self.of = np.concatenate([x[f] for x, f in zip(nodes, first, strict=True)]), np.cumsum(np.concatenate(first)) - 1
        n = np.tile(counts.astype(np.float64), 8)
        n1, n0 = np.bincount(self.of, n * self.bit, len(node)), np.bincount(self.of, n * (1 - self.bit), len(node))
        weighted = kt(n0, n1)
        #: From the deepest level: nodes, counts, leaf weights, and each node's parent in the next.
        self.levels: list[list[np.ndarray]] = [[node, n0, n1, np.ones(len(node))]]
        for d in range(depth - 1, top - 1, -1):
            node, up = np.unique(_up(node, d), return_inverse=True)
            n0, n1, below = (np.bincount(up, x, len(node)) for x in (n0, n1, weighted))
            k = kt(n0, n1)
            weighted = np.logaddexp(k, below) - math.log(2)
            self.levels[-1].append(up)
            self.levels.append([node, n0, n1, _leaf(k, below)])
        parent, self.to_above = np.unique(_up(node, top - 1), return_inverse=True)
        #: Sums for the level above: nodes, zeros, ones, log Pw.
        self.above = (parent, *(np.bincount(self.to_above, x, len(parent)) for x in (n0, n1, weighted)))

    def code_lengths(self, upper: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        """Log10 probability of each string's byte. upper: nodes of the level above in order, the probability of a one that is
        mixed up to there, and the weight that is left for deeper levels."""
        known, mass, rest = upper
        at = np.searchsorted(known, self.above[0])[self.to_above]
        for _, n0, n1, leaf, *parent in reversed(self.levels):
            at = parent[0] if parent else at
            mass, rest = mass[at] + rest[at] * leaf * _one(n0, n1), rest[at] * (1 - leaf)
        p = mass[self.of]
        return np.log10(np.where(self.bit == 1, p, 1 - p)).reshape(8, -1).sum(0)


def _by_older(grams: np.ndarray, top: int) -> list[np.ndarray]:
    """Places of the strings by the context byte before the last `top`."""
    older = (grams >> np.uint64(8 * (top + 1))).astype(np.uint8)
    order = np.argsort(older, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(older[order])) + 1)


def _level(grams: np.ndarray, counts: np.ndarray, depth: int, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nodes of level `top` over many strings, in order: zeros, ones, and the sum of their children's log Pw."""
    sums = [above(grams[at], counts[at], depth, top + 1) for at in _by_older(grams, top)]
    node, of = np.unique(np.concatenate([x[0] for x in sums]), return_inverse=True)
    return (node, *(np.bincount(of, np.concatenate([x[k] for x in sums]), len(node)) for k in (1, 2, 3)))


def above(grams: np.ndarray, counts: np.ndarray, depth: int, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Trees(...).above, with at most some KEYS strings' trees at a time."""
    if len(grams) <= KEYS or top >= depth:
        return Trees(grams, counts, depth, top).above
    node, n0, n1, below = _level(grams, counts, depth, top)
    weighted = np.logaddexp(kt(n0, n1), below) - math.log(2)
    parent, of = np.unique(_up(node, top - 1), return_inverse=True)
    return (parent, *(np.bincount(of, x, len(parent)) for x in (n0, n1, weighted)))


def code_lengths(grams: np.ndarray, counts: np.ndarray, depth: int, top: int, upper: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Trees(...).code_lengths(upper), with at most some KEYS strings' trees at a time."""
    if len(grams) <= KEYS or top >= depth:
        return Trees(grams, counts, depth, top).code_lengths(upper)
    node, n0, n1, below = _level(grams, counts, depth, top)
    known, mass, rest = upper
    at, leaf = np.searchsorted(known, _up(node, top - 1)), _leaf(kt(n0, n1), below)
    here = node, mass[at] + rest[at] * leaf * _one(n0, n1), rest[at] * (1 - leaf)
    out = np.zeros(len(grams))
    for some in _by_older(grams, top):
        out[some] = code_lengths(grams[some], counts[some], depth, top + 1, here)
    return out


def upper(node: np.ndarray, n0: np.ndarray, n1: np.ndarray, below: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From the sums for a level (distinct nodes, zeros, ones, log Pw below): nodes, mass and rest, as code_lengths() takes them."""
    order = np.argsort(node)
    node, n0, n1, below = (x[order] for x in (node.astype(np.int64), n0, n1, below))
    levels = []
    for d in range(depth, -1, -1):
        k = kt(n0, n1)
        weighted = np.logaddexp(k, below) - math.log(2)
        parent, up = np.unique(_up(node, d - 1), return_inverse=True) if d else (node, None)
        levels.append((node, n0, n1, _leaf(k, below), up))
        if d:
            node, (n0, n1, below) = parent, (np.bincount(up, x, len(parent)) for x in (n0, n1, weighted))
    mass, rest = np.zeros(len(node)), np.ones(len(node))
    up = np.arange(len(node))
    for k, (_, n0, n1, leaf, _) in enumerate(reversed(levels)):
        at = up if k == 0 else levels[len(levels) - 1 - k][4]
        mass, rest = mass[at] + rest[at] * leaf * _one(n0, n1), rest[at] * (1 - leaf)
    return levels[0][0], mass, rest


def _normal(text: bytes) -> tuple[list[bytes], bytes]:
    words = text.lower().split()
    return words, b" ".join(words) + END


def _grams(texts: list[bytes], depth: int) -> np.ndarray:
    """The strings of depth + 1 bytes that end at each byte; texts end with END, which also precedes each."""
    raw = np.frombuffer(b"".join(x for t in texts for x in (END * depth, t)), np.uint8).astype(np.uint64)
    grams = raw.copy()
    for k in range(1, depth + 1):
        grams[k:] |= raw[:-k] << np.uint64(8 * k)
    sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    skip = np.repeat(np.arange(1, len(texts) + 1) * depth, sizes)
    return grams[np.arange(len(skip)) + skip]


def _added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")  # what is added are runs in order
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts, first)


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.diff(np.append(first, len(keys)))


class Tally:
    """Counts of keys that come in pieces."""

    def __init__(self) -> None:
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.held.append((keys, counts))
        self.size += len(keys)
        if len(self.held) > 1 and self.size > 2 * len(self.held[0][0]) + (1 << 18):
            self.held = [self.total()]
            self.size = len(self.held[0][0])

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.held:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return self.held[0] if len(self.held) == 1 else _added(np.concatenate([k for k, _ in self.held]), np.concatenate([c for _, c in self.held]))


def _pack(x: np.ndarray, size: int) -> bytes:
    """The low `size` bytes of each, byte planes apart, as sorted keys' upper planes compress well."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T).tobytes()


def _unpack(raw: bytes, size: int) -> np.ndarray:
    out = np.zeros((len(raw) // size, 8), np.uint8)
    out[:, :size] = np.frombuffer(raw, np.uint8).reshape(size, -1).T
    return out.reshape(-1).view("<u8")


def _parts(kind: int, keys: np.ndarray, parts: int, top: int) -> np.ndarray:
    """Strings go by their last context bytes, so that levels from `top` on lie within a part; words by their hash."""
    x = (keys >> np.uint64(8)) & np.uint64((1 << 8 * top) - 1) if kind == GRAM else keys
    return ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(parts)


def _by_part(kind: int, keys: np.ndarray, parts: int, top: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of sorted keys by part, and the bounds of the parts in it."""
    part = _parts(kind, keys, parts, top)
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1, dtype=np.uint64))


class _Words:
    """Numbers words and hashes each once."""

    def __init__(self) -> None:
        self.number: dict[bytes, int] = defaultdict()
        self.number.default_factory = self.number.__len__

    def codes(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.number.__getitem__, words), np.int32, len(words))

    def hashes(self) -> np.ndarray:
        digest = xxhash.xxh3_64_intdigest
        return np.fromiter(map(digest, self.number), np.uint64, len(self.number))


def _slices(texts: list[bytes], size: int = SLICE) -> Iterator[list[int]]:
    held, total = [], 0
    for k, t in enumerate(texts):
        held.append(k)
        total += len(t)
        if total >= size:
            yield held
            held, total = [], 0
    if held:
        yield held


CHUNK = "block long, kind int, part int, keys binary, counts binary"


def _count_blocks(docs: DataFrame, depth: int, parts: int) -> DataFrame:
    """docs: block, train, text. CHUNK rows: each block's distinct keys by part, with their counts in training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("ctw counts")
        tallies: dict[tuple[int, int], Tally] = defaultdict(Tally)
        for b in batches:
            block, train, raw = b.column(0).to_pylist(), b.column(1).to_pylist(), text_bytes(b.column(2))
            groups: dict[tuple[int, bool], list[bytes]] = defaultdict(list)
            for k in range(len(raw)):
                groups[block[k], train[k]].append(raw[k])
            for (at, trains), texts in groups.items():
                for some in _slices(texts):
                    both = [_normal(texts[k]) for k in some]
                    words = _Words()
                    codes = np.concatenate([words.codes([*w, END]) for w, _ in both])
                    for kind, keys, n in ((GRAM, *_counted(_grams([t for _, t in both], depth))), (TOKEN, words.hashes(), np.bincount(codes))):
                        tallies[at, kind].add(keys, n.astype(np.int64) if trains else np.zeros(len(keys), np.int64))
        for (at, kind), tally in tallies.items():
            keys, n = _added(*tally.total())
            order, cuts = _by_part(kind, keys, parts, min(TOP, depth))
            size = depth + 1 if kind == GRAM else 8
            full = [p for p in range(parts) if cuts[p] < cuts[p + 1]]
            pieces = [order[cuts[p] : cuts[p + 1]] for p in full]
            columns = [pa.array([at] * len(full), pa.int64()), pa.array([kind] * len(full), pa.int32()), pa.array(full, pa.int32()), pa.array([_pack(keys[x], size) for x in pieces], pa.binary()), pa.array([_pack(n[x], 4) for x in pieces], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in CHUNK.split(", ")])

    return docs.select("block", "train", "text").mapInArrow(run, CHUNK)


MODEL = "kind int, part int, piece int, keys binary, counts binary, n long, v long, above array<struct<node:int,n0:double,n1:double,below:double>>"


def _add_parts(chunks: DataFrame, depth: int) -> DataFrame:
    """MODEL rows: each part's keys and sums, in pieces; for words their number and distinct ones, for strings the sums for the level above."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("ctw sums")
        now, tally = None, Tally()

        def flush() -> Iterator[pa.RecordBatch]:
            kind, part = now
            keys, n = _added(*tally.total())
            sums = above(keys, n, depth, min(TOP, depth)) if kind == GRAM else [np.zeros(0)] * 4
            for piece, at in enumerate(range(0, len(keys), ROW_KEYS)):
                k, c = keys[at : at + ROW_KEYS], n[at : at + ROW_KEYS]
                own = pa.StructArray.from_arrays([pa.array(x if piece == 0 else x[:0], t) for x, t in zip(sums, (pa.int32(), pa.float64(), pa.float64(), pa.float64()), strict=True)], names=["node", "n0", "n1", "below"])
                words = (int(c.sum()), int((c > 0).sum())) if kind == TOKEN else (0, 0)
                columns = [pa.array([kind], pa.int32()), pa.array([part], pa.int32()), pa.array([piece], pa.int32()), pa.array([_pack(k, 8)], pa.binary()), pa.array([_pack(c, 8)], pa.binary()), *(pa.array([w], pa.int64()) for w in words), pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own)]
                yield pa.RecordBatch.from_arrays(columns, names=["kind", "part", "piece", "keys", "counts", "n", "v", "above"])

        for b in batches:
            for kind, part, keys, counts in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if now is not None and (kind, part) != now:
                    yield from flush()
                    tally = Tally()
                now = (kind, part)
                tally.add(_unpack(keys, depth + 1 if kind == GRAM else 8), _unpack(counts, 4).astype(np.int64))
        if now is not None:
            yield from flush()

    rows = chunks.select("kind", "part", "keys", "counts").repartition("kind", "part").sortWithinPartitions("kind", "part")
    return rows.mapInArrow(run, MODEL)


ANSWER = "block long, kind int, part int, answers binary"


def _answer(chunks: DataFrame, model: DataFrame, above: tuple[np.ndarray, np.ndarray, np.ndarray], depth: int) -> DataFrame:
    """ANSWER rows: for each chunk, in its keys' order, code lengths of strings (units, 3 bytes) or counts (5 bytes) of words."""
    none = F.lit(None)
    shared = chunks.sparkSession.sparkContext.broadcast(above)  # at most 256 ** TOP nodes
    first = model.select("kind", "part", F.col("piece").alias("turn"), none.cast("long").alias("block"), "keys", "counts")
    rows = first.unionByName(chunks.select("kind", "part", F.lit(2**31 - 1).alias("turn"), "block", "keys", F.lit(None).cast("binary").alias("counts")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("ctw answers")
        known, values, pieces = None, None, []
        for b in batches:
            out = []
            for kind, part, turn, block, keys, counts in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if block is None:
                    pieces = [*pieces, (_unpack(keys, 8), _unpack(counts, 8))] if turn else [(_unpack(keys, 8), _unpack(counts, 8))]
                else:
                    if pieces:
                        known, n = (np.concatenate([x[k] for x in pieces]) for k in (0, 1))
                        values = n if kind == TOKEN else np.minimum(np.rint(-UNIT * code_lengths(known, n, depth, min(TOP, depth), shared.value)), (1 << 24) - 1).astype(np.int64)
                        pieces = []
                    got = values[np.searchsorted(known, _unpack(keys, depth + 1 if kind == GRAM else 8))]
                    out.append((block, kind, part, _pack(got, 5 if kind == TOKEN else 3)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["block", "kind", "part", "answers"])

    return rows.repartition("kind", "part").sortWithinPartitions("kind", "part", "turn").mapInArrow(run, ANSWER)


class Table:
    """Values by key: open addressing in arrays, looked up many at a time."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        bits = max(4, int(1.4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        slot = self._slots(keys)
        held = np.full(1 << bits, -1, np.int32)
        todo = np.arange(len(keys), dtype=np.int32)
        while len(todo):
            free = todo[held[slot[todo]] < 0]
            held[slot[free]] = free
            todo = todo[held[slot[todo]] != todo]
            slot[todo] = (slot[todo] + 1) & self.mask
        self.keys = np.append(keys, np.uint64(0))[held]
        self.values = np.append(values, values.dtype.type(0))[held]

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        """All keys must be known."""
        slot = self._slots(keys)
        wrong = np.flatnonzero(self.keys[slot] != keys)
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) & self.mask
            wrong = wrong[self.keys[slot[wrong]] != keys[wrong]]
        return self.values[slot]


def _score_blocks(docs: DataFrame, answers: DataFrame, blocks: DataFrame, total: int, distinct: int, depth: int, parts: int) -> DataFrame:
    """blocks: those of docs, staged."""
    n = max(1, blocks.count())
    kind_of = docs.schema["doc_id"].dataType
    texts = docs.select("block", F.lit(1).alias("turn"), F.lit(0).alias("kind"), F.lit(0).alias("part"), F.lit(None).cast("binary").alias("answers"), "doc_id", "train", "text")
    told = answers.select("block", F.lit(0).alias("turn"), "kind", "part", "answers", F.lit(None).cast(kind_of).alias("doc_id"), F.lit(None).cast("boolean").alias("train"), F.lit(None).cast("string").alias("text"))
    unit = math.log10(total + distinct + 1)
    out_schema = f"doc_id {kind_of.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bytes_scored long, bits_per_byte double"

    def scores(block: list, answers: dict) -> Iterator[pa.RecordBatch]:
        words, tally, codes, normal = _Words(), Tally(), [], []
        for _, _, raw in block:  # a text's words are many small objects: none outlives its text
            split, joined = _normal(raw)
            codes.append(words.codes([*split, END]))
            normal.append(joined)
        cuts = list(_slices(normal))
        for some in cuts:
            tally.add(*_counted(_grams([normal[k] for k in some], depth)))
        tables = {}
        for kind, keys in ((GRAM, _added(*tally.total())[0]), (TOKEN, np.sort(words.hashes()))):
            order, bounds = _by_part(kind, keys, parts, min(TOP, depth))
            got = np.concatenate([_unpack(answers.pop((kind, p)), 3 if kind == GRAM else 5) for p in range(parts) if bounds[p] < bounds[p + 1]])
            tables[kind] = Table(keys[order], got.astype(np.int32 if kind == GRAM else np.float64))
        counts = tables[TOKEN][words.hashes()]
        base, seen = np.log10(counts + 1) - unit, counts > 0
        for some in cuts:
            parts_of = [normal[k] for k in some]
            sizes = np.array([len(t) for t in parts_of])
            lengths = np.add.reduceat(tables[GRAM][_grams(parts_of, depth)].astype(np.int64), np.cumsum(sizes) - sizes) / -UNIT
            rows = [(block[k][0], not block[k][1], len(codes[k]), int(seen[codes[k]].sum()), total, float(base[codes[k]].sum()), float(s), int(n), -float(s) / math.log10(2) / n) for k, s, n in zip(some, lengths, sizes, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (id_type[0], pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.float64()), strict=True)], names=[f.split()[0] for f in out_schema.split(", ")])

    id_type: list = [None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("ctw scores")
        now, block, answers = None, [], {}
        for b in batches:
            id_type[0] = b.schema.field("doc_id").type
            at, turn, kind, part, told, doc, train = (b.column(k).to_pylist() for k in range(7))
            raw = text_bytes(b.column(7))
            for k in range(b.num_rows):
                if at[k] != now:
                    if block:
                        yield from scores(block, answers)
                    now, block, answers = at[k], [], {}
                if turn[k] == 0:
                    answers[kind[k], part[k]] = told[k]
                else:
                    block.append((doc[k], train[k], raw[k]))
        if block:
            yield from scores(block, answers)

    both = texts.unionByName(told)
    if n <= NUMBERED:  # a task for each block
        number = blocks.select("block", (F.row_number().over(W.orderBy("block")) - 1).alias("number"))
        both = both.join(F.broadcast(number), "block", "left").repartitionById(n, "number").drop("number")
    else:
        both = both.repartition(n, "block")
    return both.sortWithinPartitions("block", "turn").mapInArrow(run, out_schema)


def _bytes_of(size: str) -> int:
    digits = size.lower().rstrip("b")
    return int(digits[:-1]) << {"k": 10, "m": 20, "g": 30, "t": 40}[digits[-1]] if digits[-1:] in "kmgt" else int(digits)


def score(docs: DataFrame, train: Column, depth: int = DEPTH, scanned: bool = False) -> DataFrame:
    """docs: doc_id and text. train: which rows to learn from. A row of scores for each row.

    Blocks are pieces of input splits, so docs must be read straight from files (scanned) or is written to such first.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select("doc_id", "text", F.coalesce(train, F.lit(False)).alias("train"))
    if not scanned:
        rows = staged(rows, "ctw-texts")
    per_split = -(-_bytes_of(spark.conf.get("spark.sql.files.maxPartitionBytes")) // BLOCK_BYTES)
    block = F.xxhash64(F.input_file_name(), F.input_file_block_start(), F.pmod(F.xxhash64("doc_id"), F.lit(per_split)))
    rows = rows.select("doc_id", "text", "train", block.alias("block"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = min(MOST_PARTS, parts_for(size, PART_BYTES, 8))
    chunks = staged(_count_blocks(rows, depth, parts), "ctw-chunks")
    model = staged(_add_parts(chunks, depth), "ctw-model")
    total, distinct = model.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    sums = model.select(F.explode("above").alias("a")).groupBy("a.node").agg(F.sum("a.n0").alias("n0"), F.sum("a.n1").alias("n1"), F.sum("a.below").alias("below"))
    held = sums.toArrow()  # at most 256 ** TOP rows of 28 bytes
    above = upper(*(held[c].to_numpy() for c in ("node", "n0", "n1", "below")), depth=min(TOP, depth) - 1)
    blocks = staged(chunks.select("block").distinct(), "ctw-blocks")
    return _score_blocks(rows, _answer(chunks, model, above, depth), blocks, total, distinct, depth, parts)
