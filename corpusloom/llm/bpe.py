"""Byte-level BPE by a DuckDB recursive query, and decoding by ordered aggregation.

A text is split by the tokenizer's pattern; each match is a word of its own. Distinct words are encoded as rows (word,
position, token): the recursive query joins neighbours with the merge table, contracts each word's leftmost pair of minimum
rank and goes on until no word has a pair. A worker keeps the ids of words it has met, and a text's ids are those of its
words, in order. As in the tiktoken library, a word that is a token as a whole is that token. A text is decoded from its
ids alone: rows (block, position, token) meet the vocabulary, and the tokens' bytes are aggregated in order.

The query's rows grow with the square of a word's bytes, so words of more than LONG bytes are contracted by the same rule
over a heap (the README has figures).

Defined results: a null or empty text has no tokens and decodes to nothing; equal rows give equal results; an empty
table gives an empty one. Further columns are ignored by tokenize().
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import bound_batches, worker_state

LONG = 2048
#: Words kept by a worker: those of the last KEPT and the KEPT before them.
KEPT = 250_000
#: Rows that one recursive query makes at most (but for one word alone), and tokens that one decoding query takes.
ROWS, TOKENS = 4_000_000, 500_000
#: Tokens that are aggregated to one string, and characters of a text whose words are listed at once.
BLOCK, CHARS = 16_384, 1 << 20

# Rows are ordered by one number, place: the word's number, then 20 bits of its position. A pair of tokens is one number too.
CONTRACT = """
WITH RECURSIVE step(place, token, done) AS (
    SELECT (word::BIGINT << 20) | pos, token, false FROM start
    UNION ALL
    (WITH pairs AS (
        SELECT place, token, lead(token) OVER ahead AS right_token, lead(place) OVER ahead AS right_place
        FROM step WHERE NOT done WINDOW ahead AS (ORDER BY place)),
    best AS (
        SELECT p.place >> 20 AS word, min((m.rank << 20) | (p.place & 1048575)) AS code, arg_min(p.right_place, (m.rank << 20) | (p.place & 1048575)) AS gone
        FROM pairs p JOIN merges m ON m.pair = (p.token::BIGINT << 32 | p.right_token)
        WHERE p.right_place >> 20 = p.place >> 20 GROUP BY p.place >> 20)
    SELECT p.place, CASE WHEN (p.place & 1048575) = (b.code & 1048575) THEN (b.code >> 20)::INTEGER ELSE p.token END, b.code IS NULL
    FROM pairs p LEFT JOIN best b ON b.word = p.place >> 20 WHERE b.gone IS NULL OR p.place <> b.gone))
SELECT (place >> 20)::INTEGER AS word, token FROM step WHERE done ORDER BY place
"""

# The vocabulary's bytes are held as characters of the same numbers.
DECODE = """
SELECT word, array_to_string(list(v.bytes ORDER BY pos), '') AS decoded
FROM start JOIN vocabulary v ON v.id = token GROUP BY word ORDER BY word
"""


def read_ranks(path: str) -> bytes:
    """The bytes of a rank file (base64 token and rank on each line); the file is small and read by the driver."""
    with open(path, "rb") as f:
        return f.read()


class _Words:
    """The ids of words, one after the other in one array."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.ids, self.ends = array("i"), array("q", [0])

    def add(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        """New words, their ids one after the other, and how many each has."""
        n, end = len(self.number), self.ends[-1]
        self.number.update(zip(words, range(n, n + len(words)), strict=True))
        self.ids.frombytes(ids.astype(np.int32).tobytes())
        self.ends.frombytes((end + np.cumsum(sizes, dtype=np.int64)).tobytes())

    def of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these words, all of which are known, in order, and how many each has."""
        at = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        ends = np.frombuffer(self.ends, np.int64)
        first, sizes = ends[at], ends[at + 1] - ends[at]
        shift = np.repeat(first - (np.cumsum(sizes) - sizes), sizes)
        return np.frombuffer(self.ids, np.int32)[shift + np.arange(len(shift))], sizes


class Codec:
    """Encoder and decoder for one vocabulary; holds a DuckDB database in memory, which never spills to a local disk."""

    def __init__(self, raw: bytes, pattern: str) -> None:
        import duckdb

        self.ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, raw.splitlines()) if t}
        self.pattern = regex.compile(pattern)
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.names = list(map(str, range(max(self.ranks.values()) + 1)))
        self.sizes = np.zeros(len(self.names), np.int64)
        self.sizes[list(self.ranks.values())] = list(map(len, self.ranks))
        pairs = [(self.ranks[t[:k]], self.ranks[t[k:]], r) for t, r in self.ranks.items() for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks]
        left, right, rank = zip(*pairs, strict=True) if pairs else ((), (), ())
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        pair = np.array(left, np.int64) << 32 | np.array(right, np.int64)
        self._table("merges", pair=pa.array(pair, pa.int64()), rank=pa.array(rank, pa.int64()))
        self._table("vocabulary", id=pa.array(self.ranks.values(), pa.int32()), bytes=pa.array([t.decode("latin-1") for t in self.ranks]))
        self.new, self.old = _Words(), _Words()

    def _table(self, name: str, **columns: pa.Array) -> None:
        self.db.register("given", pa.table(columns))
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def _rows(self, tokens: np.ndarray, lengths: np.ndarray, query: str) -> pa.Table:
        """Runs query over rows (word, pos, token)."""
        first = np.cumsum(lengths) - lengths
        word = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        pos = np.arange(len(tokens), dtype=np.int64) - np.repeat(first, lengths)
        self.db.register("start", pa.table({"word": word, "pos": pos.astype(np.int32), "token": tokens}))
        found = self.db.sql(query).to_arrow_table()
        self.db.unregister("start")
        return found

    def _contracted(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        found = self._rows(self.byte[np.frombuffer(b"".join(words), np.uint8)], lengths, CONTRACT)
        return found["token"].to_numpy(), np.bincount(found["word"].to_numpy(), minlength=len(words))

    def contract(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each non-empty word, by the recursive query."""
        ids, sizes = self._contracted(words)
        return [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """The bytes of each text's ids, by ordered aggregation in blocks of BLOCK tokens, which may go on from text to text."""
        every = np.concatenate([np.zeros(0, np.int32), *(np.asarray(x, np.int32) for x in ids)])
        held = []
        for at in range(0, len(every), TOKENS):
            some = every[at : at + TOKENS]
            found = self._rows(some, np.diff([*range(0, len(some), BLOCK), len(some)]), DECODE)
            held.extend(d.encode("latin-1") for d in found["decoded"].to_pylist())
        whole = b"".join(held)
        known = (every >= 0) & (every < len(self.sizes))
        ends = np.concatenate([[0], np.cumsum(np.where(known, self.sizes[np.where(known, every, 0)], 0))])
        ends = ends[np.cumsum([0, *map(len, ids)])].tolist()
        return [whole[i:j] for i, j in zip(ends, ends[1:], strict=False)]

    def _heap(self, word: bytes) -> list[int]:
        """The same contraction for a long word: pairs wait in a heap by (rank, position)."""
        n, ranks = len(word), self.ranks
        token = [word[k : k + 1] for k in range(n)]
        after, before, heap = list(range(1, n + 1)), list(range(-1, n - 1)), []

        def offer(k: int) -> None:
            if k >= 0 and after[k] < n:
                rank = ranks.get(token[k] + token[after[k]])
                if rank is not None:
                    heapq.heappush(heap, (rank, k, token[k], token[after[k]]))

        for k in range(n - 1):
            offer(k)
        while heap:
            _, k, a, b = heapq.heappop(heap)
            j = after[k]
            if token[k] != a or j >= n or token[j] != b:
                continue
            token[k], token[j], after[k] = a + b, b"", after[j]
            if after[j] < n:
                before[after[j]] = k
            offer(k)
            offer(before[k])
        return [ranks[t] for t in token if t]

    def learn(self, words: set[str]) -> None:
        """Makes sure that all these words are at hand in self.new."""
        words = words - self.new.number.keys()
        again = list(words & self.old.number.keys())
        if again:
            self.new.add(again, *self.old.of(again))
        fresh = [(w, w.encode()) for w in words.difference(again)]
        whole = [(w, self.ranks[raw]) for w, raw in fresh if raw in self.ranks]
        self.new.add([w for w, _ in whole], np.array([r for _, r in whole], np.int32), np.ones(len(whole), np.int64))
        todo = sorted(((w, raw) for w, raw in fresh if raw not in self.ranks), key=lambda x: len(x[1]))
        while todo and len(todo[-1][1]) > LONG:
            w, raw = todo.pop()
            ids = self._heap(raw)
            self.new.add([w], np.array(ids), np.array([len(ids)]))
        rows = np.cumsum([(len(raw) + 1) ** 2 for _, raw in todo])
        at = 0
        while at < len(todo):
            end = max(at + 1, int(np.searchsorted(rows, (rows[at - 1] if at else 0) + ROWS, "right")))
            self.new.add([w for w, _ in todo[at:end]], *self._contracted([raw for _, raw in todo[at:end]]))
            at = end

    def _split(self, text: str) -> Iterator[list[str]]:
        """The text's words; those of a long text in pieces."""
        if len(text) <= CHARS:
            yield self.pattern.findall(text)
        else:
            found = (m[0] for m in self.pattern.finditer(text))
            while some := list(islice(found, CHARS >> 3)):
                yield some

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text. Short texts are learnt together."""
        out: list[np.ndarray] = []
        if sum(map(len, texts)) <= 4 * CHARS:
            words = [[w for some in self._split(t) for w in some] if len(t) > CHARS else self.pattern.findall(t) for t in texts]
            every = list(chain.from_iterable(words))
            self.learn(set(every))
            ids, sizes = self.new.of(every)
            ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))]
            out = np.split(ids, ends[:-1]) if texts else []
        else:
            for t in texts:
                ids = [np.zeros(0, np.int32)]
                for some in self._split(t):
                    self.learn(set(some))
                    ids.append(self.new.of(some)[0])
                    self._turn()
                out.append(np.concatenate(ids))
        self._turn()
        return out

    def _turn(self) -> None:
        if len(self.new.number) > KEPT:
            self.old, self.new = self.new, _Words()

    def texts(self, texts: list[str]) -> Iterator[tuple[np.ndarray, list[bytes]]]:
        """For each text, its ids and what they decode to, as a list of pieces."""
        ids = self.encode(texts)
        yield from zip(ids, ([d] for d in self.decode(ids)), strict=True)


def codec(raw: bytes, pattern: str) -> Codec:
    """The worker's codec for this vocabulary, made once."""
    kept, key = worker_state("bpe"), (hashlib.sha256(raw).hexdigest(), pattern)
    if key not in kept:
        kept.clear()
        kept[key] = Codec(raw, pattern)
    return kept[key]


def _slices(column: pa.Array, size: int = 2 << 20) -> Iterator[tuple[int, list[str]]]:
    start, held, total = 0, [], 0
    for k, t in enumerate(column.to_pylist()):
        held.append(t or "")
        total += len(held[-1])
        if total >= size:
            yield start, held
            start, held, total = k + 1, [], 0
    if held:
        yield start, held


#: What tokenize() can return besides the columns to keep.
OUTPUTS = {"n_tokens": "long", "ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}


def tokenize(docs: DataFrame, ranks: bytes, pattern: str, keep: list[str], outputs: list[str]) -> DataFrame:
    """The columns to keep, and these of OUTPUTS, for each row's text. One pass, no shuffle."""
    spark = docs.sparkSession
    bound_batches(spark)
    shipped = spark.sparkContext.broadcast(ranks)  # one vocabulary file, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shipped.value, pattern)
        for b in batches:
            for at, texts in _slices(b.column(len(keep))):
                columns: dict[str, list] = {k: [] for k in outputs}
                ids = c.encode(texts)
                back = c.decode(ids) if {"decoded", "decoded_sha256"} & set(outputs) else [None] * len(ids)
                for x, whole in zip(ids, back, strict=True):
                    for k, out in columns.items():
                        if k == "n_tokens":
                            out.append(len(x))
                        elif k == "ids":
                            out.append(x)
                        elif k == "ids_sha256":
                            out.append(hashlib.sha256(" ".join(map(c.names.__getitem__, x.tolist())).encode()).hexdigest())
                        else:
                            out.append(whole.decode() if k == "decoded" else hashlib.sha256(whole).hexdigest())
                kinds = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32())}
                yield pa.RecordBatch.from_arrays([*(b.column(k).slice(at, len(texts)) for k in range(len(keep))), *(pa.array(v, kinds.get(k, pa.string())) for k, v in columns.items())], names=[*keep, *outputs])

    kept = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]
    return docs.select(*keep, "text").mapInArrow(run, ", ".join([*kept, *(f"{k} {OUTPUTS[k]}" for k in outputs)]))


def decode(rows: DataFrame, ranks: bytes, pattern: str, keep: list[str]) -> DataFrame:
    """rows: the columns to keep and ids, an array<int>. Adds decoded (binary); null lists and ids that are no token decode to nothing."""
    shipped = rows.sparkSession.sparkContext.broadcast(ranks)
    bound_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shipped.value, pattern)
        for b in batches:
            out = c.decode([np.asarray(x or [], np.int32) for x in b.column(len(keep)).to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(out, pa.binary())], names=[*keep, "decoded"])

    kept = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep]
    return rows.select(*keep, "ids").mapInArrow(run, ", ".join([*kept, "decoded binary"]))
