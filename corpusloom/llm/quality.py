"""Quality rules, with repetition measured by a suffix array over a text's words.

The suffixes of a batch's texts are sorted by prefix doubling, each text apart from the others; only suffixes that still
tie are sorted again. Neighbours that a doubling from h to 2h words tells apart share h words and what the suffixes h words on
share, which is the least prefix between those in the order so far; memory is linear in a text's words. A suffix's
deepest longest-common-prefix interval is the greater of its two neighbours' prefixes; the repeat that starts there is
maximal unless the suffix one word to the left has a longer one that ends at the same place. The maximal repeats of at
least MIN_REPEAT words are marked, and the share of the text's words under their union and the longest are limited.

Defined results: a null or empty text has no words and fails the base rules; words are case sensitive; repeated rows are
judged one by one; an empty table gives an empty one. Further columns of the input are ignored by judge().
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bound_batches, map_positions, text_bytes, worker_state

MIN_WORDS = 50
#: Words of the window whose repeats the base rule counts, and percent of the words that may lie in them.
WINDOW, MOST_WINDOW_PERCENT = 3, 50
#: Words of the shortest repeat that the suffix array rule looks at, and its limits.
MIN_REPEAT, MOST_COVERED, MOST_LONGEST = 10, 0.3, 200

SYMBOLS = b"#*$%&|<>"

COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "covered_words", "longest_repeat", "kept"]
SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, covered_words long, longest_repeat long, kept boolean"

_WORD_START = np.array([not (0x80 <= b < 0xC0 or b == 32 or 9 <= b <= 13) for b in range(256)])
_SYMBOL = np.array([b in SYMBOLS for b in range(256)])


#: Bytes of a text whose words or lines are listed at once, and entries under one minimum.
PIECE, UNDER = 1 << 20, 16
_OPEN = np.iinfo(np.int32).max
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


class _Least:
    """Minima of ranges of an array: a sparse table over blocks of UNDER entries."""

    def __init__(self, values: np.ndarray) -> None:
        self.blocks = -(-len(values) // UNDER)
        self.values = np.full((self.blocks + 1) * UNDER, _OPEN, np.int32)
        self.values[: len(values)] = values
        self.levels = [self.values.reshape(-1, UNDER).min(1)]
        while 2 << (len(self.levels) - 1) <= self.blocks:
            half = 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(self.levels[-1][:-half], self.levels[-1][half:]))

    def __call__(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Minima over low to high, both included."""
        out = np.full(len(low), _OPEN, np.int32)
        first, last = low // UNDER, high // UNDER
        for k in range(UNDER):
            for edge in (first, last):
                at = edge * UNDER + k
                inside = (at >= low) & (at <= high)
                out[inside] = np.minimum(out[inside], self.values[at[inside]])
        a, n = first + 1, last - first - 1
        level = np.where(n > 0, np.frexp(np.maximum(n, 1).astype(np.float64))[1] - 1, -1)
        for k, held in enumerate(self.levels):
            here = np.flatnonzero(level == k)
            out[here] = np.minimum(out[here], np.minimum(held[a[here]], held[last[here] - (1 << k)]))
        return out


def longest_repeats(words: np.ndarray, text_of: np.ndarray) -> np.ndarray:
    """For each position: the most words that the suffix there shares with another suffix of its own text.

    words: word numbers of all texts, one after the other; text_of: the text of each position, not decreasing.
    """
    n = len(words)
    best = np.zeros(n, np.int32)
    if n < 2:
        return best
    key = text_of.astype(np.int64) * (int(words.max()) + 1) + words
    sa = np.argsort(key, kind="stable").astype(np.int32)
    key = key[sa]
    first = np.concatenate(([True], key[1:] != key[:-1]))
    rank = np.full(n + 1, -1, np.int32)
    rank[sa] = np.maximum.accumulate(np.where(first, np.arange(n, dtype=np.int32), 0))
    shared = np.where(first, 0, _OPEN).astype(np.int32)  # words that the suffix at each place shares with its left neighbour's
    tied = ~first
    tied[:-1] |= ~first[1:]
    at = np.flatnonzero(tied).astype(np.int32)  # places in sa whose suffixes tie with a neighbour's
    step = 1
    while len(at):
        suffix = sa[at]
        key = rank[suffix].astype(np.int64) * (n + 2) + rank[np.minimum(suffix + step, n)] + 1
        order = np.argsort(key, kind="stable")
        sa[at], key = suffix[order], key[order]
        new = np.concatenate(([True], key[1:] != key[:-1]))
        apart = at[new & (shared[at] == _OPEN)]
        if len(apart):
            i, j = rank[sa[apart - 1] + step], rank[sa[apart] + step]
            shared[apart] = step + _Least(shared)(np.minimum(i, j) + 1, np.maximum(i, j))
        rank[sa[at]] = np.maximum.accumulate(np.where(new, at, 0))
        same = ~new
        same[:-1] |= ~new[1:]
        at, step = at[same], step * 2
    best[sa] = np.maximum(shared, np.append(shared[1:], 0))
    return best


def covered(best: np.ndarray, text_of: np.ndarray, least: int) -> np.ndarray:
    """Whether each position lies in a maximal repeat of at least `least` words."""
    long = best >= least
    inner = np.zeros(len(best), bool)
    inner[1:] = (text_of[1:] == text_of[:-1]) & (best[:-1] == best[1:] + 1)
    starts = np.flatnonzero(long & ~inner)
    edges = np.zeros(len(best) + 1, np.int32)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + best[starts], -1)
    return np.cumsum(edges[:-1], dtype=np.int32) > 0


def _sums(flags: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of flags over runs of these lengths."""
    ends = np.cumsum(lengths)
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int32)))
    return (total[ends] - total[ends - lengths]).astype(np.int64)


def _pieces(text: bytes, cut: re.Pattern[bytes]) -> Iterator[bytes]:
    """The text in pieces of about PIECE bytes, cut behind a match."""
    start = 0
    while len(text) - start > 2 * PIECE:
        found = cut.search(text, start + PIECE)
        if not found:
            break
        yield text[start : found.end()]
        start = found.end()
    yield text[start:] if start else text


_LINE_END = re.compile(rb"\n")


def _dup_lines(text: bytes) -> int:
    if len(text) <= PIECE:
        lines = text.split(b"\n")
        if len(set(lines)) == len(lines):
            return 0
        times = Counter(lines)
    else:
        times = Counter()
        for piece in _pieces(text + b"\n", _LINE_END):
            times.update(piece[:-1].split(b"\n") if piece else [])
    return sum(n - 1 for line, n in times.items() if n > 1 and line.split())


def _of(table: np.ndarray, text: bytes) -> int:
    """How many of the text's bytes the table marks."""
    return sum(int(np.count_nonzero(table[np.frombuffer(text, np.uint8, min(PIECE, len(text) - at), at)])) for at in range(0, len(text), PIECE))


def measure(texts: list[bytes], min_repeat: int = MIN_REPEAT, most_covered: float = MOST_COVERED, most_longest: int = MOST_LONGEST) -> dict[str, np.ndarray]:
    """The columns of COLUMNS for these texts."""
    number: dict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    ids, counts = [np.zeros(0, np.int32)], np.zeros(len(texts), np.int64)
    for k, t in enumerate(texts):
        for piece in _pieces(t, _SPACE):
            words = piece.split()
            counts[k] += len(words)
            ids.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
    text_of = np.repeat(np.arange(len(texts), dtype=np.int32), counts)
    best = longest_repeats(np.concatenate(ids), text_of)
    longest = np.zeros(len(texts), np.int64)
    np.maximum.at(longest, text_of, best)
    # A window that occurs twice starts where a repeat of at least its words does.
    window = best >= WINDOW
    inside = np.zeros(len(best), bool)
    for k in range(WINDOW):
        inside[k:] |= window[: len(best) - k]
    repeated = _sums(inside, counts)
    under = _sums(covered(best, text_of, min_repeat), counts)
    failed = (counts < MIN_WORDS) | (100 * repeated > MOST_WINDOW_PERCENT * counts)
    fine = (under <= most_covered * counts) & (longest <= most_longest)
    return {
        "n_words": counts,
        "word_chars": np.fromiter((_of(_WORD_START, t) for t in texts), np.int64, len(texts)),
        "n_symbols": np.fromiter((_of(_SYMBOL, t) for t in texts), np.int64, len(texts)),
        "n_dup_lines": np.fromiter(map(_dup_lines, texts), np.int64, len(texts)),
        "n_repeat_words": repeated,
        "base_failed": failed,
        "covered_words": under,
        "longest_repeat": longest.astype(np.int64),
        "kept": ~failed & fine,
    }


def _slices(texts: list[bytes], size: int) -> Iterator[tuple[int, int]]:
    """Runs of texts of about `size` bytes."""
    start = total = 0
    for k, t in enumerate(texts):
        if total and total + len(t) > size:
            yield start, k
            start, total = k, 0
        total += len(t)
    if start < len(texts):
        yield start, len(texts)


def judge(docs: DataFrame, **limits) -> DataFrame:
    """doc_id and the columns of COLUMNS for each row."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("quality")
        for b in batches:
            texts = text_bytes(b.column(1))
            for i, j in _slices(texts, 1 << 20):
                found = measure(texts[i:j], **limits)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), *(pa.array(found[c]) for c in COLUMNS)], names=["doc_id", *COLUMNS])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {SCHEMA}")


def keep_good(docs: DataFrame, **limits) -> DataFrame:
    """The rows, with all their columns, that the rules keep. One pass, no shuffle."""
    bound_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("quality")
        for b in batches:
            texts = text_bytes(b.column(at))
            for i, j in _slices(texts, 1 << 20):
                yield b.slice(i, j - i).filter(pa.array(measure(texts[i:j], **limits)["kept"]))

    return map_positions(docs, run, docs.schema.fields)
