"""Segmentation by the similarity of neighbouring sentences, and pluggable encoders."""

from __future__ import annotations

from collections.abc import Callable, Generator, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions import vector as V

from .staging import bound_batches

#: Texts to unit vectors. The default needs no model and no file.
Encoder = Callable[[list[str]], np.ndarray]


#: Characters that are hashed at once, but for a longer text; an array of each takes eight bytes.
HASHED = 250_000


def hashed_ngrams(texts: list[str], dim: int = 64, n: int = 3) -> np.ndarray:
    """Unit vectors of hashed character n-grams: deterministic, and no substitute for a learned encoder. Many texts at once."""
    lots = np.cumsum([len(t) + n for t in texts]) // HASHED
    cuts = [0, *(np.flatnonzero(np.diff(lots)) + 1).tolist(), len(texts)]
    made = [_hashed(texts[a:b], dim, n) for a, b in zip(cuts, cuts[1:], strict=False)]
    return made[0] if len(made) == 1 else np.concatenate(made)


def _hashed(texts: list[str], dim: int, n: int) -> np.ndarray:
    """hashed_ngrams() in one go."""
    padded = [f" {t} ".ljust(n) for t in texts]
    sizes = np.array([len(t) for t in padded], np.int64)
    codes = np.frombuffer("".join(padded).encode("utf-32-le"), np.uint32).astype(np.uint64)
    text_of = np.repeat(np.arange(len(texts)), sizes)
    at = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    first = np.flatnonzero(at <= np.repeat(sizes, sizes) - n)
    h = np.zeros(len(first), np.uint64)
    for k in range(n):
        h = (h ^ codes[first + k]) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    place = text_of[first] * dim + (h % np.uint64(dim)).astype(np.int64)
    sign = np.where((h >> np.uint64(20)) & np.uint64(1), 1.0, -1.0)
    out = np.bincount(place, sign, len(texts) * dim).reshape(len(texts), dim)
    lengths = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(lengths == 0, 1, lengths)


def encoded(df: DataFrame, column: str, out: str = "embedding", encoder: Callable[[], Encoder] = lambda: hashed_ngrams) -> DataFrame:
    """Adds the column's vectors (array<float>). encoder makes the model, once per task."""
    names = df.columns
    at = names.index(column)
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder()
        for b in batches:
            vectors = model([t or "" for t in b.column(at).to_pylist()]) if b.num_rows else np.zeros((0, 1))
            flat = pa.array(np.asarray(vectors, np.float32).ravel())
            width = vectors.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * width), flat)
            yield pa.RecordBatch.from_arrays([*b.columns, lists], names=[*names, out])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{kept}, `{out}` array<float>")


def sentence_table(docs: DataFrame, ends: str = T.SENTENCE_END) -> DataFrame:
    """(doc_id, pos, sentence); a text without a sentence is one."""
    found = T.sentences(F.col("text"), ends)
    return docs.select("doc_id", F.posexplode(F.when(F.size(found) > 0, found).otherwise(F.array("text"))).alias("pos", "sentence"))


def parts_of(text: str | None, ends: str = T.SENTENCE_END) -> list[str]:
    """The sentences of one text, or the text where it has none; a null or empty one has no parts."""
    return (T.sentences_of(text, ends) or [text]) if text else []


def sequences(rows: DataFrame, key: str, pos: str, part: str, vector: str = "embedding") -> DataFrame:
    """(key, parts, sims): a row per document with its parts in order and the similarities of neighbours."""
    held = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("pos"), F.col(part).alias("part"), F.col(vector).alias("v")))).alias("_s"))
    return held.select(key, F.transform("_s", lambda x: x["part"]).alias("parts"), V.adjacent(F.transform("_s", lambda x: x["v"])).alias("sims"))


def neighbour_similarity(rows: DataFrame, key: str, pos: str, vector: str = "embedding", measure=V.dot) -> DataFrame:
    """Adds sim, the similarity to the next row of the same key; null for the last."""
    after = F.lead(vector).over(W.partitionBy(key).orderBy(pos))
    return rows.withColumn("_next", after).withColumn("sim", F.when(F.col("_next").isNotNull(), measure(F.col(vector), F.col("_next")))).drop("_next")


def cut_below(rows: DataFrame, key: str, pos: str, threshold: Column, compat: bool = False) -> DataFrame:
    """Adds segment: a new one begins after each sim below the threshold. rows have sim, from neighbour_similarity.

    compat cuts one place earlier, before the first of the two, and so may leave segment 0 empty.
    """
    order = W.partitionBy(key).orderBy(pos)
    low = F.coalesce(F.col("sim") < threshold, F.lit(False)).cast("int")
    cut = low if compat else F.coalesce(F.lag(low).over(order), F.lit(0))
    return rows.withColumn("_cut", cut).withColumn("segment", F.sum("_cut").over(order.rowsBetween(W.unboundedPreceding, 0))).drop("_cut")


def segments(rows: DataFrame, key: str, pos: str, part: str) -> DataFrame:
    """(key, segment, content): the parts of each segment, joined in order."""
    held = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("pos"), F.col(part).alias("part"))))
    return rows.groupBy(key, "segment").agg(F.array_join(F.transform(held, lambda x: x["part"]), "").alias("content"))


def greedy_segments(parts: Column, sims: Column, window: int, threshold: Column) -> Column:
    """Neighbours joined while they fit into the window and are more similar than the threshold."""
    return T.packed(parts, window, links=sims, least=threshold)


def _merging(pieces: list[str], max_length: int, compat: bool = False) -> Generator[list[str], list[np.ndarray], list[str]]:
    """merge_neighbours() in steps: yields the three texts whose vectors it needs, and returns the result."""
    out, i = list(pieces), 1
    while i < len(out) - 1:
        before, here, after = yield out[i - 1 : i + 2]
        left = float(before @ here) > float(after @ here)
        a = i - 1 if left else i
        if len(out[a]) + len(out[a + 1]) < max_length:
            out[a : a + 2] = [out[a] + out[a + 1]]
            i += 1 if left and compat else 0
        else:
            i += 1
    return out


def merge_all(documents: list[list[str]], encoder: Encoder, max_length: int, compat: bool = False) -> list[list[str]]:
    """merge_neighbours() of many documents: each round encodes what all of them need next, at once."""
    out: list[list[str]] = [[] for _ in documents]
    steps, known, asks = {}, [{} for _ in documents], {}

    def go(k: int, answer: list[np.ndarray] | None) -> None:
        try:
            asks[k] = steps[k].send(answer)
        except StopIteration as e:
            out[k] = e.value
            steps.pop(k), asks.pop(k, None)

    for k, pieces in enumerate(documents):
        steps[k] = _merging(pieces, max_length, compat)
        go(k, None)
    while steps:
        new = [(k, t) for k, texts in asks.items() for t in dict.fromkeys(texts) if t not in known[k]]
        if new:
            for (k, t), v in zip(new, encoder([t for _, t in new]), strict=True):
                known[k][t] = v
        for k, texts in list(asks.items()):
            # Only the neighbours of the place are needed again.
            known[k] = {t: known[k][t] for t in texts}
            go(k, [known[k][t] for t in texts])
    return out


def merge_neighbours(pieces: list[str], encoder: Encoder, max_length: int, compat: bool = False) -> list[str]:
    """Inner segments join the neighbour that is more like them, if the two together are shorter than max_length.

    Merged texts are encoded anew, so this goes step by step. compat skips the segment after one that joined its left neighbour.
    """
    return merge_all([pieces], encoder, max_length, compat)[0]


def _folded(parts: list[str], sims: np.ndarray, join: Callable[[str, str, float], bool]) -> list[str]:
    """Parts joined to the one before where join says so."""
    out = list(parts[:1])
    for part, sim in zip(parts[1:], sims.tolist(), strict=True):
        if join(out[-1], part, sim):
            out[-1] += part
        else:
            out.append(part)
    return out


#: Sentences that are encoded at once.
ENCODED = 20_000


def semantic_chunks(docs: DataFrame, kind: str = "threshold", window: int = 512, k: int | None = None, threshold: float | None = None, cluster: bool = True, max_length: int = 512, chunk_length: int = 50, encoder: Callable[[], Encoder] = lambda: hashed_ngrams, ends: str = T.SENTENCE_END) -> DataFrame:
    """(doc_id, pos, content) for documents (doc_id, text): kind is threshold, slide_window or k; the mean similarity of each
    document is its threshold unless one is given. One document of one sentence stays whole; a null or empty one has no chunks.

    A document stays in its row, so nothing is shuffled; the sentences of a batch of documents are encoded together. Texts are split in
    the task's Python too, as the expression for sentences takes several times as long as all the rest.
    """
    if kind not in ("threshold", "slide_window", "k"):
        raise ValueError(f"unknown kind {kind}")
    bound_batches(docs.sparkSession)

    def limit_of(parts: list[str], sims: np.ndarray) -> float:
        if kind != "k":
            return threshold if threshold is not None else float(sims.mean())
        n = k or sum(map(len, parts)) // chunk_length + 1
        return float(np.sort(sims)[min(max(n, 1), len(sims)) - 1])

    def fold(parts: list[str], vectors: np.ndarray) -> list[str]:
        if len(parts) < 2:
            return parts
        sims = np.einsum("ij,ij->i", vectors[:-1], vectors[1:])
        limit = limit_of(parts, sims)
        if kind == "slide_window":
            return _folded(parts, sims, lambda a, b, s: len(a) + len(b) <= window and s > limit)
        return _folded(parts, sims, lambda a, b, s: s >= limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder()
        for b in batches:
            documents = [parts_of(t, ends) for t in b.column(1).to_pylist()]
            flat = [p for x in documents for p in x]
            vectors = [np.asarray(model(flat[i : i + ENCODED]), np.float32).astype(np.float64) for i in range(0, len(flat), ENCODED)]
            whole = np.concatenate(vectors) if vectors else np.zeros((0, 1))
            ends_at = np.cumsum([len(x) for x in documents])
            made = [fold(x, whole[e - len(x) : e]) for x, e in zip(documents, ends_at.tolist(), strict=True)]
            if cluster:
                made = merge_all(made, model, max_length)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.list_(pa.string()))], names=["doc_id", "chunks"])

    held = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, chunks array<string>")
    return held.select("doc_id", F.posexplode("chunks").alias("pos", "content"))


def buffered_texts(parts: list[str], buffer: int = 1) -> list[str]:
    """Each sentence together with `buffer` sentences on both sides."""
    return ["".join(parts[max(0, k - buffer) : k + buffer + 1]) for k in range(len(parts))]


def cut_at_gaps(parts: list[str], vectors: np.ndarray, percentile: float) -> list[str]:
    """Sentences joined, but for cuts where the cosine distance to the next one's vector exceeds the percentile of all such distances."""
    if len(parts) < 2:
        return parts
    lengths = np.linalg.norm(vectors, axis=1)
    unit = vectors / np.where(lengths == 0, 1, lengths)[:, None]
    gaps = 1 - np.einsum("ij,ij->i", unit[:-1], unit[1:])
    cuts = [0, *(np.flatnonzero(gaps > np.quantile(gaps, percentile)) + 1).tolist(), len(parts)]
    return ["".join(parts[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def buffered_chunks(docs: DataFrame, buffer: int = 1, percentile: float = 0.95, encoder: Callable[[], Encoder] = lambda: hashed_ngrams, ends: str = T.SENTENCE_END) -> DataFrame:
    """(doc_id, pos, content) for documents (doc_id, text): sentences are encoded with their neighbours, and a document is cut where the
    distance of consecutive ones is above its own percentile. A text without a sentence is one chunk; a null or empty one has none.

    As semantic_chunks(): a document stays in its row, and the sentences of a batch of documents are encoded together.
    """
    if buffer < 0 or not 0 <= percentile <= 1:
        raise ValueError("the buffer isn't negative, and the percentile is a share")
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder()
        for b in batches:
            documents = [parts_of(t, ends) for t in b.column(1).to_pylist()]
            made: list[list[str]] = []
            held: list[list[str]] = []
            for k, parts in enumerate(documents):
                held.append(parts)
                if sum(map(len, held)) >= ENCODED or k == len(documents) - 1:
                    texts = [t for x in held for t in buffered_texts(x, buffer)]
                    vectors = np.asarray(model(texts), np.float64) if texts else np.zeros((0, 1))
                    ends_at = np.cumsum([len(x) for x in held]).tolist()
                    made += [cut_at_gaps(x, vectors[e - len(x) : e], percentile) for x, e in zip(held, ends_at, strict=True)]
                    held = []
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.list_(pa.string()))], names=["doc_id", "chunks"])

    held = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, chunks array<string>")
    return held.select("doc_id", F.posexplode("chunks").alias("pos", "content"))


def buffered_vectors(rows: DataFrame, key: str, pos: str, buffer: int = 1, vector: str = "embedding") -> DataFrame:
    """Each row's vector summed with those of its neighbours, for encoders of which sentences' vectors are at hand."""
    near = F.collect_list(vector).over(W.partitionBy(key).orderBy(pos).rowsBetween(-buffer, buffer))
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y.cast("double"))
    first = F.transform(F.get(near, F.lit(0)), lambda x: x.cast("double"))
    return rows.withColumn(vector, F.aggregate(F.slice(near, F.lit(2), F.size(near)), first, add))


def cut_above(rows: DataFrame, key: str, pos: str, percentile: float = 0.95, digits: int = 9) -> DataFrame:
    """Adds segment: a new one begins after each row whose cosine distance to the next is above the key's percentile of them."""
    near = neighbour_similarity(rows, key, pos, measure=V.cosine).withColumn("gap", F.round(1 - F.col("sim"), digits))
    limits = near.groupBy(key).agg(F.percentile("gap", F.lit(percentile)).alias("_limit"))
    return cut_below(near.join(limits, key).withColumn("sim", F.round(F.col("_limit") - F.col("gap"), digits)).drop("_limit"), key, pos, F.lit(0.0))
