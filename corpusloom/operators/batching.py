"""Texts and pairs in the shape that a model wants: truncated by tokens, in batches of similar lengths and a bounded padded size.

A tokenizer turns a text into ids. A model takes padded ids and their mask, both of shape (texts, width), and gives a row of numbers a
text. Each is made by a function that is called once per worker process and name, not once per task. A null text is an empty one,
which has no ids and is still given to the model, with one masked place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import bound_batches, unused

Tokenizer = Callable[[str], list[int]]
Model = Callable[[np.ndarray, np.ndarray], np.ndarray]

#: Tokens of a text, padded tokens of a batch, texts of a batch.
MAX_TOKENS, BATCH_TOKENS, BATCH_TEXTS = 512, 65_536, 256

#: What this worker process has loaded, by name.
_loaded: dict[str, Any] = {}


def loaded(name: str, make: Callable[[], Any]) -> Any:
    """make()'s result, made once in this process for a name."""
    if name not in _loaded:
        _loaded[name] = make()
    return _loaded[name]


def length_batches(lengths: list[int], batch_tokens: int = BATCH_TOKENS, batch_texts: int = BATCH_TEXTS) -> list[list[int]]:
    """Places of texts in batches, longest texts first: no batch has more than batch_tokens with its padding, but for a single text."""
    out: list[list[int]] = []
    width = 0
    for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        if not out or len(out[-1]) >= batch_texts or (len(out[-1]) + 1) * width > batch_tokens:
            out.append([])
            width = max(1, lengths[k])
        out[-1].append(k)
    return out


def run_model(model: Model, ids: list[list[int]], batch_tokens: int = BATCH_TOKENS, batch_texts: int = BATCH_TEXTS) -> np.ndarray:
    """The model's rows for ids, in their order."""
    out: np.ndarray | None = None
    for batch in length_batches([len(x) for x in ids], batch_tokens, batch_texts):
        width = max(1, len(ids[batch[0]]))
        padded, mask = np.zeros((len(batch), width), np.int64), np.zeros((len(batch), width), bool)
        for r, k in enumerate(batch):
            padded[r, : len(ids[k])] = ids[k]
            mask[r, : len(ids[k])] = True
        made = np.asarray(model(padded, mask), np.float64).reshape(len(batch), -1)
        out = np.zeros((len(ids), made.shape[1])) if out is None else out
        out[batch] = made
    return np.zeros((0, 1)) if out is None else out


def encoded(df: DataFrame, column: str, tokenizer: Callable[[], Tokenizer], model: Callable[[], Model], name: str, out: str = "embedding", max_tokens: int = MAX_TOKENS, batch_tokens: int = BATCH_TOKENS, batch_texts: int = BATCH_TEXTS, profile: Any = None) -> DataFrame:
    """Adds the model's vectors of a column's texts (array<float>) and, in n_tokens, how many tokens it was given of each.

    name is the model's: a worker that has it doesn't load it again. profile is a ResourceProfile, for the stage that needs
    accelerators.
    """
    names = df.columns
    at = names.index(column)
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, score = loaded(f"{name} tokenizer", tokenizer), loaded(f"{name} model", model)
        for b in batches:
            if not b.num_rows:
                continue
            ids = [cut(t or "")[:max_tokens] for t in b.column(at).to_pylist()]
            vectors = run_model(score, ids, batch_tokens, batch_texts)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * vectors.shape[1]), pa.array(vectors.astype(np.float32).ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([len(x) for x in ids], pa.int32()), lists], names=[*names, "n_tokens", out])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{kept}, n_tokens int, `{out}` array<float>", profile=profile)


def pair_ids(query: list[int], passage: list[int], max_query: int, max_length: int, separator: int = 0) -> list[int]:
    """A pair's ids: the query cut at max_query, a separator, and what fits of the passage into max_length."""
    head = query[:max_query]
    return [*head, separator, *passage[: max(0, max_length - len(head) - 1)]]


def scored(candidates: DataFrame, tokenizer: Callable[[], Tokenizer], model: Callable[[], Model], name: str, max_query: int = MAX_TOKENS, max_length: int = MAX_TOKENS, batch_tokens: int = BATCH_TOKENS, batch_texts: int = BATCH_TEXTS, profile: Any = None) -> DataFrame:
    """candidates (qid, docid, rank, score, query, passage) with the model's first number as score. A (query, passage) that stands in
    many rows, of several runs or copies of a text, is tokenised and scored once and joined back by its digest."""
    if not 1 <= max_query < max_length:
        raise ValueError("a query has at least one token and leaves room for the passage")
    (key,) = unused(candidates, "pair")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    bound_batches(candidates.sparkSession)
    keyed = candidates.withColumn(key, F.sha2(F.concat(F.sha2(text("query"), 256), F.sha2(text("passage"), 256)), 256))
    each = keyed.select(F.col(key).alias("key"), text("query").alias("query"), text("passage").alias("passage")).dropDuplicates(["key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, score = loaded(f"{name} tokenizer", tokenizer), loaded(f"{name} model", model)
        for b in batches:
            queries = {q: cut(q) for q in set(b.column(1).to_pylist())}
            ids = [pair_ids(queries[q], cut(p), max_query, max_length) for q, p in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(run_model(score, ids, batch_tokens, batch_texts)[:, 0])], names=["key", "new"])

    scores = each.mapInArrow(run, "key string, new double", profile=profile)
    return keyed.join(scores, F.col(key) == F.col("key")).select(*(F.col("new").alias("score") if c == "score" else F.col(c) for c in candidates.columns))
