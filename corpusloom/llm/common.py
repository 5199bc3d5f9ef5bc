"""What the operators share: words, what a worker keeps, and columns of any name; staged tables, running sums and Arrow batch
limits come from the engine's own operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from corpusloom.operators.staging import bound_batches, fresh_path, parts_for, running, shared_dir, staged, unused

__all__ = ["WORD", "bound_batches", "columns_of", "fresh_path", "lower_ascii", "map_positions", "n_words", "parts_for", "running", "shared_dir", "staged", "text_bytes", "unused", "worker_state"]

#: A word, everywhere in this subpackage: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower_ascii(c: Column) -> Column:
    """A-Z lower-cased and nothing else."""
    return F.translate(c, UPPER, UPPER.lower())


def n_words(c: Column) -> Column:
    """Number of words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


#: What the operator that a worker process runs at present keeps from task to task.
_kept: dict[str, dict] = {}


def worker_state(name: str) -> dict:
    """A dict that stays in a worker process while it runs tasks of one operator. Another operator's task drops it, as workers
    serve all of them and their memory is one."""
    if name not in _kept:
        had = bool(_kept)
        _kept.clear()
        _kept[name] = {}
        if had:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # only glibc gives freed memory back on request
                ctypes.CDLL("libc.so.6").malloc_trim(0)
    return _kept[name]


def text_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The texts as UTF-8; null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    raw = column.cast(pa.large_binary() if large else pa.binary())
    return [x or b"" for x in raw.to_pylist()]


def columns_of(df: DataFrame) -> list[Column]:
    """All columns by quoted names, so that dots in names are just that."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def map_positions(df: DataFrame, run, fields: list[StructField]) -> DataFrame:
    """mapInArrow for columns of any name: run sees and yields c0, c1 and so on; the result has these fields."""
    plain = df.toDF(*(f"c{k}" for k in range(len(df.columns))))
    return plain.mapInArrow(run, StructType([StructField(f"c{k}", f.dataType) for k, f in enumerate(fields)])).toDF(*(f.name for f in fields))
