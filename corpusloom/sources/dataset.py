"""A benchmark's files as a data source: spark.read.format("retrieval_dataset").option("table", ...).load(folder).

The folder has a corpus (docid, text) and test data (qid, query, pos, hard_neg), each a file or folder of JSON lines, plain or gzip:
`corpus*` and `test_data*`. Tables are `corpus`, `queries`, `positives`, `negatives`, `pairs` (those to be judged: the positives with the
type original_pos) and `triplets`; each has a schema of its own. A partition reads a range of a file's bytes, from the first line that
begins in it, or a whole gzip file. Lines come to Spark as Arrow batches; other fields are ignored, missing ones are null, and blank
lines are skipped.

Python lists and opens the files, by pyarrow's file systems, so a path has a scheme that those know: file, hdfs, s3, gs, or none.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute
import pyarrow.fs
import pyarrow.json
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

NAME = "retrieval_dataset"
_DOCS = "array<struct<docid:string,text:string>>"
#: The schema of each table, and the files that it is read from.
TABLES = {
    "corpus": ("docid string, text string", "corpus"),
    "queries": ("qid string, query string", "test_data"),
    "positives": ("qid string, docid string", "test_data"),
    "negatives": ("qid string, docid string", "test_data"),
    "pairs": ("qid string, docid string, type string", "test_data"),
    "triplets": (f"qid string, pos {_DOCS}, hard_neg {_DOCS}", "test_data"),
}
RANGE_BYTES = 32 << 20
#: Rows of a batch that goes to Spark.
BATCH_ROWS = 4096
_DOC = pa.list_(pa.struct([("docid", pa.string()), ("text", pa.string())]))
_LINES = {"corpus": pa.schema([("docid", pa.string()), ("text", pa.string())]), "test_data": pa.schema([("qid", pa.string()), ("query", pa.string()), ("pos", _DOC), ("hard_neg", _DOC)])}


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int | None  # None: a gzip file, whole


def _store(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("/") else (pa.fs.LocalFileSystem(), path)


def _lines(part: Range, root: str) -> Iterator[bytes]:
    """Blocks of whole lines that begin in a range."""
    fs, _ = _store(root)
    if part.end is None:
        with fs.open_input_stream(part.path, compression=None) as raw, gzip.open(raw) as f:
            while block := f.readlines(RANGE_BYTES):
                yield b"".join(block)
        return
    with fs.open_input_file(part.path) as f:
        f.seek(max(0, part.start - 1))
        if part.start:
            _skip_line(f)
        at = f.tell()
        if at >= part.end:
            return
        block = f.read(part.end - at)
        if not block.endswith(b"\n"):
            block += _skip_line(f)
        yield block


def _skip_line(f: pa.NativeFile) -> bytes:
    """Reads to the end of a line."""
    out = []
    while piece := f.read(1 << 16):
        end = piece.find(b"\n")
        if end >= 0:
            f.seek(f.tell() - len(piece) + end + 1)
            return b"".join([*out, piece[: end + 1]])
        out.append(piece)
    return b"".join(out)


class Reader(DataSourceReader):
    def __init__(self, path: str, table: str) -> None:
        self.path, self.table = path, table

    def partitions(self) -> list[InputPartition]:
        fs, at = _store(self.path)
        kind = TABLES[self.table][1]
        found = fs.get_file_info(pa.fs.FileSelector(at, recursive=True))
        out: list[InputPartition] = []
        for f in sorted(found, key=lambda f: f.path):
            parts = f.path.removeprefix(at).strip("/").split("/")
            if f.type != pa.fs.FileType.File or not parts[0].startswith(kind) or parts[-1].startswith(("_", ".")):
                continue
            if f.path.endswith(".gz"):
                out.append(Range(f.path, 0, None))
            else:
                out += [Range(f.path, s, min(f.size, s + RANGE_BYTES)) for s in range(0, f.size, RANGE_BYTES)]
        if not out and not any(f.path.removeprefix(at).strip("/").startswith(kind) for f in found):
            raise FileNotFoundError(f"{self.path} has no {kind}")
        return out

    def read(self, partition: InputPartition | None) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, Range):
            return
        kind = TABLES[self.table][1]
        for block in _lines(partition, self.path):
            if not block.strip():
                continue
            rows = pa.json.read_json(
                io.BytesIO(block),
                read_options=pa.json.ReadOptions(use_threads=False, block_size=len(block) + 1),
                parse_options=pa.json.ParseOptions(explicit_schema=_LINES[kind], unexpected_field_behavior="ignore"),
            )
            yield from self._made(rows.select(_LINES[kind].names)).to_batches(BATCH_ROWS)

    def _made(self, rows: pa.Table) -> pa.Table:
        """The table's rows from those of the file."""
        if self.table == "corpus":
            return rows
        if self.table in ("queries", "triplets"):
            return rows.select(["qid", "query"] if self.table == "queries" else ["qid", "pos", "hard_neg"])
        docs = rows["hard_neg" if self.table == "negatives" else "pos"].combine_chunks()
        docs = docs if isinstance(docs, pa.ListArray) else pa.concat_arrays(docs.chunks)
        out = {"qid": rows["qid"].take(pa.compute.list_parent_indices(docs)), "docid": pa.compute.struct_field(pa.compute.list_flatten(docs), "docid")}
        if self.table == "pairs":
            out["type"] = pa.array(["original_pos"] * len(out["docid"]), pa.string())
        return pa.table(out)


class RetrievalDataset(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def _table(self) -> str:
        table = self.options.get("table", "")
        if table not in TABLES:
            raise ValueError(f"table is one of {', '.join(TABLES)}")
        return table

    def schema(self) -> str:
        return TABLES[self._table()][0]

    def reader(self, schema: StructType) -> DataSourceReader:
        return Reader(self.options["path"], self._table())


def read(spark: SparkSession, path: str, table: str) -> DataFrame:
    """One table of a benchmark's folder."""
    spark.dataSource.register(RetrievalDataset)
    return spark.read.format(NAME).option("table", table).load(path)
