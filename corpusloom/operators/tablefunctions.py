"""Chunkers as table functions of SQL, once register() has named them in a session:

    SELECT d.doc_id, c.pos, c.content FROM docs d, LATERAL chunk_text(d.text, 'easy_chunk', 512, 50) c
    SELECT * FROM chunk_table(TABLE(docs) PARTITION BY (lang), 'chunk', 512, 0)

chunk_text() takes a text; chunk_table() takes a table with a column text and returns its other columns beside pos and content. A method
that isn't a constant or isn't known is an error of the query's analysis. A null or empty text has no chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.types import IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from corpusloom.functions import text as T

METHODS = ("easy_chunk", "chunk", "marks")
_MADE = StructType().add("pos", IntegerType()).add("content", StringType())


def chunks_of(text: str | None, method: str, size: int, overlap: int) -> list[str]:
    """The chunks of one text: windows, packed sentences, or chunks that open with marks."""
    if not text:
        return []
    if method == "easy_chunk":
        return T.windows_of(text, size, overlap)
    return T.greedy_of(text, size) if method == "chunk" else T.cut_at_marks(text, size)


def _checked(method: AnalyzeArgument, size: AnalyzeArgument, overlap: AnalyzeArgument) -> None:
    if not all(x.isConstantExpression for x in (method, size, overlap)) or method.value not in METHODS:
        raise ValueError(f"method, size and overlap are constants, method one of {', '.join(METHODS)}")
    T.checked_window(size.value, overlap.value)
    if method.value == "marks" and size.value < 2:
        raise ValueError("the window is too small")


class ChunkText:
    @staticmethod
    def analyze(text: AnalyzeArgument, method: AnalyzeArgument, size: AnalyzeArgument, overlap: AnalyzeArgument) -> AnalyzeResult:
        _checked(method, size, overlap)
        return AnalyzeResult(schema=_MADE)

    def eval(self, text: str, method: str, size: int, overlap: int) -> Iterator[tuple[int, str]]:
        yield from enumerate(chunks_of(text, method, size, overlap))


class ChunkTable:
    @staticmethod
    def analyze(rows: AnalyzeArgument, method: AnalyzeArgument, size: AnalyzeArgument, overlap: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or "text" not in rows.dataType.names:
            raise ValueError("chunk_table takes a table with a column text")
        if clash := {"pos", "content"} & set(rows.dataType.names):
            raise ValueError(f"the table has a column {', '.join(sorted(clash))} already")
        _checked(method, size, overlap)
        kept = [f for f in rows.dataType.fields if f.name != "text"]
        return AnalyzeResult(schema=StructType([*kept, *_MADE.fields]))

    def eval(self, row: Row, method: str, size: int, overlap: int) -> Iterator[tuple]:
        names = row.__fields__
        at = names.index("text")
        kept = [v for k, v in enumerate(row) if k != at]
        for pos, content in enumerate(chunks_of(row[at], method, size, overlap)):
            yield (*kept, pos, content)


def register(spark: SparkSession) -> None:
    """Names chunk_text and chunk_table in the session."""
    from pyspark.sql.functions import udtf

    spark.udtf.register("chunk_text", udtf(ChunkText))
    spark.udtf.register("chunk_table", udtf(ChunkTable))
