"""Readers and writers. Ids are strings in every schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import commit

# The schemas and the run's constant fields.
CORPUS = "id string, content string"
HUB_CORPUS = "docid string, text string"
QUERIES = "qid string, query string"
PAIRS = "qid string, docid string, type string, llm_label int, llm_raw_label int"
TRIPLETS = "qid string, pos array<struct<docid:string,text:string>>, hard_neg array<struct<docid:string,text:string>>"
TAG = "Faiss"


def mode(overwrite: bool) -> str:
    """Existing outputs are kept unless told otherwise."""
    return "overwrite" if overwrite else "ignore"


def renamed(docs: DataFrame) -> DataFrame:
    """(docid, text) as (id, content)."""
    return docs.select(F.col("docid").cast("string").alias("id"), F.col("text").alias("content"))


def read_json(spark: SparkSession, path: str, schema: str = CORPUS) -> DataFrame:
    """JSON lines, plain or gzip (by the name's ending)."""
    return spark.read.schema(schema).json(path)


def read_hub(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A corpus in columns docid and text, as (id, content)."""
    return renamed(spark.read.format(fmt).load(path))


def read_queries(spark: SparkSession, path: str, fmt: str = "parquet", instruction: str | None = None) -> DataFrame:
    """(qid, query) from query_id or qid, with an instruction before each query if there is one."""
    rows = spark.read.format(fmt).load(path)
    query = F.concat(F.lit(instruction), "query") if instruction else F.col("query")
    return rows.select(F.col("query_id" if "query_id" in rows.columns else "qid").cast("string").alias("qid"), query.alias("query"))


def read_passages(spark: SparkSession, path: str) -> DataFrame:
    """(text) of each line's first positive passage."""
    return read_json(spark, path, "positive_passages array<struct<docid:string,text:string>>").select(F.get("positive_passages", F.lit(0))["text"].alias("text"))


def write_chunks(chunks: DataFrame, path: str, overwrite: bool = False, partition: tuple[str, ...] = ()) -> None:
    """The chunk table; the document of each chunk is a column, not a second file."""
    chunks.write.mode(mode(overwrite)).partitionBy(*partition).parquet(path)


def write_index(vectors: DataFrame, path: str, overwrite: bool = False) -> None:
    """(chunk_id, embedding)."""
    vectors.select("chunk_id", "embedding").write.mode(mode(overwrite)).parquet(path)


#: White space in any script: it parts a line's fields, so no id may hold it.
_SPACE = r"[\s\x{85}\p{Z}]"
#: A run's six fields and a judgement's four. The first two and those after the docid hold no space; what stands between is the docid.
_RUN_LINE = r"^\s*(\S+)\s+(\S+)\s+(\S.*?)\s+(\S+)\s+(\S+)\s+(\S+)\s*$"
_QRELS_LINE = r"^\s*(\S+)\s+(\S+)\s+(\S.*?)\s+(\S+)\s*$"


def _id(name: str) -> Column:
    """An id that a line can hold; a null or empty one, or one with white space, is an error."""
    c = F.col(name).cast("string")
    wrong = F.raise_error(F.concat(F.lit(f"{name} can't be written to a line: "), F.coalesce(c, F.lit("null"))))
    return F.when(c.isNull() | (c == "") | c.rlike(_SPACE), wrong).otherwise(c)


def _parsed(spark: SparkSession, path: str | list[str], pattern: str, fields: dict[str, tuple[int, str]]) -> DataFrame:
    """Fields of a file's lines: nothing is quoted or escaped. Blank lines are skipped, others that don't fit are an error."""
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*$"))
    wrong = F.raise_error(F.concat(F.lit("no such line is expected: "), F.col("value")))
    line = F.when(F.col("value").rlike(pattern), F.col("value")).otherwise(wrong)
    return lines.select(*(F.regexp_extract(line, pattern, k).cast(kind).alias(name) for name, (k, kind) in fields.items()))


def run_lines(run: DataFrame, score: Column | None = None, tag: str = TAG) -> DataFrame:
    """A run as lines of text."""
    return run.select(F.concat_ws(" ", _id("qid"), F.lit("Q0"), _id("docid"), F.col("rank").cast("string"), (F.col("score") if score is None else score).cast("string"), F.lit(tag)).alias("value"))


def write_run(run: DataFrame, path: str, max_hits: int | None = None, decimals: int | None = None, overwrite: bool = False, tag: str = TAG) -> None:
    """A run file, cut at max_hits; decimals fixes the score's places."""
    rows = run if max_hits is None else run.where(F.col("rank") <= max_hits)
    score = None if decimals is None else F.format_string(f"%.{decimals}f", "score")
    run_lines(rows.sortWithinPartitions("qid", "rank"), score, tag).write.mode(mode(overwrite)).text(path)


def read_run(spark: SparkSession, path: str | list[str], top_k: int | None = None) -> DataFrame:
    """(qid, docid, rank, score) of a run's first top_k ranks. Of a line with more than six fields, all in the middle are the docid."""
    rows = _parsed(spark, path, _RUN_LINE, {"qid": (1, "string"), "docid": (3, "string"), "rank": (4, "int"), "score": (5, "double")})
    return rows if top_k is None else rows.where(F.col("rank") <= top_k)


def read_shards(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The runs of all shards together; a missing one is an error."""
    return read_run(spark, paths)


def complete(shards: DataFrame, n: int) -> bool:
    """Whether rows of all n shards are there."""
    return shards.agg(F.countDistinct("shard")).first()[0] == n


def write_sharded(runs: list[DataFrame], path: str, overwrite: bool = False, tag: str = TAG) -> bool:
    """The runs of all shards, `shard-0` and so on, which appear together; returns whether it wrote them. Scores are as they are."""
    return commit.write({f"shard-{k}": (run_lines(run, tag=tag), lambda w, to: w.text(to)) for k, run in enumerate(runs)}, path, overwrite)


def read_sharded(spark: SparkSession, path: str, n: int) -> DataFrame:
    """The n shards of write_sharded() together; one that is missing, or has lost a file, is an error."""
    if (found := len(commit.rows(spark, path))) != n:
        raise FileNotFoundError(f"{path} has {found} of {n} shards")
    return read_run(spark, [commit.folder(spark, path, f"shard-{k}") for k in range(n)])


def last_wins(inputs: list[DataFrame], key: str) -> DataFrame:
    """One row per key: that of the last input that has one; of several there, the largest in the order of its columns. A null key is a key."""
    if not inputs:
        raise ValueError("there is nothing to merge")
    columns = inputs[0].columns
    every = None
    for n, df in enumerate(inputs):
        one = df.select(F.struct(*columns).alias("row"), F.lit(n).alias("n"))
        every = one if every is None else every.unionAll(one)
    best = every.groupBy(F.col("row")[key].alias("key")).agg(F.max(F.struct("n", "row")).alias("best"))
    return best.select("best.row.*")


def write_reranked(pairs: DataFrame, path: str, overwrite: bool = False) -> None:
    """JSON lines with query and passage."""
    pairs.select("qid", "docid", "rank", "score", "query", "passage").write.mode(mode(overwrite)).json(path)


def write_pairs(pairs: DataFrame, path: str, overwrite: bool = False) -> None:
    pairs.write.mode(mode(overwrite)).json(path)


def write_benchmark(corpus: DataFrame, triplets: DataFrame, qrels: DataFrame, path: str, overwrite: bool = False) -> bool:
    """corpus and test_data as JSON lines, qrels as lines of fields; all three appear together. Returns whether it wrote them."""
    tables = {
        "corpus": (corpus.select("docid", "text"), lambda w, to: w.json(to)),
        "test_data": (triplets, lambda w, to: w.json(to)),
        "qrels": (qrels_lines(qrels), lambda w, to: w.text(to)),
    }
    return commit.write(tables, path, overwrite)


def benchmark_folder(spark: SparkSession, path: str, table: str) -> str:
    """Where a table of write_benchmark() lies; a missing file is an error."""
    return commit.folder(spark, path, table)


def qrels_lines(qrels: DataFrame) -> DataFrame:
    """Judgements as lines of four fields, parted by tabs."""
    return qrels.select(F.concat_ws("\t", _id("qid"), F.lit("Q0"), _id("docid"), F.col("relevance").cast("string")).alias("value"))


def read_qrels(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(qid, docid, relevance) of lines parted by tabs or spaces."""
    return _parsed(spark, path, _QRELS_LINE, {"qid": (1, "string"), "docid": (3, "string"), "relevance": (4, "int")})


def write_metrics(scores: DataFrame, path: str, overwrite: bool = False) -> None:
    """One JSON line per language: {lang, scores: {metric: score}}."""
    scores.groupBy("lang").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "score")))).alias("scores")).coalesce(1).write.mode(mode(overwrite)).json(path)
