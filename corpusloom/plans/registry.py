"""The queries over the driver's tables, each with DuckDB SQL for the same rows.

Stand-ins: `documents` is the corpus, `benchmark` the queries, `embeddings` an index whose label says what is relevant; a chunk
is a vector and its document vec_id div 5; a document's sentence vectors are the twenty of one vec_id div 20, in order.
`labels` gives judgements: qid is doc_id mod 20, the type goes by doc_id mod 3, the label is quality, and those of doc_id mod 7
= 0 have failed. Queries of searches are the vectors whose vec_id is divisible by 50. Queries of files write whole tables to the
shared folder and read them back.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions import vector as V
from corpusloom.operators import batching, chunking, evaluation, judgements, labels, retrieval, semantic, tablefunctions, vectorindex
from corpusloom.operators.staging import fresh_path
from corpusloom.sources import dataset, files

from . import experiments

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def windows_sql(size: int, step: int, gate: int = 0) -> str:
    return f"""
WITH d AS (SELECT doc_id, text, length(text) AS n, CASE WHEN length(text) < {size} THEN 0 ELSE (length(text) - {size}) // {step} + 1 END AS whole FROM documents),
w AS (SELECT *, whole + (whole * {step} < n)::INT AS total FROM d),
i AS (SELECT doc_id, text, n, unnest(range(CASE WHEN n < {gate} THEN 1 ELSE total END)) AS i FROM w)
SELECT doc_id, i::INT AS pos, CASE WHEN n < {gate} THEN text ELSE substr(text, i * {step} + 1, {size}) END AS content FROM i"""


@query(windows_sql(512, 462))
def chunk_fixed_512_50(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.explode_chunks(table(spark, sf_dir, "documents"), T.windows(F.col("text"), 512, 50))


@query(windows_sql(50, 50))
def chunk_pieces_50(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.explode_chunks(table(spark, sf_dir, "documents"), T.pieces(F.col("text"), 50))


@query(windows_sql(512, 462, 512))
def short_doc_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.explode_chunks(table(spark, sf_dir, "documents"), T.gated(F.col("text"), T.windows(F.col("text"), 512, 50), 512))


@query(r"""
WITH t AS (SELECT doc_id, text, length(text) AS n, regexp_extract(text, '^([^。？ ！.?!\n]*)[。？ ！.?!\n]', 1) || ' ' AS title, regexp_matches(text, '[。？ ！.?!\n]') AS has FROM documents WHERE length(text) > 0),
l AS (SELECT doc_id, text, n, CASE WHEN has AND length(title) <= 512 / 5 THEN title ELSE '' END AS title FROM t),
r AS (SELECT doc_id, text, title, substr(text, 463) AS rest, 512 - length(title) AS w FROM l),
f AS (SELECT *, CASE WHEN length(rest) < w THEN 0 ELSE (length(rest) - w) // (w - 50) + 1 END AS whole FROM r),
i AS (SELECT *, unnest(range(whole + (whole * (w - 50) < length(rest))::INT)) AS i FROM f)
SELECT doc_id, 0 AS pos, substr(text, 1, 512) AS content FROM l
UNION ALL SELECT doc_id, (i + 1)::INT, title || substr(rest, i * (w - 50) + 1, w) FROM i""")
def chunk_titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.explode_chunks(table(spark, sf_dir, "documents"), T.titled_windows(F.col("text"), 512, 50))


def sentences_sql(ends: str) -> str:
    return f"list_filter(regexp_extract_all(text, '([^{ends}]+(?:[{ends}]|$))', 1), lambda x: regexp_matches(x, '[{ends}]$'))"


@query(f"SELECT doc_id, s.pos::INT AS pos, s.sentence FROM (SELECT doc_id, unnest(list_zip(range(len(l)), l)) AS z FROM (SELECT doc_id, {sentences_sql('。！？,.?!')} AS l FROM documents)), LATERAL (SELECT z[1] AS pos, z[2] AS sentence) s")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))


@query("SELECT doc_id, z[1]::INT AS pos, z[2] AS sentence FROM (SELECT doc_id, unnest(list_zip(range(len(l)), l)) AS z FROM (SELECT doc_id, regexp_extract_all(replace(text, '.', '。'), '[^。！？]+[。！？]') AS l FROM documents))")
def sentence_split_narrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.replace(F.col("text"), F.lit("."), F.lit("。"))
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.sentences(text, T.SENTENCE_END_NARROW)).alias("pos", "sentence"))


@query(f"""
WITH s AS (SELECT doc_id, CASE WHEN len(l) > 0 THEN l ELSE [text] END AS l FROM (SELECT doc_id, text, {sentences_sql('。！？,.?!')} AS l FROM documents)),
g AS (SELECT doc_id, list_reduce(list_transform(l, lambda x: {{'o': []::VARCHAR[], 'c': x}}), lambda a, x: CASE WHEN length(a.c) + length(x.c) <= 512
      THEN {{'o': a.o, 'c': a.c || x.c}} ELSE {{'o': list_append(a.o, a.c), 'c': x.c}} END, {{'o': []::VARCHAR[], 'c': ''}}) AS r FROM s),
c AS (SELECT doc_id, list_filter(list_append(r.o, r.c), lambda x: x <> '') AS l FROM g)
SELECT doc_id, z[1]::INT AS pos, z[2] AS content FROM (SELECT doc_id, unnest(list_zip(range(len(l)), l)) AS z FROM c)""")
def chunk_greedy_512(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = chunking.explode_chunks(table(spark, sf_dir, "documents"), T.greedy(F.col("text"), 512))
    return made


@query(f"""
WITH c AS ({windows_sql(512, 512).strip().replace('SELECT doc_id, i::INT AS pos', 'SELECT doc_id, i AS pos').rstrip()}),
k AS (SELECT doc_id, count(*) AS n FROM c GROUP BY doc_id),
f AS (SELECT doc_id, n, coalesce(sum(n) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM k)
SELECT c.doc_id, c.pos::INT AS pos, 'doc-' || lang || '-' || (first + pos)::BIGINT AS chunk_id FROM c JOIN f USING (doc_id) JOIN documents USING (doc_id)""")
def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return chunking.numbered_positions(docs, T.window_count(F.col("text"), 512), F.col("lang"))


@query(f"SELECT doc_id, min(pos)::INT AS first, count(*) AS n FROM ({windows_sql(512, 462)}) GROUP BY doc_id")
def doc_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.spans(chunk_fixed_512_50(spark, sf_dir))


MARKS, TITLES = "[.?! 。？！\n]", "[。？ ！.?!\n]"
CUT_SQL = f"""CASE WHEN {{start}} + {{room}} >= n THEN n WHEN regexp_matches(substr(text, {{start}} + 2, {{room}}), '{MARKS}')
THEN {{start}} + 1 + length(regexp_extract(substr(text, {{start}} + 2, {{room}}), '(?s)^(.*){MARKS}', 1)) ELSE {{start}} + {{room}} END"""


@query(f"""
WITH RECURSIVE t AS (SELECT doc_id, text, length(text) AS n, regexp_extract(text, '^([^{TITLES[1:]}*){TITLES}', 1) || ' ' AS title, regexp_matches(text, '{TITLES}') AS has FROM documents),
d AS (SELECT doc_id, text, n, CASE WHEN has AND length(title) <= 512 / 5 THEN title ELSE '' END AS lead FROM t WHERE n > 0),
c(doc_id, pos, start, cut) AS (
    SELECT doc_id, 0, 0::BIGINT, {CUT_SQL.format(start='0', room='512')} FROM d
    UNION ALL SELECT c.doc_id, pos + 1, cut, {CUT_SQL.format(start='cut', room='(512 - length(lead))')} FROM c JOIN d USING (doc_id) WHERE cut < n)
SELECT doc_id, pos::INT AS pos, lead || substr(text, start + 1, cut - start) AS content FROM c JOIN d USING (doc_id)""")
def chunk_at_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.mark_chunks(table(spark, sf_dir, "documents"), 512, keep_title=True)


@query()
def chunk_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiments.chunk(table(spark, sf_dir, "documents"), "bert")


@query()
def chunk_semantic_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiments.chunk(table(spark, sf_dir, "documents"), "bge_small")


@query()
def chunk_buffered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents by the buffered splitter, with the default encoder; tests/ hold it against a plain version."""
    return semantic.buffered_chunks(table(spark, sf_dir, "documents"))


@query("SELECT doc_id::VARCHAR AS id, text AS content FROM documents")
def rename_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.renamed(table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "docid"))


@query("SELECT item_id::VARCHAR AS qid, 'Represent this sentence: ' || text AS query FROM benchmark")
def query_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.prefixed(_asked(spark, sf_dir), "Represent this sentence: ")


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("qid"), F.col("text").alias("query"))


def _index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "embeddings")
    return rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), "embedding"), rows.select(F.col("vec_id").alias("docid"), "embedding")


def run_sql(k: int) -> str:
    return f"""SELECT qid, docid, rank, score FROM (SELECT q.vec_id AS qid, d.vec_id AS docid, list_sum(list_transform(list_zip(q.embedding, d.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) AS score,
row_number() OVER (PARTITION BY q.vec_id ORDER BY list_sum(list_transform(list_zip(q.embedding, d.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) DESC, d.vec_id)::INT AS rank
FROM embeddings q, embeddings d WHERE q.vec_id % 50 = 0) WHERE rank <= {k}"""


@query(f"SELECT qid, docid, rank, score FROM ({run_sql(20)})")
def dense_topk_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search by an index in blocks, of which each block of queries reads those that it needs."""
    asked, index = _index(spark, sf_dir)
    path = _written(spark, "index-blocks", lambda path: vectorindex.write(index, path, block_rows=200))
    return vectorindex.Index(spark, path).search(asked, 20)


@query(run_sql(10))
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.search(*_index(spark, sf_dir), 10)


@query(f"SELECT qid, docid, rank, round(score, 6) AS score FROM ({run_sql(10)})")
def dense_topk_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.search_blocks(*_index(spark, sf_dir), 10).withColumn("score", F.round("score", 6))


@query(f"SELECT qid, docid, rank, score FROM ({run_sql(100)}) WHERE rank <= 7")
def run_topk_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.cut(retrieval.search(*_index(spark, sf_dir), 100), 7)


@query(f"""SELECT qid, docid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, first)::INT AS rank, score
FROM (SELECT qid, docid // 5 AS docid, max(score) AS score, min(rank) AS first FROM ({run_sql(100)}) GROUP BY 1, 2)""")
def maxp_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, index = _index(spark, sf_dir)
    of = index.select(F.col("docid").alias("chunk_id"), F.expr("docid div 5").alias("doc_id"))
    return retrieval.lift(retrieval.search(*_index(spark, sf_dir), 100), of)


@query(f"SELECT qid, docid, rank, score FROM ({run_sql(100)}) WHERE docid % 3 = 0")
def unmatched_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, index = _index(spark, sf_dir)
    known = index.where("docid % 3 <> 0").select(F.col("docid").alias("chunk_id"), F.lit(0).alias("doc_id"))
    return retrieval.unmatched(retrieval.search(*_index(spark, sf_dir), 100), known)


@query(f"SELECT qid, docid, row_number() OVER (PARTITION BY qid ORDER BY (docid % 4) DESC, rank)::INT AS rank, (docid % 4)::DOUBLE AS score FROM ({run_sql(50)})")
def rerank_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.reranked(retrieval.search(*_index(spark, sf_dir), 50).withColumn("score", (F.col("docid") % 4).cast("double")))


def _passages_run(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("docid"), F.col("text").alias("content"))
    n = F.lit(table(spark, sf_dir, "benchmark").count())  # items are numbered from 0
    run = docs.select((F.pmod(F.col("docid").cast("long"), n)).cast("string").alias("qid"), "docid", (F.floor(F.col("docid").cast("long") / n) + 1).cast("int").alias("rank"), (-F.col("docid").cast("double")).alias("score"))
    return run, docs


@query("""SELECT b.item_id::VARCHAR AS qid, d.doc_id::VARCHAR AS docid, (d.doc_id // (SELECT count(*) FROM benchmark) + 1)::INT AS rank, b.text AS query, d.text AS passage
FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark)""")
def query_passage_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    run, docs = _passages_run(spark, sf_dir)
    return retrieval.pairs(run, _asked(spark, sf_dir), docs).drop("score")


@query(r"""
WITH p AS (SELECT b.item_id, d.doc_id, list_distinct(regexp_extract_all(lower(b.text), '\S+')) AS q, regexp_extract_all(lower(d.text), '\S+') AS t
           FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark)),
s AS (SELECT item_id, doc_id, CASE WHEN len(q) > 0 THEN len(list_intersect(q, t)) / len(q) ELSE 0 END AS score FROM p)
SELECT item_id::VARCHAR AS qid, doc_id::VARCHAR AS docid, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, score::DOUBLE AS score FROM s""")
def rerank_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    run, docs = _passages_run(spark, sf_dir)
    return retrieval.reranked(retrieval.scored(retrieval.pairs(run, _asked(spark, sf_dir), docs), lambda: retrieval.shared_words))


@query(f"SELECT concat_ws(' ', qid, 'Q0', docid, rank, printf('%.6f', score), 'Faiss') AS value FROM ({run_sql(10)})")
def run_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.run_lines(dense_topk(spark, sf_dir), F.format_string("%.6f", F.col("score")))


@query("""SELECT item_id::VARCHAR AS qid, CASE WHEN count(*) OVER () < 7 THEN 6 ELSE least((row_number() OVER (ORDER BY item_id::VARCHAR) - 1) // (count(*) OVER () // 7), 6) END::INT AS shard FROM benchmark""")
def shard_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.sharded(_asked(spark, sf_dir).select("qid"), 7)


def _sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 20").alias("doc"), "vec_id", "embedding", F.concat(F.lit("s"), F.col("vec_id").cast("string"), F.lit(".")).alias("part"))


SIMS_SQL = """SELECT doc, vec_id, list_sum(list_transform(list_zip(embedding, lead(embedding) OVER (PARTITION BY doc ORDER BY vec_id)), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) AS raw,
lead(vec_id) OVER (PARTITION BY doc ORDER BY vec_id) AS next FROM (SELECT *, vec_id // 20 AS doc FROM embeddings)"""
SIM_SQL = f"SELECT doc, vec_id, CASE WHEN next IS NOT NULL THEN raw END AS sim FROM ({SIMS_SQL})"


@query(SIM_SQL)
def adjacent_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantic.neighbour_similarity(_sentences(spark, sf_dir), "doc", "vec_id").select("doc", "vec_id", "sim")


@query("""WITH e AS (SELECT doc, vec_id, embedding, lead(embedding) OVER (PARTITION BY doc ORDER BY vec_id) AS n FROM (SELECT *, vec_id // 20 AS doc FROM embeddings))
SELECT doc, vec_id, round(list_cosine_similarity(embedding::DOUBLE[], n::DOUBLE[]), 9) AS sim FROM e""")
def adjacent_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantic.neighbour_similarity(_sentences(spark, sf_dir), "doc", "vec_id", measure=V.cosine).select("doc", "vec_id", F.round("sim", 9).alias("sim"))


@query(f"SELECT doc, round(avg(sim), 9) AS mean, round(quantile_cont(sim, 0.05), 9) AS p05 FROM ({SIM_SQL}) GROUP BY doc")
def similarity_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    sims = adjacent_similarity(spark, sf_dir)
    return sims.groupBy("doc").agg(F.round(F.avg("sim"), 9).alias("mean"), F.round(F.percentile("sim", F.lit(0.05)), 9).alias("p05"))


@query(f"SELECT t.threshold, count(*) FILTER (WHERE sim < t.threshold) AS cuts FROM ({SIM_SQL}), (VALUES (0.0::DOUBLE), (0.1::DOUBLE), (0.45::DOUBLE), (0.7::DOUBLE), (0.8::DOUBLE), (0.87::DOUBLE)) t(threshold) GROUP BY ALL")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = spark.createDataFrame([(x,) for x in (0.0, 0.1, 0.45, 0.7, 0.8, 0.87)], "threshold double")
    return adjacent_similarity(spark, sf_dir).crossJoin(F.broadcast(limits)).groupBy("threshold").agg(F.count_if(F.col("sim") < F.col("threshold")).alias("cuts"))


def cut_sql(limit: str, compat: bool = False) -> str:
    low = "coalesce((sim < limit_)::INT, 0)"
    cut = low if compat else f"coalesce(lag({low}) OVER (PARTITION BY doc ORDER BY vec_id), 0)"
    return f"""
WITH s AS ({SIM_SQL}), t AS (SELECT doc, {limit} AS limit_ FROM s GROUP BY doc),
c AS (SELECT doc, vec_id, {cut} AS cut FROM s JOIN t USING (doc)),
g AS (SELECT doc, vec_id, sum(cut) OVER (PARTITION BY doc ORDER BY vec_id ROWS UNBOUNDED PRECEDING)::BIGINT AS segment FROM c)
SELECT doc, segment, string_agg('s' || vec_id || '.', '' ORDER BY vec_id) AS content FROM g GROUP BY doc, segment"""


def _cut(spark: SparkSession, sf_dir: str, limits: DataFrame, compat: bool = False) -> DataFrame:
    rows = semantic.neighbour_similarity(_sentences(spark, sf_dir), "doc", "vec_id").join(limits, "doc")
    return semantic.segments(semantic.cut_below(rows, "doc", "vec_id", F.col("limit"), compat), "doc", "vec_id", "part")


@query(cut_sql("round(avg(sim), 9)"))
def segment_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cut(spark, sf_dir, similarity_thresholds(spark, sf_dir).select("doc", F.col("mean").alias("limit")))


@query(cut_sql("round(avg(sim), 9)", compat=True))
def segment_threshold_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cut(spark, sf_dir, similarity_thresholds(spark, sf_dir).select("doc", F.col("mean").alias("limit")), compat=True)


@query(cut_sql("list_sort(list(sim) FILTER (WHERE sim IS NOT NULL))[5]"))
def segment_kmins(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = semantic.sequences(_sentences(spark, sf_dir), "doc", "vec_id", "part")
    return _cut(spark, sf_dir, seq.select("doc", V.kth_smallest(F.col("sims"), F.lit(5)).alias("limit")))


@query(f"""
WITH s AS ({SIM_SQL}), t AS (SELECT doc, round(avg(sim), 9) AS limit_ FROM s GROUP BY doc),
r AS (SELECT doc, list({{'x': 's' || vec_id || '.', 'near': before > limit_, 'o': []::VARCHAR[], 'c': ''}} ORDER BY vec_id) AS l
      FROM (SELECT *, lag(sim) OVER (PARTITION BY doc ORDER BY vec_id) AS before FROM s) JOIN t USING (doc) GROUP BY doc),
f AS (SELECT doc, list_reduce(l, lambda a, x: CASE WHEN a.c = '' THEN {{'x': '', 'near': false, 'o': a.o, 'c': x.x}}
      WHEN length(a.c) + length(x.x) <= 30 AND x.near THEN {{'x': '', 'near': false, 'o': a.o, 'c': a.c || x.x}}
      ELSE {{'x': '', 'near': false, 'o': list_append(a.o, a.c), 'c': x.x}} END, {{'x': '', 'near': false, 'o': []::VARCHAR[], 'c': ''}}) AS r FROM r)
SELECT doc, z[1]::INT AS pos, z[2] AS content FROM (SELECT doc, unnest(list_zip(range(len(r.o) + 1), list_append(r.o, r.c))) AS z FROM f)""")
def segment_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = semantic.sequences(_sentences(spark, sf_dir), "doc", "vec_id", "part")
    made = semantic.greedy_segments(F.col("parts"), F.col("sims"), 30, F.round(V.mean(F.col("sims")), 9))
    return seq.select("doc", F.explode(made).alias("c")).select("doc", F.col("c.pos").alias("pos"), F.col("c.content").alias("content"))


@query(f"""
WITH s AS (SELECT vec_id // 20 AS doc, vec_id, unnest(list_transform(embedding, lambda x: x::DOUBLE)) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
b AS (SELECT doc, vec_id, i, sum(x) OVER (PARTITION BY doc, i ORDER BY vec_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS x FROM s),
v AS (SELECT doc, vec_id, list(x ORDER BY i) AS v FROM b GROUP BY ALL),
g AS (SELECT doc, vec_id, round(1 - list_cosine_similarity(v, lead(v) OVER (PARTITION BY doc ORDER BY vec_id)), 9) AS gap FROM v),
t AS (SELECT doc, quantile_cont(gap, 0.95) AS limit_ FROM g GROUP BY doc),
c AS (SELECT doc, vec_id, coalesce(lag((round(limit_ - gap, 9) < 0)::INT) OVER (PARTITION BY doc ORDER BY vec_id), 0) AS cut FROM g JOIN t USING (doc)),
n AS (SELECT doc, vec_id, sum(cut) OVER (PARTITION BY doc ORDER BY vec_id ROWS UNBOUNDED PRECEDING)::BIGINT AS segment FROM c)
SELECT doc, segment, string_agg('s' || vec_id || '.', '' ORDER BY vec_id) AS content FROM n GROUP BY doc, segment""")
def segment_buffered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of sentences with their neighbours, cut above the 95th percentile of the distances."""
    rows = semantic.cut_above(semantic.buffered_vectors(_sentences(spark, sf_dir), "doc", "vec_id"), "doc", "vec_id")
    return semantic.segments(rows, "doc", "vec_id", "part")


def _qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    asked = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), "label")
    return asked.join(rows.select(F.col("vec_id").alias("docid"), "label"), "label").select("qid", "docid", F.lit(1).alias("relevance"), F.concat(F.lit("l"), (F.col("label") % 3).cast("string")).alias("lang"))


def quality_sql(body: str) -> str:
    return f"""
WITH run AS ({run_sql(100)}), rel AS (SELECT q.vec_id AS qid, d.vec_id AS docid, 'l' || (q.label % 3) AS lang FROM embeddings q JOIN embeddings d ON q.label = d.label WHERE q.vec_id % 50 = 0),
n AS (SELECT qid, any_value(lang) AS lang, count(*) AS n FROM rel GROUP BY qid),
p AS (SELECT qid, docid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, docid DESC) AS place FROM run),
h AS (SELECT qid, sum(1 / log2(place + 1)) AS dcg, count(*) AS got FROM p JOIN rel USING (qid, docid) WHERE place <= 10 GROUP BY qid),
q AS (SELECT n.qid, n.lang, coalesce(dcg, 0) / list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1 / log2(i + 1))) AS ndcg, coalesce(got, 0) / n AS recall FROM n LEFT JOIN h USING (qid))
{body}"""


@query(quality_sql("SELECT qid, round(ndcg, 9) AS score FROM q"))
def ndcg_at_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = retrieval.search(*_index(spark, sf_dir), 100)
    return evaluation.per_query(run, _qrels(spark, sf_dir), "ndcg@10").select("qid", F.round("score", 9).alias("score"))


@query(quality_sql("SELECT qid, round(recall, 9) AS score FROM q"))
def recall_at_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = retrieval.search(*_index(spark, sf_dir), 100)
    return evaluation.per_query(run, _qrels(spark, sf_dir), "recall@10").select("qid", F.round("score", 9).alias("score"))


@query(quality_sql(""", l AS (SELECT lang, 'ndcg@10' AS metric, avg(ndcg) AS score FROM q GROUP BY lang UNION ALL SELECT lang, 'recall@10', avg(recall) FROM q GROUP BY lang)
SELECT lang, metric, round(score, 9) AS score FROM l UNION ALL SELECT 'average', metric, round(avg(score), 9) FROM l GROUP BY metric"""))
def macro_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = retrieval.search(*_index(spark, sf_dir), 100)
    return experiments.evaluate_languages(run, _qrels(spark, sf_dir), ["ndcg@10", "recall@10"]).withColumn("score", F.round("score", 9))


PAIRS_SQL = """SELECT 'q' || (doc_id % 20) AS qid, doc_id::VARCHAR AS docid, ['original_pos', 'potential_pos', 'false_hard_neg'][doc_id % 3 + 1] AS type,
(CASE WHEN doc_id % 7 = 0 THEN 0 ELSE quality END)::INT AS llm_label, (CASE WHEN doc_id % 7 = 0 THEN -1 ELSE quality END)::INT AS llm_raw_label FROM labels"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = F.col("doc_id") % 7 == 0
    return table(spark, sf_dir, "labels").select(
        F.concat(F.lit("q"), (F.col("doc_id") % 20).cast("string")).alias("qid"),
        F.col("doc_id").cast("string").alias("docid"),
        F.element_at(F.array(*map(F.lit, labels.TYPES)), (F.col("doc_id") % 3 + 1).cast("int")).alias("type"),
        F.when(failed, 0).otherwise(F.col("quality")).cast("int").alias("llm_label"),
        F.when(failed, -1).otherwise(F.col("quality")).cast("int").alias("llm_raw_label"),
    )


@query(f"""SELECT count(*) AS total_pairs, count(*) FILTER (llm_raw_label = -1) AS failed_pairs,
count(*) FILTER (type = 'original_pos') AS original_pos_pairs, count(*) FILTER (type = 'original_pos' AND llm_label = 0) AS bad_original_pos_pairs,
count(*) FILTER (type = 'potential_pos') AS potential_pos_pairs, count(*) FILTER (type = 'potential_pos' AND llm_label = 1) AS real_potential_pos_pairs,
count(*) FILTER (type = 'false_hard_neg') AS false_hard_neg_pairs, count(*) FILTER (type = 'false_hard_neg' AND llm_label = 1) AS real_false_hard_neg_pairs FROM ({PAIRS_SQL})""")
def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.label_counts(_pairs(spark, sf_dir))


@query(f"""SELECT qid, docid, type FROM ({PAIRS_SQL}) WHERE (type = 'original_pos' AND llm_label = 0) OR (type <> 'original_pos' AND llm_label = 1)""")
def label_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad, real, false = labels.split(_pairs(spark, sf_dir))
    return bad.unionByName(real).unionByName(false).select("qid", "docid", "type")


@query(f"SELECT qid, docid, type, CASE WHEN llm_raw_label = -1 THEN 1 ELSE llm_label END::INT AS llm_label, CASE WHEN llm_raw_label = -1 THEN 1 ELSE llm_raw_label END::INT AS llm_raw_label FROM ({PAIRS_SQL})")
def label_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _pairs(spark, sf_dir)
    todo, _ = labels.to_label(pairs, pairs)
    judged = labels.from_table(todo, pairs.select("qid", "docid", F.lit(1).alias("llm_label")))
    return labels.resumed(pairs, judged.select(pairs.columns))


def _triplets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    corpus = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("docid"), "text")
    pairs = _pairs(spark, sf_dir)
    held = lambda kind: F.array_sort(F.collect_list(F.when(F.col("type") == kind, F.struct("docid", "text"))))
    triplets = pairs.join(corpus, "docid").groupBy("qid").agg(held("original_pos").alias("pos"), held("false_hard_neg").alias("hard_neg"))
    return corpus, pairs, triplets


TRIPLETS_SQL = f"""
WITH pairs AS ({PAIRS_SQL}),
bad AS (SELECT DISTINCT qid FROM pairs WHERE type = 'original_pos' AND llm_label = 0), gone AS (SELECT DISTINCT docid FROM pairs WHERE type = 'false_hard_neg' AND llm_label = 1),
held AS (SELECT qid, docid, type FROM pairs JOIN documents d ON d.doc_id = docid::BIGINT WHERE qid NOT IN (FROM bad)),
rel AS (SELECT qid, docid, 1 AS relevance FROM held WHERE type = 'original_pos'
        UNION ALL SELECT h.qid, h.docid, 1 FROM held h JOIN pairs p ON p.qid = h.qid AND p.docid = h.docid WHERE h.type = 'potential_pos' AND p.llm_label = 1 AND h.docid NOT IN (FROM gone)
        UNION ALL SELECT qid, docid, 0 FROM held WHERE type = 'false_hard_neg' AND docid NOT IN (FROM gone)),
qids AS (SELECT DISTINCT qid FROM held)"""


@query(f"SELECT doc_id::VARCHAR AS docid, text FROM documents WHERE doc_id::VARCHAR NOT IN (SELECT docid FROM ({PAIRS_SQL}) WHERE type = 'false_hard_neg' AND llm_label = 1)")
def rebuild_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus, pairs, _ = _triplets(spark, sf_dir)
    return labels.new_corpus(corpus, pairs)


@query(f"{TRIPLETS_SQL} SELECT qid, coalesce(string_agg(docid, ',' ORDER BY docid) FILTER (relevance = 1), '') AS pos, coalesce(string_agg(docid, ',' ORDER BY docid) FILTER (relevance = 0), '') AS hard_neg FROM qids LEFT JOIN rel USING (qid) GROUP BY qid")
def rebuild_triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus, pairs, triplets = _triplets(spark, sf_dir)
    ids = lambda c: F.array_join(F.array_sort(F.col(f"{c}.docid")), ",").alias(c)
    return labels.new_triplets(triplets, pairs, corpus).select("qid", ids("pos"), ids("hard_neg"))


@query(f"{TRIPLETS_SQL} SELECT qid, docid, relevance FROM rel")
def rebuild_qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus, pairs, triplets = _triplets(spark, sf_dir)
    return labels.new_qrels(labels.new_triplets(triplets, pairs, corpus))


def _runs(spark: SparkSession, sf_dir: str) -> tuple[list[DataFrame], DataFrame, DataFrame]:
    run = retrieval.search(*_index(spark, sf_dir), 40)
    other = retrieval.reranked(run.withColumn("score", F.round("score", 1)))
    rel = _qrels(spark, sf_dir)
    return [run, other], rel.where("docid % 2 = 0").select("qid", "docid"), rel.where("docid % 2 = 1").select("qid", "docid")


FILTER_SQL = f"""
WITH a AS ({run_sql(40)}), b AS (SELECT qid, docid, row_number() OVER (PARTITION BY qid ORDER BY round(score, 1) DESC, rank) AS rank FROM a),
w AS (SELECT a.qid, a.docid, greatest(a.rank, b.rank) AS worst FROM a JOIN b USING (qid, docid)),
rel AS (SELECT q.vec_id AS qid, d.vec_id AS docid FROM embeddings q JOIN embeddings d ON q.label = d.label WHERE q.vec_id % 50 = 0),
f AS (SELECT qid, docid, 'potential_pos' AS type FROM w WHERE worst <= 10 AND (qid, docid) NOT IN (FROM rel)
      UNION ALL SELECT qid, docid, 'false_hard_neg' FROM w WHERE worst <= 20 AND docid % 2 = 1 AND (qid, docid) IN (FROM rel))"""


@query(f"{FILTER_SQL} SELECT qid, docid, type FROM f")
def rerank_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.rerank_filter(*_runs(spark, sf_dir))


@query(f"{FILTER_SQL} SELECT qid, docid, type FROM f UNION ALL SELECT qid, docid, 'original_pos' FROM rel WHERE docid % 2 = 0")
def pairs_to_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs, positives, negatives = _runs(spark, sf_dir)
    return labels.all_pairs(positives, labels.rerank_filter(runs, positives, negatives))


@query()
def retrieval_experiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks, vectors, search and documents for the benchmark's items: the best ten documents of each."""
    chunks = experiments.chunk(table(spark, sf_dir, "documents"), "easy_chunk")
    _, docs = experiments.embed_and_search(chunks, _asked(spark, sf_dir), hits=100)
    return retrieval.cut(docs, 10)


# Files: what is written is read back.


def _written(spark: SparkSession, name: str, write: Callable[[str], None]) -> str:
    path = fresh_path(spark, name)
    write(path)
    return path


@query("SELECT doc_id::VARCHAR AS id, text AS content FROM documents")
def hub_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("docid"), "text", "lang")
    return files.read_hub(spark, _written(spark, "hub-corpus", lambda path: docs.write.parquet(path)))


@query("SELECT item_id::VARCHAR AS qid, 'Find: ' || text AS query FROM benchmark")
def hub_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _asked(spark, sf_dir).withColumnRenamed("qid", "query_id")
    return files.read_queries(spark, _written(spark, "hub-queries", lambda path: asked.write.parquet(path)), instruction="Find: ")


@query("SELECT doc_id::VARCHAR AS id, text AS content FROM documents")
def json_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.read_json(spark, _written(spark, "json-corpus", lambda path: rename_corpus(spark, sf_dir).write.json(path)))


@query("SELECT CASE WHEN doc_id % 9 <> 0 THEN text END AS text FROM documents")
def gz_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose id is divisible by 9 have no passage; the others their text first."""
    docs = table(spark, sf_dir, "documents")
    one = lambda text: F.struct(F.col("doc_id").cast("string").alias("docid"), text.alias("text"))
    held = F.when(F.col("doc_id") % 9 != 0, F.array(one(F.col("text")), one(F.lit("second")))).otherwise(F.array_repeat(one(F.lit("")), 0))
    return files.read_passages(spark, _written(spark, "passages", lambda path: docs.select("lang", held.alias("positive_passages")).write.option("compression", "gzip").json(path)))


@query(f"SELECT doc_id || '-' || pos AS chunk_id, doc_id, pos, content, lang FROM ({windows_sql(512, 462)}) JOIN documents USING (doc_id)")
def chunk_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = chunking.with_ids(chunking.explode_chunks(table(spark, sf_dir, "documents"), T.windows(F.col("text"), 512, 50), keep=("doc_id", "lang")))
    return spark.read.parquet(_written(spark, "chunks", lambda path: files.write_chunks(made, path, partition=("lang",)))).select("chunk_id", "doc_id", "pos", "content", "lang")


@query("SELECT 'c' || vec_id AS chunk_id, len(embedding)::INT AS width, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 6) AS norm FROM embeddings")
def index_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("c"), F.col("vec_id").cast("string")).alias("chunk_id"), "embedding", "label")
    back = spark.read.parquet(_written(spark, "index", lambda path: files.write_index(vectors, path)))
    return back.select("chunk_id", F.size("embedding").alias("width"), F.round(V.dot(F.col("embedding"), F.col("embedding")), 6).alias("norm"))


@query(f"SELECT qid::VARCHAR AS qid, docid::VARCHAR AS docid, rank, round(score, 6) AS score FROM ({run_sql(10)}) WHERE rank <= 8")
def run_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run of ten hits, cut at nine when it is written and at eight when it is read."""
    path = _written(spark, "run", lambda path: files.write_run(dense_topk(spark, sf_dir), path, max_hits=9, decimals=6))
    return files.read_run(spark, path, top_k=8).withColumn("score", F.round("score", 6))


RERANKED_SQL = ORACLES["rerank_scored"]


@query(f"SELECT r.qid, r.docid, r.rank, round(r.score, 9) AS score, b.text AS query, d.text AS passage FROM ({RERANKED_SQL}) r JOIN benchmark b ON b.item_id::VARCHAR = r.qid JOIN documents d ON d.doc_id::VARCHAR = r.docid")
def reranked_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    run, docs = _passages_run(spark, sf_dir)
    pairs = retrieval.scored(retrieval.pairs(run, _asked(spark, sf_dir), docs), lambda: retrieval.shared_words)
    again = retrieval.pairs(retrieval.reranked(pairs), _asked(spark, sf_dir), docs)
    path = _written(spark, "reranked", lambda path: files.write_reranked(again, path))
    return files.read_json(spark, path, "qid string, docid string, rank int, score double, query string, passage string").withColumn("score", F.round("score", 9))


@query(f"SELECT qid, docid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, prior)::INT AS rank, round(1 / (1 + exp(-score)), 9) AS score FROM (SELECT *, docid::BIGINT // (SELECT count(*) FROM benchmark) AS prior FROM ({RERANKED_SQL}))")
def rerank_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The experiment of reranking, over documents as their own chunks, with scores from 0 to 1: every prior hit is scored."""
    run, docs = _passages_run(spark, sf_dir)
    chunks = docs.select(F.col("docid").alias("chunk_id"), F.col("docid").alias("doc_id"), "content")
    _, by_document = experiments.rerank(run, _asked(spark, sf_dir), chunks, top_k=2**31 - 1, normalise=True)
    return by_document.withColumn("score", F.round("score", 9))


@query(PAIRS_SQL)
def pairs_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.read_json(spark, _written(spark, "pairs", lambda path: files.write_pairs(_pairs(spark, sf_dir), path)), files.PAIRS)


def _benchmark_files(spark: SparkSession, sf_dir: str) -> str:
    corpus, pairs, triplets = _triplets(spark, sf_dir)
    made = labels.new_triplets(triplets, pairs, corpus)
    return _written(spark, "benchmark", lambda path: files.write_benchmark(labels.new_corpus(corpus, pairs), made, labels.new_qrels(made), path))


@query(ORACLES["rebuild_corpus"])
def benchmark_corpus_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.read_json(spark, files.benchmark_folder(spark, _benchmark_files(spark, sf_dir), "corpus"), files.HUB_CORPUS)


@query(ORACLES["rebuild_qrels"])
def benchmark_qrels_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.read_qrels(spark, files.benchmark_folder(spark, _benchmark_files(spark, sf_dir), "qrels"))


@query(ORACLES["rebuild_triplets"])
def benchmark_triplets_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files.read_json(spark, files.benchmark_folder(spark, _benchmark_files(spark, sf_dir), "test_data"), files.TRIPLETS)
    ids = lambda c: F.array_join(F.array_sort(F.col(f"{c}.docid")), ",").alias(c)
    return rows.select("qid", ids("pos"), ids("hard_neg"))


@query(ORACLES["macro_average"])
def metrics_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _written(spark, "metrics", lambda path: files.write_metrics(macro_average(spark, sf_dir), path))
    back = files.read_json(spark, path, "lang string, scores map<string, double>")
    return back.select("lang", F.explode("scores").alias("metric", "score"))


@query("SELECT 'first' AS written, item_id FROM benchmark UNION ALL SELECT 'kept', item_id FROM benchmark UNION ALL SELECT 'replaced', item_id + 1000 FROM benchmark")
def kept_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An output that exists stays unless it is to be replaced."""
    rows = table(spark, sf_dir, "benchmark").select("item_id")
    other = rows.select((F.col("item_id") + 1000).alias("item_id"))
    out = None
    path = fresh_path(spark, "kept")
    for name, given, overwrite in (("first", rows, False), ("kept", other, False), ("replaced", other, True)):
        files.write_pairs(given, path, overwrite)
        # Read into a table of its own, as the output is replaced.
        copy = _written(spark, "kept-copy", lambda to: spark.read.schema("item_id long").json(path).write.parquet(to))
        now = spark.read.parquet(copy).select(F.lit(name).alias("written"), "item_id")
        out = now if out is None else out.unionByName(now)
    return out


@query(f"SELECT qid::VARCHAR AS qid, docid::VARCHAR AS docid, rank, round(score, 6) AS score FROM ({run_sql(10)})")
def merged_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searched by shards of the queries, each with a file of its own, and read together."""
    asked, index = _index(spark, sf_dir)
    shards = retrieval.sharded(asked, 3)
    if not files.complete(shards, 3):
        raise ValueError("a shard has no query")
    runs = [retrieval.search(shards.where(F.col("shard") == k).drop("shard"), index, 10) for k in range(3)]
    path = _written(spark, "shards", lambda path: files.write_sharded(runs, path))
    return files.read_sharded(spark, path, 3).withColumn("score", F.round("score", 6))


# Datasets, logs and merged inputs.


def _dataset(spark: SparkSession, sf_dir: str) -> str:
    """The benchmark's files before it is relabelled: the corpus, and a line of test data for each query that has a pair."""
    corpus, _, triplets = _triplets(spark, sf_dir)
    asked = triplets.select("qid", F.concat(F.lit("what is "), "qid").alias("query"), "pos", "hard_neg")
    return _written(spark, "dataset", lambda path: (corpus.write.json(f"{path}/corpus"), asked.write.json(f"{path}/test_data")))


HELD_SQL = f"SELECT qid, docid, type FROM ({PAIRS_SQL}) JOIN documents d ON d.doc_id = docid::BIGINT"


@query(f"""SELECT 'query' AS kind, qid, 'what is ' || qid AS value FROM (SELECT DISTINCT qid FROM ({HELD_SQL}))
UNION ALL SELECT CASE type WHEN 'original_pos' THEN 'positive' ELSE 'negative' END, qid, docid FROM ({HELD_SQL}) WHERE type <> 'potential_pos'
UNION ALL SELECT 'document', doc_id::VARCHAR, md5(text) FROM documents""")
def dataset_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The data source's tables of one benchmark folder."""
    path = _dataset(spark, sf_dir)
    of = lambda table, kind, key, value: dataset.read(spark, path, table).select(F.lit(kind).alias("kind"), F.col(key).alias("qid"), value.alias("value"))
    asked, found = of("queries", "query", "qid", F.col("query")), of("corpus", "document", "docid", F.md5("text"))
    return asked.unionByName(of("positives", "positive", "qid", F.col("docid"))).unionByName(of("negatives", "negative", "qid", F.col("docid"))).unionByName(found)


@query(f"{TRIPLETS_SQL} SELECT qid, docid, relevance FROM rel")
def dataset_relabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark read by the data source, judged, and made anew."""
    path = _dataset(spark, sf_dir)
    made = labels.new_triplets(dataset.read(spark, path, "triplets"), _pairs(spark, sf_dir), dataset.read(spark, path, "corpus"))
    return labels.new_qrels(made)


@query("""SELECT 'q' || (doc_id % 20) AS qid, doc_id::VARCHAR AS docid, ['original_pos', 'potential_pos', 'false_hard_neg'][doc_id % 3 + 1] AS type,
(doc_id % 2)::INT AS llm_label, (doc_id % 2)::INT AS llm_raw_label FROM labels""")
def judgement_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judged in batches by a judge that fails for some pairs, which another is asked for again."""
    log = judgements.JudgementLog(spark, fresh_path(spark, "judgements"))
    pairs = _pairs(spark, sf_dir)
    log.judge(pairs, _judge, batch_pairs=20_000)
    return log.judge(pairs, lambda: lambda b: b.assign(llm_label=(b["docid"].astype("int64") % 2).astype("int32"), llm_raw_label=(b["docid"].astype("int64") % 2).astype("int32"))[["qid", "docid", "type", "llm_label", "llm_raw_label"]])


@query("""SELECT doc_id::VARCHAR AS docid, CASE WHEN doc_id % 5 = 0 THEN 'second: ' || text WHEN doc_id % 3 = 0 THEN 'first: ' || text ELSE text END AS text FROM documents""")
def merged_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping inputs: the corpus, then two corrections of parts of it."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("docid"), "text", "doc_id")
    some = lambda n, text: docs.where(F.col("doc_id") % n == 0).select("docid", text.alias("text"))
    return files.last_wins([docs.select("docid", "text"), some(3, F.concat(F.lit("first: "), "text")), some(5, F.concat(F.lit("second: "), "text"))], "docid")


# Models' inputs.


def _word_lengths() -> Callable:
    """A tokenizer for tests of the surface: a word's id is its length."""
    return lambda text: [len(w) for w in text.split()]


def _mean_id() -> Callable:
    """A model for tests of the surface: how many ids it sees, and their mean."""
    return lambda ids, mask: np.stack([mask.sum(1), np.where(mask, ids, 0).sum(1) / np.maximum(mask.sum(1), 1)], 1)


WORDS_SQL = r"regexp_extract_all(text, '\S+')"


@query(f"""SELECT doc_id, len(w)::INT AS n_tokens, len(w)::DOUBLE AS seen, round(coalesce(list_avg(list_transform(w, lambda x: length(x))), 0)::FLOAT, 4)::DOUBLE AS mean_id
FROM (SELECT doc_id, {WORDS_SQL}[:300] AS w FROM documents)""")
def model_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut at 300 tokens, in batches of similar lengths."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = batching.encoded(docs, "text", _word_lengths, _mean_id, "mean id", max_tokens=300, batch_tokens=4096)
    at = lambda k: F.get("embedding", F.lit(k))
    return made.select("doc_id", "n_tokens", at(0).cast("double").alias("seen"), F.round(at(1), 4).cast("double").alias("mean_id"))


@query(f"""WITH p AS (SELECT b.item_id::VARCHAR AS qid, d.doc_id::VARCHAR AS docid, {WORDS_SQL.replace('text', 'b.text')}[:20] AS q, {WORDS_SQL.replace('text', 'd.text')} AS t
           FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark))
SELECT qid, docid, len(q || [''] || t[:127 - len(q)])::DOUBLE AS score FROM p""")
def reranker_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of 128 tokens at most, 20 of them the query's; the score is the number of them. Two runs hold each pair, and it is scored once."""
    run, docs = _passages_run(spark, sf_dir)
    both = retrieval.pairs(run.unionByName(run.withColumn("rank", F.col("rank") + 1)), _asked(spark, sf_dir), docs)
    return batching.scored(both, _word_lengths, _mean_id, "pair size", max_query=20, max_length=128, batch_tokens=8192).groupBy("qid", "docid").agg(F.max("score").alias("score"))


# Table functions.


@query(windows_sql(512, 462))
def chunk_sql_lateral(spark: SparkSession, sf_dir: str) -> DataFrame:
    tablefunctions.register(spark)
    return spark.sql("SELECT d.doc_id, c.pos, c.content FROM {docs} d, LATERAL chunk_text(d.text, 'easy_chunk', 512, 50) c", docs=table(spark, sf_dir, "documents"))


@query(f"SELECT lang, doc_id, pos, content FROM ({ORACLES['chunk_greedy_512']}) JOIN documents USING (doc_id)")
def chunk_sql_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    tablefunctions.register(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return spark.sql("SELECT lang, doc_id, pos, content FROM chunk_table(TABLE(SELECT * FROM {docs}) PARTITION BY (doc_id), 'chunk', 512, 0)", docs=docs)


# Dispatch, judges and levels.

TITLED_SQL = ORACLES["chunk_titled"]


@query(f"""SELECT doc_id || '-' || 0 AS chunk_id, doc_id, 0 AS pos, text AS content FROM documents WHERE length(text) < 512
UNION ALL SELECT doc_id || '-' || pos, doc_id, pos, content FROM ({TITLED_SQL}) JOIN documents USING (doc_id) WHERE length(text) >= 512""")
def air_chunk_titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiments.air_chunk(table(spark, sf_dir, "documents"), "chunk_with_title", 512, 50, at_marks=False)


@query(f"""SELECT doc_id || '-' || 0 AS chunk_id, doc_id, 0 AS pos, text AS content FROM documents WHERE length(text) < 512
UNION ALL SELECT doc_id || '-' || pos, doc_id, pos, content FROM ({ORACLES['chunk_at_marks']}) JOIN documents USING (doc_id) WHERE length(text) >= 512""")
def air_chunk_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiments.air_chunk(table(spark, sf_dir, "documents"), "chunk_with_title", 512)


@query(f"SELECT doc_id || '-' || pos AS chunk_id, doc_id, pos, content FROM ({ORACLES['chunk_greedy_512']}) JOIN documents USING (doc_id) WHERE length(text) >= 512 UNION ALL SELECT doc_id || '-' || 0, doc_id, 0, text FROM documents WHERE length(text) < 512")
def chunk_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiments.chunk(table(spark, sf_dir, "documents"), "chunk")


@query(f"""SELECT 'no_segment' AS method, doc_id || '-0' AS chunk_id, doc_id, 0 AS pos, text AS content FROM documents
UNION ALL SELECT 'easy_chunk', doc_id || '-' || pos, doc_id, pos, content FROM ({windows_sql(400, 340, 400)})
UNION ALL SELECT 'chunk', chunk_id, doc_id, pos, content FROM ({ORACLES['chunk_dispatch']})""")
def chunk_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The methods that need no encoder, each by its name."""
    docs = table(spark, sf_dir, "documents")
    made = {"no_segment": {}, "easy_chunk": {"max_length": 400, "overlap": 60}, "chunk": {}}
    out = None
    for method, given in made.items():
        one = experiments.chunk(docs, method, **given).select(F.lit(method).alias("method"), "chunk_id", "doc_id", "pos", "content")
        out = one if out is None else out.unionByName(one)
    return out


@query()
def chunk_semantic_narrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older variant: fewer ends of sentences, of which full stops become one, and windows and segments of 500; tests/ hold it
    against a plain version."""
    docs = table(spark, sf_dir, "documents").withColumn("text", F.replace("text", F.lit("."), F.lit("。")))
    return semantic.semantic_chunks(docs, "slide_window", window=500, max_length=500, ends=T.SENTENCE_END_NARROW)


def _judge() -> Callable:
    """A judge for tests of the surface: an odd docid is good, one divisible by 7 fails."""

    def judged(pairs):
        n = pairs["docid"].astype("int64")
        raw = (n % 2).where(n % 7 != 0, labels.FAILED).astype("int32")
        return pairs[["qid", "docid", "type"]].assign(llm_label=raw.clip(lower=0), llm_raw_label=raw)

    return judged


@query("SELECT 'q' || (doc_id % 20) AS qid, doc_id::VARCHAR AS docid, ['original_pos', 'potential_pos', 'false_hard_neg'][doc_id % 3 + 1] AS type, CASE WHEN doc_id % 7 = 0 THEN 0 ELSE doc_id % 2 END::INT AS llm_label, CASE WHEN doc_id % 7 = 0 THEN -1 ELSE doc_id % 2 END::INT AS llm_raw_label FROM labels")
def judged_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.labelled(_pairs(spark, sf_dir), _judge, files.PAIRS)


@query(f"SELECT 'chunk' AS level, qid, docid, rank FROM ({run_sql(100)}) UNION ALL SELECT 'document', qid, docid, rank FROM ({ORACLES['maxp_lift']})")
def level_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = retrieval.search(*_index(spark, sf_dir), 100)
    at = lambda name, doc_run: evaluation.at_level(run, doc_run).select(F.lit(name).alias("level"), "qid", "docid", "rank")
    return at("chunk", None).unionByName(at("document", maxp_lift(spark, sf_dir)))
