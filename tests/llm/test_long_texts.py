"""Texts of several megabytes, whole, for every operator over texts."""

import base64
import hashlib
import json

import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.llm import bpe, ctw, entries, linededup, media, mixing, nearcopies, quality, simhash, toolchat, urlfilter, warc

LINES = [f"line {k} has word{k % 4999} and é{k % 313}" for k in range(100_000)]
LONG = "\n".join(LINES)
SAME = "again " * 600_000


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, LONG, "a"), (2, "short text", "b"), (3, SAME, "a"), (4, LONG + "\nend", "b")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(2)


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_bpe(docs):
    raw, pattern = entries.byte_bpe()
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}, special_tokens={})
    got = rows(bpe.tokenize(docs, raw, pattern, ["doc_id"], ["n_tokens", "ids_sha256", "decoded_sha256"]))
    for k, t in ((1, LONG), (3, SAME)):
        ids = library.encode_ordinary(t)
        assert (got[k].n_tokens, got[k].ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert got[k].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_quality(docs):
    got = rows(quality.judge(docs))
    assert (got[1].n_words, got[1].n_dup_lines) == (600_000, 0) and got[1].n_words == len(LONG.split())
    assert (got[3].n_words, got[3].longest_repeat, got[3].covered_words, got[3].kept) == (600_000, 599_999, 600_000, False)


def test_media(docs):
    got = rows(media.features(media.store(media.payload_media(docs)), ["doc_id", "n_bytes"]))
    raw = LONG.encode()
    assert got[1].n_bytes == len(raw) and got[1].payload_sha256 == hashlib.sha256(raw.ljust(-(-len(raw) // 64) * 64, b"\0")).hexdigest()


def test_scores_and_prints(docs):
    scored = rows(ctw.score(docs, F.col("doc_id") != 4))
    assert scored[1].n_tokens == 600_001 and scored[3].n_tokens == 600_001 and scored[4].n_known == scored[4].n_tokens - 1
    assert scored[1].bytes_scored == len(" ".join(LONG.split()).encode()) + 1 and scored[3].score > scored[1].score
    prints = rows(simhash.near_duplicates(docs))
    words = LONG.split()
    votes = [0] * 64
    for k in range(0, len(words) - 2):
        h = xxhash.xxh64_intdigest(" ".join(words[k : k + 3]).encode(), 42)
        for b in range(64):
            votes[b] += h >> b & 1
    assert prints[1].fp & (2**64 - 1) == sum(1 << b for b in range(64) if 2 * votes[b] > len(words) - 2)
    assert sorted(r.doc_id for r in nearcopies.keep_one(docs).collect()) == [1, 2, 3]


def test_lines_and_mix(docs):
    left = rows(linededup.remove_boilerplate(docs, min_sites=2, counts=True))
    assert left[1].text == LONG and left[4].n_removed == 100_000 and left[4].text == "end"
    assert rows(mixing.mixed(docs))[1]["size"] == 600_000


def test_pages(spark, tmp_path):
    page = "<html>" + LONG + '<a href="http://b.net/">b</a></html>'
    url = "http://a.com/" + "path/" * 400_000
    pages = spark.createDataFrame([(1, url, page), (2, "http://b.net/es/", page), (3, "http://c.org/", "short")], "page_id long, url string, html string").repartition(2)
    got = {r.page_id: r for r in warc.read(spark, warc.write(pages, f"file://{tmp_path}/w")).collect()}
    digest = base64.b32encode(hashlib.sha1(page.encode()).digest()).decode()
    assert [(got[k].payload_bytes, got[k].payload_digest, got[k].record_type, got[k].refers_to) for k in (1, 2)] == [(len(page.encode()), digest, "response", None), (len(page.encode()), digest, "revisit", 1)]
    judged = {r.page_id: r for r in urlfilter.judge(pages, entries.URL_RULES).collect()}
    assert judged[1].path == url.removeprefix("http://a.com") and judged[1].rule == "com/" and judged[2].verdict == "block"


def test_messages(spark):
    rows = [(1, 0, "user", LONG), (1, 1, "assistant", SAME), (1, 2, "user", "again, and long enough")]
    got = {r.turn: r for r in toolchat.tool_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), {"reply": entries.REPLY}).collect()}
    assert [got[k].status for k in range(3)] == ["linked", "linked", "unanswered"] and [got[k].valid for k in range(3)] == [False, None, True]
    assert json.loads(got[0].json)["arguments"] == {"prompt": LONG, "turn": 0} and json.loads(got[1].json)["content"] == SAME


def test_stages(spark, docs):
    own = spark.createDataFrame([(5, "\n".join(f"u{k} v{k} w{k}" for k in range(200_000)), "b")], docs.schema)  # no word twice
    whole = docs.unionByName(own).withColumns({"lang": F.lit("en"), "n_chars": F.length("text").cast("long")})
    assert sorted(r.doc_id for r in corpus_pipeline.quality_rules(spark, whole, "").collect()) == [5]
    mixed = rows(corpus_pipeline.source_mix(spark, whole, ""))
    assert mixed and set(mixed) <= {1, 2, 3, 4, 5} and all(len(mixed[k].text) == mixed[k].n_chars for k in mixed)
