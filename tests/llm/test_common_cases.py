"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.llm import bpe, ctw, entries, importance, linededup, media, merkle, mixing, quality, simhash, toolchat, urlfilter, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{k % 997}x{k}" for k in range(30_000))
ODD = [
    (1, "A small text, twice.\nAnother line.", "en", "a", 34),
    (1, "A small text, twice.\nAnother line.", "en", "a", 34),
    (1, "another text under the same id", "en", "b", 30),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (None, "no id here", "de", None, 10),
    (None, "no id here", "de", None, 10),
    (4, " \n\t\n ", "en", "b", 5),
    (5, LONG, "en", "c", len(LONG)),
    (6, "é你😀  x", "zh", "", 6),
    (7, "\x00\x1f#*$%&|<>", "en", "c", 10),
]


def docs_of(spark, rows=ODD):
    return spark.createDataFrame(rows, DOCS)


def clashing(df):
    """With columns that have the names operators use inside."""
    names = ["_gone", "gone", "id", "hash", "place", "key", "words", "times", "copy", "fp", "block", "train", "row", "size", "kept", "n_words", "root", "component_id", "a.b", "pos", "line", "site", "first"]
    return df.withColumns({n: F.lit(f"own {n}") for n in names})


RANKS = entries.byte_bpe()
OPERATORS = {
    "ctw": lambda d: ctw.score(d, F.col("doc_id") % 2 == 0),
    "bpe": lambda d: bpe.tokenize(d, *RANKS, keep=["doc_id"], outputs=list(bpe.OUTPUTS)),
    "media": lambda d: media.features(media.payload_media(d), ["doc_id", "n_bytes"]),
    "mixing": mixing.mixed,
    "lines": lambda d: linededup.remove_boilerplate(d, counts=True),
    "simhash": simhash.near_duplicates,
    "quality": quality.judge,
    "merkle": lambda d: merkle.edited_copies(d).drop("next_text", "next_tree", "edited", "edited_tree"),
    "importance": lambda d: importance.resampled(d, d, percent=50, least_words=0),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operator_gives_a_row_for_each(spark, name):
    op = OPERATORS[name]
    ids = lambda df: sorted((r.doc_id for r in df.select("doc_id").collect()), key=lambda x: (x is None, x))
    want = ids(docs_of(spark))
    plain = op(docs_of(spark))
    assert ids(plain) == want
    # Neither other columns nor the rows' order or partitions change a value.
    values = lambda df: sorted((repr([r[c] for c in plain.columns]) for r in df.select(*plain.columns).collect()))
    again = op(clashing(docs_of(spark, ODD[::-1]).repartition(3)))
    assert values(again) == values(plain)
    assert op(docs_of(spark, [])).count() == 0


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stage(spark, k):
    _, stage = corpus_pipeline.STAGES[k]
    for rows in (ODD, []):
        for make in (lambda d: d, clashing):
            docs = make(docs_of(spark, rows))
            out = stage(spark, docs, "")
            if k < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
            got = out.collect()
            assert bool(got) <= bool(rows)
            if k < len(corpus_pipeline.STAGES) - 1 and make is clashing:
                assert all(r["_gone"] == "own _gone" and r["a.b"] == "own a.b" for r in got)


def test_odd_pages(spark, tmp_path):
    rows = [(1, "http://a.com/x", "same"), (1, "http://a.com/x", "same"), (2, "HTTP://B.org", "same"), (3, None, None), (4, "no scheme", ""), (None, "http://c.net/es/1?q", "x" * 100_000), (5, "http://\r\n evil", "x" * 100_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({n: F.lit(n) for n in ("shard", "digest", "host", "rule")})
    folder = warc.write(pages, f"file://{tmp_path}/w")
    got = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.read(spark, folder).collect()), key=str)
    want = [(1, "response", None, 4), (1, "revisit", 1, 4), (2, "revisit", 1, 4), (3, "response", None, 0), (4, "revisit", 3, 0), (None, "revisit", 5, 100_000), (5, "response", None, 100_000)]
    assert got == sorted(want, key=str)
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(pages, entries.URL_RULES).collect()}
    assert found[1] == ("a.com", "/x", "com/", "allow") and found[2] == ("b.org", "", None, "allow") and found[3] == found[4] == ("", "", None, "allow")
    assert found[None] == ("c.net", "/es/1", "net/es/", "block")
    none = pages.limit(0)
    assert warc.read(spark, warc.write(none, f"file://{tmp_path}/e")).count() == 0
    assert urlfilter.judge(none, entries.URL_RULES).count() == 0


def test_odd_messages(spark):
    rows = [(1, 0, "user", "hello"), (1, 0, "user", "hello"), (1, 1, "assistant", None), (2, None, None, None), (None, 3, "user", "q"), (None, 4, "assistant", ""), (3, 0, "assistant", "first"), (3, 1, "user", "x" * 200_000)]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({n: F.lit(n) for n in ("kind", "json", "depth", "id")})
    out = toolchat.tool_chats(messages, {"reply": entries.REPLY}).collect()
    assert len(out) == len(rows)
    assert sorted((r.status for r in out if r.conv_id == 1)) == ["linked", "linked", "linked"]
    assert {r.position for r in out if r.conv_id == 1} == {0, 1, 2}
    assert [r.valid for r in out if r.conv_id == 3 and r.kind == "call"] == [False]
    assert toolchat.tool_chats(messages.limit(0), {}).count() == 0
