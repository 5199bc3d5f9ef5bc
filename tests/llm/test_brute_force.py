"""Every operator against a plain version of the same definition."""

import base64
import collections
import hashlib
import io
import itertools
import json
import math
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from corpusloom.llm import bpe, ctw, entries, linededup, media, mixing, quality, simhash, toolchat, urlfilter, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def some_texts(seed, n, words=30, vocabulary=40):
    rng = random.Random(seed)
    bag = ["".join(rng.choice("abcdeéç") for _ in range(rng.randrange(1, 6))) for _ in range(vocabulary)]
    return [rng.choice(["", " "]).join([" ".join(rng.choice(bag) for _ in range(rng.randrange(words)))]) + rng.choice(["", "\n", ". End"]) for _ in range(n)]


def docs_of(spark, texts, sources=None):
    rows = [(k, t, (sources or ["a"])[k % len(sources or ["a"])]) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


# Context-tree weighting


def plain_ctw(train, text, depth):
    """Log2 probability of a text's bytes by the recursive definition."""
    counts = collections.Counter()
    for t in train:
        t = b"\n" * depth + t
        for k in range(depth, len(t)):
            for d in range(depth + 1):
                for i in range(8):
                    counts[t[k - d : k], t[k] >> (8 - i) | 1 << i, t[k] >> (7 - i) & 1] += 1
    seen = {c for c, _, _ in counts}

    def kt(c, node):
        n0, n1 = counts[c, node, 0], counts[c, node, 1]
        return math.lgamma(n0 + 0.5) + math.lgamma(n1 + 0.5) - math.lgamma(n0 + n1 + 1) - math.log(math.pi)

    memo = {}

    def weighted(c, node):
        if (c, node) not in memo:
            k = kt(c, node)
            if len(c) < depth:
                below = sum(weighted(bytes([b]) + c, node) for b in range(256) if bytes([b]) + c in seen)
                memo[c, node] = np.logaddexp(k, below) - math.log(2)
            else:
                memo[c, node] = k
        return memo[c, node]

    def one(c, node, whole):
        n0, n1 = counts[c, node, 0], counts[c, node, 1]
        own = (n1 + 0.5) / (n0 + n1 + 1)
        if len(c) == depth:
            return own
        below = sum(weighted(bytes([b]) + c, node) for b in range(256) if bytes([b]) + c in seen)
        leaf = 1 / (1 + math.exp(min(700, below - kt(c, node))))
        return leaf * own + (1 - leaf) * one(whole[len(whole) - len(c) - 1 :], node, whole)

    total, t = 0.0, b"\n" * depth + text
    for k in range(depth, len(t)):
        for i in range(8):
            p = one(b"", t[k] >> (8 - i) | 1 << i, t[k - depth : k])
            total += math.log2(p if t[k] >> (7 - i) & 1 else 1 - p)
    return total


def test_ctw(spark):
    texts = ["abra cadabra abra", "Abra  abracadabra\n", "cad abra éa", "", "zzz abra"] * 2
    docs = docs_of(spark, texts).repartition(3)
    depth = 3
    got = {r.doc_id: r for r in ctw.score(docs, F.col("doc_id") % 5 != 4, depth=depth).collect()}
    lower = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in texts]
    normal = [" ".join(WORD.findall(t)).encode() + b"\n" for t in lower]
    train = [k for k in range(len(texts)) if k % 5 != 4]
    counts = collections.Counter(w for k in train for w in [*WORD.findall(lower[k]), "\n"])
    n, v = sum(counts.values()), len(counts)
    for k in range(5):
        words = [*WORD.findall(lower[k]), "\n"]
        r = got[k]
        want = plain_ctw([normal[j] for j in train], normal[k], depth)
        assert r.score == pytest.approx(want * math.log10(2), rel=1e-5)
        assert r.bits_per_byte == pytest.approx(-want / len(normal[k]), rel=1e-5)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words))
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (k == 4, len(words), sum(counts[w] > 0 for w in words), n)
        assert got[k + 5].score == r.score


@pytest.mark.parametrize("keys", [1 << 17, 20])
def test_ctw_at_its_own_depth(spark, monkeypatch, keys):
    """Levels within parts too, whose trees are held at once or byte by byte."""
    texts = some_texts(30, 14, words=12, vocabulary=9) + ["abra cadabra abra abra cadabra", ""]
    normal = [" ".join(WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t))).encode() + b"\n" for t in texts]
    train = [k for k in range(len(texts)) if k % 4]
    grams, counts = ctw._counted(np.sort(ctw._grams([normal[k] for k in train], ctw.DEPTH)))
    untrained = np.setdiff1d(ctw._grams(normal, ctw.DEPTH), grams)
    grams, counts = ctw._added(np.concatenate([grams, untrained]), np.concatenate([counts, np.zeros(len(untrained), np.int64)]))
    monkeypatch.setattr(ctw, "KEYS", keys)
    top = ctw.upper(*ctw.above(grams, counts, ctw.DEPTH, ctw.TOP), depth=ctw.TOP - 1)
    found = dict(zip(grams.tolist(), ctw.code_lengths(grams, counts, ctw.DEPTH, ctw.TOP, top).tolist(), strict=True))
    for k in range(len(texts)):
        got = sum(found[g] for g in ctw._grams([normal[k]], ctw.DEPTH).tolist())
        assert got == pytest.approx(plain_ctw([normal[j] for j in train], normal[k], ctw.DEPTH) * math.log10(2), rel=1e-7)
    if keys > 20:
        out = {r.doc_id: r.score for r in ctw.score(docs_of(spark, texts).repartition(3), F.col("doc_id") % 4 != 0).collect()}
        for k in range(len(texts)):
            assert out[k] == pytest.approx(sum(found[g] for g in ctw._grams([normal[k]], ctw.DEPTH).tolist()), rel=1e-5)


def test_pieces_of_a_part(spark, monkeypatch):
    texts = some_texts(31, 30, words=40, vocabulary=300)
    score = lambda: {r.doc_id: (r.score, r.base_score, r.n_known) for r in ctw.score(docs_of(spark, texts), F.col("doc_id") % 3 != 0).collect()}
    want = score()
    monkeypatch.setattr(ctw, "ROW_KEYS", 50)
    assert score() == want


def test_ctw_without_training(spark):
    row = ctw.score(docs_of(spark, ["ab"]), F.lit(False)).first()
    assert row.score == pytest.approx(3 * 8 * math.log10(0.5)) and row.train_tokens == 0 and row.base_score == 0


def test_table_and_planes():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**56, 5000, dtype=np.uint64))
    table = ctw.Table(keys, np.arange(len(keys), dtype=np.float32))
    pick = np.random.default_rng(2).integers(0, len(keys), 20_000)
    assert (table[keys[pick]] == pick).all()
    assert (ctw._unpack(ctw._pack(keys, 7), 7) == keys).all()


# WARC


def test_warc_round_trip_and_determinism(spark, tmp_path):
    rng = random.Random(3)
    html = ["<p>" + "x" * rng.randrange(300) + rng.choice("abc") for _ in range(120)]
    rows = [(k * 7, f"http://h{k % 5}.com/{k}", rng.choice(html)) for k in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    kept = []
    for n, parts in enumerate((3, 11)):
        folder = warc.write(pages.repartition(parts), f"file://{tmp_path}/{n}", shard_bytes=20_000, roll_bytes=1500)
        files = sorted(p for p in (tmp_path / str(n)).iterdir() if p.name.endswith(".warc.gz"))
        kept.append({p.name: p.read_bytes() for p in files})
        assert len(files) > 5 and not (tmp_path / str(n) / "_temporary").exists()
        got = {r.page_id: r for r in warc.read(spark, folder).collect()}
        first = {}
        for k, _, h in rows:
            first.setdefault(h, k)
        for k, u, h in rows:
            r, raw = got[k], h.encode()
            digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
            assert (r.url, r.payload_bytes, r.payload_digest) == (u, len(raw), digest)
            assert (r.record_type, r.refers_to) == (("response", None) if first[h] == k else ("revisit", first[h]))
            assert (r.payload is not None and bytes(r.payload) == raw) == (first[h] == k)
    assert kept[0] == kept[1], "the same pages give the same files, whatever their partitions"


@pytest.mark.parametrize("far", [[], [2**40], [-(2**62), None]])
def test_warc_shards_are_bounded_for_any_ids(spark, tmp_path, far):
    rows = [(k, f"http://h.com/{k}", f"{k} " * 500) for k in [*range(400), *far]]
    folder = warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5), f"file://{tmp_path}/w", shard_bytes=40_000, roll_bytes=10_000_000)
    files = spark.read.parquet(f"{folder}/manifest").orderBy("shard").collect()
    assert 16 <= len(files) <= 30 and max(f.records for f in files) <= 40 and sum(f.records for f in files) == len(rows)
    assert [f.first_id for f in files] == sorted((f.first_id for f in files), key=lambda x: (x is not None, x))
    assert warc.read(spark, folder).count() == len(rows)


def test_one_page_id_fills_many_shards(spark, tmp_path):
    rows = [(7, "http://h.com/", f"{k} " * 500) for k in range(300)] + [(7, "http://h.com/", "same")] * 5
    folder = warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), f"file://{tmp_path}/w", shard_bytes=40_000)
    files = spark.read.parquet(f"{folder}/manifest").collect()
    assert len(files) > 10 and max(f.records for f in files) <= 45
    assert collections.Counter(r.record_type for r in warc.read(spark, folder).collect()) == {"response": 301, "revisit": 4}


def test_warc_finds_changed_files(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a.b/", "x" * 500)], "page_id long, url string, html string")
    folder = warc.write(pages, f"file://{tmp_path}/w")
    (tmp_path / "w" / "part-999999-00000.warc.gz").write_bytes(b"left by a lost task")
    assert warc.read(spark, folder).count() == 1
    file = next(p for p in (tmp_path / "w").iterdir() if p.name.startswith("part-000000"))
    file.write_bytes(file.read_bytes() + warc.record(2, "http://c.d/", b"y", "response", None))
    with pytest.raises(Exception, match="not the file in the manifest"):
        warc.read(spark, folder).collect()


# BPE


def test_bpe_against_the_library(spark):
    import tiktoken

    raw, pattern = entries.byte_bpe()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(4)
    texts = ["", "It's  a\n\n test… of 12345 <|endoftext|> 你好 😀 naïve", "a" * 1500, "ab" * 300 + " tail", "é" * 400, "   ", " \t lead"]
    texts += ["".join(rng.choice("etaoin shrdlu'.,\n0129éü你") for _ in range(rng.randrange(200))) for _ in range(60)]
    out = {r.doc_id: r for r in bpe.tokenize(docs_of(spark, texts), raw, pattern, ["doc_id"], list(bpe.OUTPUTS)).collect()}
    for k, t in enumerate(texts):
        ids = library.encode_ordinary(t)
        assert out[k].ids == ids and out[k].n_tokens == len(ids) and out[k].decoded == t
        assert out[k].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert out[k].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    rows = spark.createDataFrame([(k, library.encode_ordinary(t)) for k, t in enumerate(texts)] + [(99, None)], "doc_id long, ids array<int>")
    back = {r.doc_id: bytes(r.decoded).decode() for r in bpe.decode(rows, raw, pattern, ["doc_id"]).collect()}
    assert back == {**dict(enumerate(texts)), 99: ""}


def test_recursion_and_heap_agree():
    c = bpe.Codec(*entries.byte_bpe())
    rng = random.Random(5)
    words = [bytes(rng.choice(b"etaonrisabcd ") for _ in range(rng.randrange(1, 90))) for _ in range(200)]
    assert c.contract(words) == [c._heap(w) for w in words]


def test_cache_turns_over(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT", 5)
    c = bpe.Codec(*entries.byte_bpe())
    texts = [" ".join(f"word{k}x{j}" for j in range(4)) for k in range(30)] * 2
    got = [b"".join(d).decode() for t in texts for _, d in c.texts([t])]
    assert got == texts


# Tool calls


def test_tool_calls(spark):
    calls = {"tool_calls": [{"id": "c1", "name": "add", "arguments": '{"b": 2, "a": 1}'}, {"id": "c2", "name": "add", "arguments": '{"a": "x"}'}]}
    rows = [
        (1, 0, "system", "be kind"),
        (1, 1, "assistant", json.dumps(calls)),
        (1, 2, "tool", json.dumps({"tool_call_id": "c2", "content": "err"})),
        (1, 3, "tool", json.dumps({"tool_call_id": "c1", "content": "3"})),
        (1, 4, "tool", json.dumps({"tool_call_id": "c1", "content": "again"})),
        (1, 5, "tool", json.dumps({"tool_call_id": "none", "content": "?"})),
        (2, 0, "assistant", json.dumps({"tool_calls": [{"id": "c1", "name": "add", "arguments": "not json"}, {"id": "c9", "name": "other", "arguments": "{}"}]})),
    ]
    schema = {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer", "minimum": 0}, "b": {"type": "integer", "maximum": 5}}}
    out = toolchat.tool_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), {"add": schema}).collect()
    by = {(r.conv_id, r.turn, r.call_id): r for r in out}
    assert by[2, 0, "c1"].status == "unanswered" and by[1, 1, "c1"].status == "linked", "identifiers count within a conversation"
    assert by[1, 1, "c2"].status == by[1, 2, "c2"].status == by[1, 3, "c1"].status == "linked"
    assert by[1, 4, "c1"].status == "duplicate" and by[1, 5, "none"].status == "orphan" and by[2, 0, "c9"].status == "unanswered"
    assert by[1, 1, "c1"].valid is True and by[1, 1, "c2"].valid is False and by[2, 0, "c1"].valid is False and by[2, 0, "c9"].valid is False
    assert by[1, 1, "c1"].json == '{"arguments":{"a":1,"b":2},"id":"c1","name":"add","type":"call"}'
    assert by[2, 0, "c1"].json == '{"arguments":null,"id":"c1","name":"add","type":"call"}'
    place = {(r.turn, r.call_id): r.position for r in out if r.conv_id == 1}
    assert sorted(place.values()) == list(range(7)) and place[2, "c2"] > place[1, "c2"] and place[3, "c1"] > place[1, "c1"]


def test_calls_of_conversations_that_share_identifiers(spark):
    rows = []
    for conv in (1, 2, 3, None):
        calls = {"tool_calls": [{"id": "call_0", "name": "f", "arguments": "{}"}, {"id": "call_0", "name": "g", "arguments": "{}"}]}
        rows += [(conv, 0, "system", "x"), (conv, 1, "assistant", json.dumps(calls)), (conv, 2, "tool", json.dumps({"tool_call_id": "call_0", "content": "1"})), (conv, 3, "user", "more"), (conv, 4, "assistant", "so")]
    out = toolchat.tool_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), {}).collect()
    assert len(out) == 4 * 6
    for conv in (1, 2, 3, None):
        mine = sorted((r for r in out if r.conv_id == conv), key=lambda r: r.position)
        assert [r.position for r in mine] == list(range(6)) and [r.turn for r in mine] == [0, 1, 1, 2, 3, 4]
        assert [r.depth for r in mine] == [0, 1, 1, 2, 3, 4]
        assert sorted(r.status for r in mine) == ["duplicate", "linked", "linked", "linked", "linked", "message"]


def test_canonical_numbers(spark):
    alike = [["1", "1.0", "1e0", "10E-1", "0.1e1", "100e-2"], ["0", "-0", "0.0", "-0.0e5", "0e99999"], ["100", "1e2", "1E+2", "100.00"], ["0.00000015", "1.5e-7", "15E-8"], ["1e300", "10e299"], ["-2.5", "-25e-1", "-2.50"]]
    rows = [(k, j, '{"b":[%s,"%s 1.0"],"a":{"x":%s}}' % (x, x, x), x) for k, xs in enumerate(alike) for j, x in enumerate(xs)]
    found = spark.createDataFrame(rows, "k long, j long, v string, x string").select("k", "j", "x", F.to_json(F.try_parse_json(toolchat.canonical_numbers(F.col("v")))).alias("json")).collect()
    by = collections.defaultdict(set)
    for r in found:
        made = json.loads(r.json)
        assert made["b"][1] == f"{r.x} 1.0" and made["b"][0] == made["a"]["x"] == float(r.x)
        by[r.k].add(r.json.split(",")[0])
    assert {k: len(v) for k, v in by.items()} == dict.fromkeys(range(len(alike)), 1)
    odd = spark.createDataFrame([('{"a":1e400}',), ('{"a":"1e400"}',), ('{"a":01e2}',), ('{"a":1.e5}',), ('{"a\\"1.0":[1.0]}',)], "v string")
    got = [r[0] for r in odd.select(F.to_json(F.try_parse_json(toolchat.canonical_numbers(F.col("v"))))).collect()]
    assert got == [None, '{"a":"1e400"}', None, None, '{"a\\"1.0":[1]}']


@pytest.mark.parametrize("n", [1, 2, 300])
def test_depths(spark, n):
    edges = [(f"e{k}", f"e{k - 1}" if k else None) for k in range(n)] + [("x", "y"), ("y", "x"), ("z", "x"), ("own", "own"), ("stray", "gone")]
    got = {r.id: r.depth for r in toolchat.depths(spark.createDataFrame(edges, "id string, after string")).collect()}
    assert got == {**{f"e{k}": k for k in range(n)}, "x": None, "y": None, "z": None, "own": None, "stray": 0}


@pytest.mark.parametrize(
    "schema, value, want",
    [
        ({"type": "object"}, "{}", True),
        ({"type": "object"}, "[]", False),
        ({"type": "array"}, "[1]", True),
        ({"type": "number", "minimum": 1.5}, "1.5", True),
        ({"type": "integer"}, "1.5", False),
        ({"type": "string", "enum": ["é", "b"]}, '"é"', True),
        ({"type": "string", "maxLength": 1}, '"é"', True),
        ({"type": "boolean"}, "true", True),
        ({"type": "null"}, "null", True),
        ({"type": "object", "required": ["a"]}, "{}", True),
        ({"type": "object", "required": ["a"], "properties": {"a": {}}}, "{}", False),
        ({"type": "object", "properties": {"a": {"type": "object", "properties": {"b": {"type": "string"}}}}}, '{"a":{"b":1}}', False),
    ],
)
def test_schemas(spark, schema, value, want):
    row = spark.createDataFrame([(value,)], "v string").select(toolchat._valid(F.try_parse_json("v"), schema).alias("ok")).first()
    assert row.ok is want


# Media


def test_formats():
    rng = np.random.default_rng(6)
    grey, colour = rng.integers(0, 256, (5, 7), dtype=np.uint8), rng.integers(0, 256, (5, 7, 3), dtype=np.uint8)
    for encode, image in ((media.encode_pgm, grey), (media.encode_bmp, grey), (media.encode_ppm, colour), (media.encode_bmp, colour)):
        assert (media.decode(encode(image)) == image).all()
    assert media.decode(b"P1\n# a comment\n3 2\n1 0 1\n010").tolist() == [[0, 255, 0], [255, 0, 255]]
    assert media.decode(b"P4\n3 2\n" + bytes([0b10100000, 0b01000000])).tolist() == [[0, 255, 0], [255, 0, 255]]
    assert media.decode(b"P2 2 1 15 0 15").tolist() == [[0, 255]]
    assert media.decode(b"P3 1 1 255 1 2 3").tolist() == [[[1, 2, 3]]]
    assert media.decode(b"P5 1 1 65535\n" + b"\xff\xff").tolist() == [[255]]
    for bad in (b"", b"P9", b"P5 4 4 255\nabc", b"BM", b"P5 0 1 255\n", b"P5 x"):
        with pytest.raises((ValueError, IndexError)):
            media.decode(bad)


@pytest.mark.parametrize("h, w", [(1, 64), (8, 9), (3, 5), (17, 64), (40, 13)])
def test_area_resize(h, w):
    image = np.random.default_rng(h).integers(0, 256, (h, w), dtype=np.uint8)
    fine = np.repeat(np.repeat(image, 8, 0), 9, 1).astype(float)
    want = fine.reshape(8, h, 9, w).mean((1, 3))
    assert np.allclose(media.area_resize(image, (8, 9)), want)


def test_media_columns(spark):
    texts = ["", "abc", "é" * 100, "x" * 64, "abc"]
    for fmt in ("pgm", "bmp"):
        out = {r.doc_id: r for r in media.features(media.payload_media(docs_of(spark, texts), fmt), ["doc_id", "n_bytes"]).collect()}
        for k, t in enumerate(texts):
            raw = t.encode()
            padded = raw.ljust(max(1, -(-len(raw) // 64)) * 64, b"\0")
            assert (out[k].n_bytes, out[k].payload_bytes, out[k].payload_sha256) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest())
            tile = np.load(io.BytesIO(bytes(out[k].tile)))
            assert tile.shape == media.TILE and len(out[k].feature) == 16
        assert out[1].feature == out[4].feature and out[1].media_sha256 == out[4].media_sha256
    bad = spark.createDataFrame([(1, b"nothing"), (2, None)], "doc_id long, media binary")
    assert [(r.error is None, r.feature) for r in media.features(bad, ["doc_id"]).orderBy("doc_id").collect()] == [(False, None), (True, None)]


def test_media_that_cannot_be_decoded(spark):
    """A row with its error for each, whatever its header says."""
    big = b"9" * 30
    bad = [b"P5 99999999999 99999999999 255\n", b"P5 " + big + b" 2 255\nab", b"P2 1 1 255\n" + b"1" * 23, b"P3 1 1 255\n1 2", b"P1 3 3\n101", b"P4 99999999999 1\nx", b"P2 1 1 3\n9", b"P5 2 1 7\n\x08\x01", b"P6 4000000000 4000000000 65535\n" + b"x" * 99, b"P2 1 1 255\n-4", b"P5 1 1 " + big + b"\na", b"P5", b"P2 1 1 255\nx", b"BM" + b"\xff" * 60]
    head = media.encode_bmp(np.zeros((2, 2), np.uint8))
    for at in (10, 14, 18, 22, 28, 46):
        for value in (b"\xff\xff\xff\x7f", b"\x00\x00\x00\x80", b"\xff\xff\xff\xff"):
            bad.append(head[:at] + value + head[at + 4 :])
    fine = media.encode_pgm(np.arange(128, dtype=np.uint8).reshape(2, 64))
    rows = [*enumerate(bad), (len(bad), fine)]
    got = {r.doc_id: r for r in media.features(spark.createDataFrame(rows, "doc_id long, media binary").repartition(2), ["doc_id"]).collect()}
    assert len(got) == len(rows) and got[len(bad)].error is None and got[len(bad)].payload_bytes == 128
    for k, b in enumerate(bad):
        assert got[k].media_bytes == len(b) and ((got[k].error is not None) == (got[k].feature is None))
    assert sum(got[k].error is None for k in range(len(bad))) <= 6, "only some headers of BMP can be changed without harm"



# Mixing


def plain_targets(sizes, weights=(3, 1, 2)):
    """Shares what is left by weight, again and again, until no target is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    left, target = 1.5 * sum(sizes.values()), {}
    open_ = set(names)
    while open_:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] > 2 * sizes[s]}
        for s in over or open_:
            target[s] = 2 * sizes[s] if over else level * w[s]
            left -= target[s] if over else 0
        open_ = open_ - over if over else set()
    return target


@pytest.mark.parametrize("seed", range(4))
def test_mixing(spark, seed):
    rng = random.Random(seed)
    rows = [(k, " ".join(["w"] * rng.randrange(40)), rng.choice(["a", "b", "b", "b", "b", "c", "é", "Z", None])) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mixed(docs).collect()
    assert len(out) == 300 and sorted(map(tuple, out), key=str) == sorted(map(tuple, mixing.mixed(docs.repartition(5)).collect()), key=str)
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    want = plain_targets(sizes)
    taken = collections.Counter()
    for r in out:
        taken[r.source] += r.taken
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and r.taken in (0, r.size, 2 * r.size)
    assert all(abs(taken[s] - want[s]) <= 2 * 40 for s in sizes) and sum(taken.values()) <= 1.5 * sum(sizes.values())
    mix = mixing.take_mix(docs).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in mix} == {r.doc_id: r.taken // r.size for r in out if r.taken}


@pytest.mark.parametrize("n", [1, 2, 3, 7])
def test_the_mix_of_repeated_rows_is_what_was_taken(spark, n):
    rows = [(None if k % 2 else 5, "w " * 10, "a", k) for k in range(n)] + [(100 + k, "w " * (3 + k), "b", k) for k in range(2)] + [(9, "x " * 10, "a", 50), (9, "y " * 10, "a", 51)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n long")
    taken = collections.Counter()
    for r in mixing.mixed(docs).collect():
        taken[r.doc_id, r.source] += r.taken
    got, times = collections.Counter(), collections.Counter()
    for r in mixing.take_mix(docs).collect():
        got[r.doc_id, r.source] += len(r.text.split())
        times[r.source, r.n] += 1
    assert got == +taken and max(times.values()) <= 2
    assert mixing.take_mix(docs.repartition(3)).count() == sum(times.values())


def test_mix_order(spark):
    docs = docs_of(spark, ["w " * 10] * 60, ["a", "b", "c"])
    rows = mixing.staged(mixing.sized(docs), "t")
    mix, _ = mixing.fair_queue(rows)
    got = mix.orderBy("ends").collect()
    assert [r.finish for r in got] == sorted(r.finish for r in got)
    assert [r.ends for r in got] == list(itertools.accumulate(r["size"] for r in got))


# Line dedup


def test_line_dedup(spark):
    rng = random.Random(7)
    common = [f"boilerplate number {k}" for k in range(4)]
    texts = ["\n".join(rng.choice([*common, f"own line {k} {j}", "", "  ", "near threshold"]) for j in range(6)) for k in range(120)]
    sources = [f"s{k}" for k in range(11)]
    texts = [t if k % 11 < 9 else t.replace(common[0], "x") for k, t in enumerate(texts)]
    texts = [t if k % 11 < 7 else t.replace("near threshold", "y") for k, t in enumerate(texts)]
    docs = docs_of(spark, texts, sources)
    sites, first = collections.defaultdict(set), {}
    for k, t in enumerate(texts):
        for p, line in enumerate(t.split("\n")):
            if WORD.search(line):
                sites[line].add(sources[k % 11])
                first.setdefault(line, (k, p))
    wide = {x for x, s in sites.items() if len(s) >= 8}
    assert wide and any(len(s) == 7 for s in sites.values())
    want = {k: "\n".join(x for p, x in enumerate(t.split("\n")) if x not in wide or first[x] == (k, p)) for k, t in enumerate(texts)}
    got = {r.doc_id: r.text for r in linededup.remove_boilerplate(docs, 8, counts=True).collect()}
    assert got == want
    left = {r.doc_id: r.text for r in linededup.remove_boilerplate(docs, 8).collect()}
    assert left == {k: t for k, t in want.items() if WORD.search(t) or not WORD.search(texts[k])}


@pytest.mark.parametrize("sources, sites, least", [(3, 2, 3), (3, 3, 3), (7, 3, 3), (10, 3, 4), (10, 4, 4), (19, 8, 8), (30, 8, 8), (30, 7, 8)])
def test_lines_of_few_sites(spark, sources, sites, least):
    """A planted line on some of the sites goes where they are enough."""
    texts = [f"own line {k}\nthe planted line" if k < sites else f"own line {k}" for k in range(sources)]
    docs = docs_of(spark, texts, [None, *(f"s{k}" for k in range(1, sources))])
    assert linededup.threshold(docs) == least
    left = [r.text for r in linededup.remove_boilerplate(docs).collect()]
    assert sum("planted" in t for t in left) == (1 if sites >= least else sites) and len(left) == sources


# SimHash


def plain_print(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    votes = [sum(xxhash.xxh64_intdigest(s.encode(), 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(shingles))


def plain_components(prints, radius=2):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= radius:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [find(k) for k in range(len(prints))]


def test_simhash(spark):
    base = some_texts(8, 40)
    rng = random.Random(9)
    texts = base + [t + " x" for t in base[:10]] + base[:5] + [" ".join(rng.sample(t.split(), len(t.split()))) for t in base[:5]] + ["", "one", "One two", None]
    out = {r.doc_id: r for r in simhash.near_duplicates(docs_of(spark, texts)).collect()}
    prints = [plain_print(t or "") for t in texts]
    assert [out[k].fp & (2**64 - 1) for k in range(len(texts))] == prints
    assert [out[k].component_id for k in range(len(texts))] == plain_components(prints)
    kept = {r.doc_id for r in simhash.keep_one(docs_of(spark, texts)).collect()}
    assert kept == set(plain_components(prints))


@pytest.mark.parametrize("shard", [4096, 16, 3])
def test_links_and_components(spark, shard):
    rng = random.Random(10)
    values = set()
    for _ in range(25):
        centre = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 14)):
            values.add(centre)
            for _ in range(rng.randrange(4)):
                centre ^= 1 << rng.randrange(64)
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    prints = spark.createDataFrame([(v,) for v in signed], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(prints, shard=shard)).collect()}
    groups = collections.defaultdict(set)
    for v, s in zip(values, signed, strict=True):
        groups[roots.get(s, s)].add(v)
    want = collections.defaultdict(set)
    for v, c in zip(values, plain_components(values), strict=True):
        want[c].add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_long_chains_are_one_component(spark):
    edges = [(k, k + 1) for k in range(200)] + [(1000, 1001), (1001, 1002), (1002, 1000)]
    random.Random(11).shuffle(edges)
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(1, 201)}, 1001: 1000, 1002: 1000}


def test_bk_tree():
    rng = random.Random(12)
    values = list({rng.getrandbits(10) for _ in range(300)})
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for q in values[::7]:
        assert sorted(tree.search(q, 2)) == sorted(k for k, v in enumerate(values) if (v ^ q).bit_count() <= 2)


# Quality


def plain_longest(words):
    best = [0] * len(words)
    for i in range(len(words)):
        for j in range(len(words)):
            n = 0
            while i != j and max(i, j) + n < len(words) and words[i + n] == words[j + n]:
                n += 1
            best[i] = max(best[i], n)
    return best


def plain_quality(t):
    """The columns of one text, by quadratic search."""
    words = WORD.findall(t)
    best = plain_longest(words)
    windows = collections.Counter(zip(words, words[1:], words[2:], strict=False))
    repeated = {i + j for i in range(len(words) - 2) for j in range(3) if windows[tuple(words[i : i + 3])] > 1}
    under = {i + j for i, n in enumerate(best) if n >= quality.MIN_REPEAT for j in range(n)}
    seen, dup = set(), 0
    for x in t.split("\n"):
        dup += bool(WORD.search(x)) and x in seen
        seen.add(x)
    failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
    kept = not failed and len(under) <= quality.MOST_COVERED * len(words) and max(best, default=0) <= quality.MOST_LONGEST
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), dup, len(repeated), failed, len(under), max(best, default=0), kept)


def test_quality():
    rng = random.Random(13)
    texts = some_texts(14, 60, words=70, vocabulary=6) + some_texts(15, 30, words=90, vocabulary=400)
    line = " ".join(f"u{k}" for k in range(30))
    texts += ["", "# * a", "\n".join([line, "x y", line, "", line]), " ".join(["a"] * 60), " ".join(f"q{k}" for k in range(80)), "dup\nDup\ndup\n \n \n", " ".join(rng.choice("ab") for _ in range(150))]
    found = quality.measure([t.encode() for t in texts])
    for k, t in enumerate(texts):
        assert tuple(found[c][k] for c in quality.COLUMNS) == plain_quality(t)


def test_repeats_do_not_cross_texts():
    one = quality.measure([b"a b c d"] * 3)
    assert one["longest_repeat"].tolist() == [0, 0, 0]


# URL filters


def plain_scores(seeds, edges, rounds=urlfilter.ROUNDS, damping=urlfilter.DAMPING):
    out, into = collections.Counter(), collections.Counter()
    for (s, d), w in edges.items():
        out[s] += w
        into[d] += w
    now = dict(seeds)
    for _ in range(rounds):
        after = {h: list(x) for h, x in seeds.items()}
        for (s, d), w in edges.items():
            if s in now:
                after.setdefault(d, [0, 0])[0] += damping * w / out[s] * now[s][0]
            if d in now:
                after.setdefault(s, [0, 0])[1] += damping * w / into[d] * now[d][1]
        now = after
    return now


@pytest.mark.parametrize("most", [100_000, 0])
def test_link_graph(spark, monkeypatch, most):
    monkeypatch.setattr(urlfilter, "BROADCAST_ROWS", most)
    rng = random.Random(16)
    hosts = ["good.com", "www.Good.com", "bad.net", "near-bad.org", "a.org", "b.org", "c.org"]
    rows = []
    for k in range(90):
        h = rng.choice(hosts)
        links = [f'<a href="{rng.choice(["http://", "https://", "//"])}{rng.choice(hosts[:6] if h != "near-bad.org" else ["bad.net"])}/x?y">' for _ in range(rng.randrange(3))]
        rows.append((k, f"http://{h}/{rng.choice(['es', 'en'])}/{k}", "".join(links) + '<a href="/own">' + "<A HREF=https://plain.example>"))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = {r.page_id: r for r in urlfilter.judge(pages, entries.URL_RULES).collect()}
    rules = [(v, h, p) for v, h, p in entries.URL_RULES]

    def ruled(host, path):
        fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits)[1:] if fits else (None, None)

    judged, edges, by_host = {}, collections.Counter(), collections.defaultdict(list)
    for k, url, html in rows:
        host, _, path = url.split("://")[1].lower().partition("/")
        judged[k] = (host, *ruled(host, "/" + path))
        by_host[host].append(judged[k][2])
        for d in {m.lower() for m in re.findall(r"""(?i)href\s*=\s*["']?(?:https?:)?//([^/?#"'\s>]+)""", html)} - {host}:
            edges[host, d] += 1
    seeds = {h: [v.count("allow") / len(v), v.count("block") / len(v)] for h, v in by_host.items()}
    scores = plain_scores({h: s for h, s in seeds.items() if any(s)}, edges)
    bad = {h for h, (t, d) in scores.items() if d - t > urlfilter.THRESHOLD}
    for k, (host, rule, verdict) in judged.items():
        assert (out[k].host, out[k].rule, out[k].verdict) == (host, rule, verdict or ("block" if host in bad else "allow"))
    got = {r.host: (r.trust, r.distrust) for r in urlfilter.propagate(spark.createDataFrame([(h, *map(float, s)) for h, s in seeds.items()], "host string, trust double, distrust double"), urlfilter.staged(urlfilter.host_edges(pages), "t")).collect()}
    for h, (t, d) in scores.items():
        assert got[h] == (pytest.approx(t), pytest.approx(d))
