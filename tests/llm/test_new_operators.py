"""Tile pyramid, Merkle trees and importance resampling against plain versions, and their odd cases."""

import collections
import datetime
import hashlib
import math
import random
import re
import zlib
import zoneinfo

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import entries, importance, merkle, resampling

# Tile pyramid

CLICKS = "click_id long, ts timestamp_ntz, client_id long, value double"


def at(second):
    return datetime.datetime(1970, 1, 1) + datetime.timedelta(seconds=second)


def plain_buckets(rows, linear, zone, unit="day", gap=900):
    """Second by second: the area of each is the difference of the antiderivative at its ends."""
    best = {}
    for k, ts, c, v in rows:
        if c is None or ts is None or v is None or not math.isfinite(v):
            continue
        t = math.floor((ts - datetime.datetime(1970, 1, 1)).total_seconds())
        key, new = (c, t), (-1 if k is None else k, math.floor(100 * v + 0.5))
        best[key] = max(best.get(key, new), new)
    of = collections.defaultdict(list)
    for (c, t), (_, v) in sorted(best.items()):
        of[c].append((t, v))
    tz = zoneinfo.ZoneInfo(zone)

    def start(t):
        day = datetime.datetime.fromtimestamp(t, tz).date()
        day = day.replace(day=1) if unit == "month" else day - datetime.timedelta(days=day.weekday()) if unit == "week" else day
        while datetime.datetime.fromtimestamp(t, tz).date() >= day:
            t -= 1800
        t -= t % 1800
        while datetime.datetime.fromtimestamp(t, tz).date() < day:
            t += 1800
        return t

    starts = {}
    out = collections.defaultdict(lambda: [0, 0, 0])
    for c, points in of.items():
        for (t, v), after in zip(points, [*points[1:], None], strict=True):
            bucket = lambda s: starts[s // 1800] if s // 1800 in starts else starts.setdefault(s // 1800, start(s))
            out[c, bucket(t)][0] += 1
            near = after is not None and after[0] - t <= gap
            if linear and not near:
                continue
            e, w = (after[0], after[1] if linear else v) if near else (t + gap, v)
            twice = lambda u: 2 * v * u + (w - v) * u * u // (e - t)  # noqa: E731, B023
            for s in range(t, e):
                cell = out[c, bucket(s)]
                cell[1] += 1
                cell[2] += twice(s - t + 1) - twice(s - t)
    return {k: (n, s, a, a // (2 * s) if s else None) for k, (n, s, a) in out.items()}


def some_clicks(seed, n=300):
    rng = random.Random(seed)
    # Around both changes of the clocks in Berlin in 2024, and before 1970.
    starts = [1711843200 - 7200, 1729980000 - 7200, 1704067200, -86_400 * 30]
    rows = []
    for k in range(n):
        t = rng.choice(starts) + rng.choice([rng.randrange(20_000), rng.randrange(40) * 900, rng.randrange(8) * 1800])
        rows.append((rng.choice([k, k, None, k % 7]), rng.choice([at(t), at(t + rng.random()), None] if k % 19 == 0 else [at(t)]), rng.choice([1, 1, 1, 2, 3, None]), rng.choice([rng.uniform(-50, 50), 3.005, 1e9, -1e9, None, 0.0])))
    rows += rows[:20]
    return rows + [(1, at(0), 9, float("nan")), (1, at(0), 9, float("inf")), (2, at(10), 9, 1e300)]


@pytest.mark.parametrize("linear, zone, unit", [(True, "Europe/Berlin", "day"), (False, "Europe/Berlin", "day"), (True, "Asia/Kolkata", "week"), (False, "America/New_York", "month")])
def test_buckets(spark, linear, zone, unit):
    rows = some_clicks(len(zone))
    df = spark.createDataFrame(rows, CLICKS).withColumns({n: F.lit(n) for n in ("series", "t", "v", "cell", "bucket_start")})
    got = resampling.resampled(df, "client_id", "ts", "value", "click_id", linear, zone, unit).collect()
    want = plain_buckets([r for r in rows if r[3] != 1e300], linear, zone, unit)
    assert {(r.series, r.bucket_start): (r.n_points, r.covered_seconds, int(r.area2), r.avg_units) for r in got} == want
    assert resampling.resampled(df.limit(0), "client_id", "ts", "value", "click_id", linear, zone, unit).count() == 0


def test_large_values_and_zones(spark):
    rows = [(1, at(1000), 1, 4e15), (2, at(1700), 1, -3.9e15), (3, at(1801), 1, 4e15)]
    df = spark.createDataFrame(rows, CLICKS)
    got = resampling.resampled(df, "client_id", "ts", "value", "click_id", True, "Europe/Berlin").first()
    want = plain_buckets(rows, True, "Europe/Berlin")[1, -3600]
    assert (got.n_points, got.covered_seconds, int(got.area2), got.avg_units) == want
    # Kathmandu was at 5:30 until 1986, and has been at 5:45 since.
    assert resampling.resampled(df, "client_id", "ts", "value", "click_id", True, "Asia/Kathmandu").count() == 1
    later = spark.createDataFrame([(1, at(1_700_000_000), 1, 1.0)], CLICKS)
    with pytest.raises(ValueError, match="smaller cells"):
        resampling.resampled(later, "client_id", "ts", "value", "click_id", True, "Asia/Kathmandu")
    one = resampling.resampled(later, "client_id", "ts", "value", "click_id", False, "Asia/Kathmandu", cell=900).first()
    assert (one.n_points, one.covered_seconds, int(one.area2)) == (1, 900, 180_000)
    with pytest.raises(ValueError, match="unit"):
        resampling.calendar(spark, 0, 1, "UTC", "hour")


def test_session_zone_does_not_matter(spark):
    df = spark.createDataFrame(some_clicks(5), CLICKS).cache()
    run = lambda: sorted(map(tuple, resampling.resampled(df, "client_id", "ts", "value", "click_id", True, "Europe/Berlin").collect()))
    want = run()
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert run() == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


# Merkle trees


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def plain_tree(text):
    paragraphs = []
    for line in text.split("\n"):
        leaves = [sha(s) for s in re.findall(r"(?s).{0,30}?[.!?。！？] |.{1,32}", line)]
        paragraphs.append((sha("p" + "".join(leaves)), [x[:12] for x in leaves]))
    sections, held = [], []
    for k, p in enumerate(paragraphs):
        held.append(p)
        if p[0] < "4" or not p[1] or k == len(paragraphs) - 1:
            sections.append((sha("s" + "".join(h for h, _ in held)), held))
            held = []
    return sha("r" + "".join(h for h, _ in sections)), sections


def plain_written(tree):
    root, sections = tree
    return root + "|" + "/".join(h[:12] + "=" + ".".join("".join(leaves) for _, leaves in ps) for h, ps in sections)


def plain_likeness(a, b):
    leaves = [collections.Counter(x for _, ps in t[1] for _, ls in ps for x in ls) for t in (a, b)]
    if a[0] == b[0]:
        return 1.0
    return 2 * (leaves[0] & leaves[1]).total() / max(1, leaves[0].total() + leaves[1].total())


def plain_first(a, b):
    if a[0] == b[0]:
        return None
    differ = lambda x, y: next(k for k in range(max(len(x), len(y))) if k >= len(x) or k >= len(y) or x[k][0] != y[k][0])
    s = differ(a[1], b[1])
    inside = lambda t: t[1][s][1] if s < len(t[1]) else []
    return s, differ(inside(a), inside(b))


def some_documents(seed, n=40):
    rng = random.Random(seed)
    words = lambda: " ".join(rng.choice(["one", "two", "drei", "é", "你好。 ", "x.", "y!", "a?"]) for _ in range(rng.randrange(12)))
    texts = ["\n".join(words() for _ in range(rng.randrange(1, 9))) for _ in range(n)]
    return [None, "", "", "\n", "\n\n", " ", ". ", "a", "😀" * 9, "same. " * 50, *texts, texts[0], texts[0]]


def test_trees_of_neighbours(spark):
    texts = some_documents(3)
    rng = random.Random(1)
    rows = [(k * 3, t) for k, t in enumerate(texts)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({n: F.lit(n) for n in ("part", "h", "row", "tree", "edited", "next", "last")}).repartition(5)
    own = merkle.edited_copies(df)
    got = {r.doc_id: r for r in own.select("doc_id", "text", "next_text", "n_chars", "edited", merkle.written(F.col("tree")).alias("f"), merkle.written(F.col("edited_tree")).alias("ef"), merkle.likeness(F.col("tree"), F.col("edited_tree")).alias("near"), merkle.likeness(F.col("tree"), F.col("next_tree")).alias("near2"), merkle.first_change(F.col("tree"), F.col("edited_tree")).alias("first")).collect()}
    assert len(got) == len(texts)
    for k, text in enumerate(texts):
        text, after, r = text or "", texts[(k + 1) % len(texts)] or "", got[k * 3]
        m = len(text) // 4
        edited = text[: len(text) - m] + after[:m]
        a, b, c = plain_tree(text), plain_tree(edited), plain_tree(after)
        assert (r.text, r.next_text, r.n_chars, r.edited, r.f, r.ef) == (text, after, len(text), edited, plain_written(a), plain_written(b))
        assert r.near == pytest.approx(plain_likeness(a, b)) and r.near2 == pytest.approx(plain_likeness(a, c))
        assert (r.first and (r.first.section, r.first.paragraph)) == plain_first(a, b)
    assert got[0].f == got[3].f != got[9].f and merkle.edited_copies(df.limit(0)).count() == 0
    one = merkle.edited_copies(spark.createDataFrame([(None, "abcdefgh")], "doc_id long, text string")).first()
    assert (one.doc_id, one.edited, one.next_text) == (None, "abcdefab", "abcdefgh")


def test_repeated_and_null_ids(spark):
    rows = [(None, "b"), (None, "b"), (1, "x"), (1, "y"), (1, "x"), (2, None)]
    got = merkle.successors(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.text) for r in got) == sorted((i is not None, i or 0, t or "") for i, t in rows)
    assert sorted(r.next_text for r in got) == sorted(t or "" for _, t in rows)
    assert [r.next_text for r in got if r.doc_id == 2] == ["b"]


def test_edits_are_located(spark):
    lines = [f"Paragraph {k} stands here. It has two sentences." for k in range(200)]
    new = [*lines]
    new[70] = "Another paragraph."
    del new[120]
    frame = lambda x: spark.createDataFrame([(1, "\n".join(x)), (2, "same\ntext"), (3, None)], "doc_id long, text string").select("doc_id", merkle.tree(F.col("text")).alias("tree"))
    got = merkle.edits(frame(lines), frame(new), "doc_id").collect()
    hashes = lambda x: {h: t for t in x for h in [plain_tree(t)[1][0][1][0][0]]}
    assert {(r.doc_id, r.side, {**hashes(lines), **hashes(new)}[r.hash]) for r in got} == {(1, "old", lines[70]), (1, "old", lines[120]), (1, "new", new[70])}
    gone = merkle.edits(frame(lines), frame(lines).where("doc_id <> 2"), "doc_id").collect()
    assert {(r.doc_id, r.side, r.paragraph) for r in gone} == {(2, "old", k) for k in range(2)} or len(gone) == 2
    assert merkle.edits(frame(lines), frame(lines), "doc_id").count() == 0


def test_a_long_text(spark):
    text = "\n".join(f"Line {k} of a long text. It goes on, {k * k}!" for k in range(100_000))
    df = spark.createDataFrame([(1, text), (2, "short"), (3, "again. " * 500_000)], "doc_id long, text string")
    got = {r.doc_id: r for r in merkle.edited_copies(df).select("doc_id", "n_chars", merkle.written(F.col("tree")).alias("f"), merkle.likeness(F.col("tree"), F.col("edited_tree")).alias("near")).collect()}
    assert got[1].n_chars == len(text) and got[1].f == plain_written(plain_tree(text)) and 0.7 < got[1].near < 0.9
    assert got[3].near > 0.7


# Importance resampling

WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_features(text, run):
    words = WORDS.findall((text or "").encode().lower())
    return len(words), [zlib.crc32(b" ".join(words[i : i + n])) for i in range(len(words)) for n in range(1, run + 1) if i + n <= len(words)]


def plain_resampled(docs, target, run=1, buckets=10_000, percent=10, least=20, seed=2024):
    s, t = collections.Counter(), collections.Counter()
    for _, text in docs:
        s.update(x % buckets for x in plain_features(text, run)[1])
    for text in target:
        t.update(x % buckets for x in plain_features(text, run)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    rows = []
    for i, text in docs:
        n, found = plain_features(text, run)
        weight = sum(gain(x % buckets) for x in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    ranks = collections.defaultdict(list)
    for k, r in enumerate(able[: percent * len(able) // 100]):
        ranks[r].append(k + 1)
    return sorted(((*r, (ranks[r] or [None]).pop(0) if ranks[r] else None) for r in rows), key=repr)


@pytest.mark.parametrize("run, buckets", [(1, 10_000), (2, 97), (3, 10)])
def test_resampled(spark, run, buckets, monkeypatch):
    monkeypatch.setattr(importance, "BLOCK", 64)
    rng = random.Random(run)
    bag = [*"abcdefgh", "Éa", "ß1", "x-y", "你好", "A9", "ZZ"]
    docs = [(k, " ".join(rng.choice(bag) for _ in range(rng.randrange(60))) + rng.choice(["", "\n", " !"])) for k in range(200)]
    docs += [(200, None), (201, ""), (202, "..."), (None, docs[3][1]), (5, docs[5][1]), (5, docs[5][1])]
    target = ["a b a b Éa", None, "A9 zz " * 30]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({n: F.lit(n) for n in ("fit", "_row", "weight", "score", "rank", "n_words")}).repartition(5)
    want_of = lambda percent: plain_resampled(docs, target, run, buckets, percent)
    for percent in (10, 100):
        got = importance.resampled(df, spark.createDataFrame([(t,) for t in target], "text string"), run, buckets, percent).collect()
        assert sorted((tuple(r) for r in got), key=repr) == want_of(percent)
    none = spark.createDataFrame([], "doc_id long, text string")
    assert importance.resampled(none, none, run, buckets).count() == 0
    assert importance.resampled(df, none.select("text"), run, buckets).count() == len(docs)


def test_long_texts_are_counted_whole(spark):
    text = "word " * 1_000_000 + "End" + "x" * 3_000_000
    n, found = plain_features(text, 1)
    df = spark.createDataFrame([(1, text), (2, "b " * 30)], "doc_id long, text string")
    got = importance.counts(df)
    assert got.sum() == n + 30 and got[zlib.crc32(b"word") % 10_000] == 1_000_000 and got[found[-1] % 10_000] == 1
    rows = {r.doc_id: r for r in importance.resampled(df, df).collect()}
    assert rows[1].n_features == n and rows[1].weight == 0


def test_queries_are_registered():
    assert {"op11_tiles", "op12_merkle", "op13_importance"} <= set(entries.QUERIES) and {"op11_tiles", "op12_merkle", "op13_importance"} <= set(entries.ORACLES)
