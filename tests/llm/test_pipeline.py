"""The pipeline against a plain version of its five stages."""

import base64
import collections
import hashlib
import math
import random

import tiktoken

import corpus_pipeline
from corpusloom.llm import entries

from .test_brute_force import WORD, plain_quality, plain_targets
from .test_nearcopies import plain_kept

SITES = 12


def corpus():
    rng = random.Random(20)
    word = lambda: "".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randrange(2, 8)))
    fresh = lambda: "\n".join(" ".join(word() for _ in range(20)) + "." for _ in range(rng.randrange(3, 7)))
    texts = [fresh() for _ in range(60)]
    texts += [texts[k] for k in (0, 1, 1, 2)] + [texts[3] + " one"]
    # Near copies of five-word similarity 0.8 whose fingerprints are far apart.
    texts += [x.replace(x.split()[9], "other", 1) for x in texts[10:30]]
    texts += ["All rights reserved by the site.\n" + fresh() for _ in range(30)]
    texts += ["too short", "", None, "spam spam " * 60, texts[5]]
    return [(k, t, "en", f"s{k % SITES}", len(t or "")) for k, t in enumerate(texts)]


def plain(rows):
    kept = [r for r in rows if plain_quality(r[1] or "")[-1]]
    enough = max(3, min(8, math.ceil(0.4 * len({r[3] for r in kept}))))
    sites, first = collections.defaultdict(set), {}
    for k, text, _, source, _ in kept:
        for p, line in enumerate(text.split("\n")):
            if WORD.search(line):
                sites[line].add(source)
                first.setdefault(line, (k, p))
    lines = {}
    for k, text, _, source, _ in kept:
        left = "\n".join(x for p, x in enumerate(text.split("\n")) if len(sites[x]) < enough or first[x] == (k, p))
        if WORD.search(left):
            lines[k] = (left, source)
    alone = {k: lines[k] for k in plain_kept([(k, *lines[k]) for k in lines])}
    sizes = collections.Counter()
    for text, source in alone.values():
        sizes[source] += len(WORD.findall(text))
    target, entries_ = plain_targets(sizes), []
    turn = lambda k: int(hashlib.md5(str(k).encode()).hexdigest()[:15], 16)
    for source in sizes:
        served = 0
        for turn_ in range(2):
            for k in sorted((k for k, x in alone.items() if x[1] == source), key=turn):
                n = len(WORD.findall(alone[k][0]))
                served += n
                entries_.append((served / target[source], f"s{source}", turn_, turn(k), k, n))
    taken, total = [], 0
    for *_, k, n in sorted(entries_):
        total += n
        if total <= 1.5 * sum(sizes.values()):
            taken.append(k)
    return collections.Counter((k, alone[k][0], alone[k][1]) for k in taken)


def test_pipeline(spark, tmp_path):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    raw, pattern = entries.byte_bpe()
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}, special_tokens={})
    want = plain(rows)
    assert sum("All rights" in t for _, t, _ in want) <= 1 < sum("All rights" in (r[1] or "") for r in rows)
    assert collections.Counter((r.doc_id, library.decode(r.ids), r.source) for r in got) == want
    for r in got:
        assert r.n_tokens == len(r.ids) and r.decoded_sha256 == hashlib.sha256(library.decode_bytes(r.ids)).hexdigest()
        assert r.ids == library.encode_ordinary(library.decode(r.ids))
