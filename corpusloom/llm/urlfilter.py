"""URL filters: host and path rules, and for what no rule decides, trust and distrust over the graph of links between hosts.

DataFrame functions only. Rules meet the distinct hosts through their suffixes, so a list of rules of any size is a join.
A host's trust seed is the share of its pages that a rule allows, its distrust seed the share that a rule blocks. Trust
follows links (personalised PageRank: score = seed + DAMPING * what comes in, each host dividing its score among its links
by weight); distrust follows them backwards. A page without a rule is blocked where its host's distrust exceeds its
trust by more than THRESHOLD.

Defined results: a null url, or one without ://, has empty host and path, fits no rule and is allowed, as is any host
without scores; links of a host to itself don't count; repeated pages count each time; an empty table gives an empty one.
Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, staged

DAMPING, ROUNDS, THRESHOLD = 0.85, 30, 0.5
#: Rounds whose scores have moved less than this in sum are the last.
SETTLED = 1e-9

#: Hosts that are broadcast to the pages at most; more meet them by a shuffle, each in SALTS places.
BROADCAST_ROWS, SALTS = 100_000, 16

#: Absolute links' hosts.
LINK = r"""(?i)href\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)"""


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(lower_ascii(F.regexp_extract(rest, "^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)", 1), F.lit(""))


def host_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, rules): for each host that any rule's host fits, those rules' (size, rule, verdict, path)."""
    labels = F.split("host", r"\.")
    suffixes = hosts.select("host", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))).alias("suffix"))
    each = rules.select(F.col("host").alias("suffix"), F.struct((F.length("host") + F.length("path")).alias("size"), F.concat("host", "path").alias("rule"), "verdict", "path").alias("r"))
    return suffixes.distinct().join(each, "suffix").groupBy("host").agg(F.collect_list("r").alias("rules"))


def meet(rows: DataFrame, hosts: DataFrame) -> DataFrame:
    """rows (page_id, host) with hosts, a staged row per host, from the left; a host with a third of all pages isn't one task."""
    if hosts.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(hosts), "host", "left")
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("page_id", F.monotonically_increasing_id()), F.lit(SALTS)).cast("int"))
    return salted.join(hosts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["host", "_salt"], "left").drop("_salt")


def ruled(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(page_id, host, path, rule, verdict): rule and verdict of the longest rule that fits, else null."""
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    found = meet(rows, staged(host_rules(rows.select("host").distinct(), rules), "host-rules"))
    best = F.array_max(F.filter("rules", lambda r: F.startswith(F.col("path"), r["path"])))
    return found.select("page_id", "host", "path", best["rule"].alias("rule"), best["verdict"].alias("verdict"))


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, weight): pages of src that link to dst."""
    out = F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(LINK), 1), lower_ascii))
    links = pages.select(host_of(F.col("url")).alias("src"), F.explode(out).alias("dst"))
    return links.where("src <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("weight"))


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """seeds: (host, trust, distrust). edges: host_edges(), staged. The scores of all hosts that have any: same columns.

    After n rounds a score lacks at most damping ** n of what it would be in the end.
    """
    now = staged(seeds.where("trust > 0 or distrust > 0").select("host", "trust", "distrust"), "seeds")
    if edges.isEmpty() or now.isEmpty():
        return now
    start = now
    out, into = edges.groupBy("src").agg(F.sum("weight").alias("n")), edges.groupBy("dst").agg(F.sum("weight").alias("n"))
    zero = F.lit(0.0)
    ahead = edges.join(out, "src").select(F.col("src").alias("host"), F.col("dst").alias("to"), (damping * F.col("weight") / F.col("n")).alias("t"), zero.alias("d"))
    back = edges.join(into, "dst").select(F.col("dst").alias("host"), F.col("src").alias("to"), zero.alias("t"), (damping * F.col("weight") / F.col("n")).alias("d"))
    steps = staged(ahead.unionByName(back), "steps")
    for _ in range(rounds):
        moved = steps.join(now, "host").select(F.col("to").alias("host"), (F.col("trust") * F.col("t")).alias("trust"), (F.col("distrust") * F.col("d")).alias("distrust"))
        after = staged(start.unionByName(moved).groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust")), "scores")
        change = after.join(now.select("host", F.col("trust").alias("t"), F.col("distrust").alias("d")), "host", "left").agg(F.sum(F.abs(F.col("trust") - F.coalesce("t", zero)) + F.abs(F.col("distrust") - F.coalesce("d", zero)))).first()[0]
        now = after
        if change < SETTLED:
            break
    return now


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], threshold: float = THRESHOLD) -> DataFrame:
    """rules: (verdict, host, path). page_id, host, path, rule and verdict (allow or block) for each page."""
    spark = pages.sparkSession
    given = spark.createDataFrame(rules, "verdict string, host string, path string")
    rows = staged(ruled(pages, given), "urls")
    share = lambda v: F.avg(F.when(F.col("verdict") == v, 1.0).otherwise(0.0))
    seeds = rows.where("host <> ''").groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust"))
    scores = propagate(seeds, staged(host_edges(pages), "edges"))
    bad = scores.where(F.col("distrust") - F.col("trust") > threshold).select("host", F.lit("block").alias("_by_host"))
    return meet(rows, staged(bad, "bad-hosts")).select("page_id", "host", "path", "rule", F.coalesce("verdict", "_by_host", F.lit("allow")).alias("verdict"))
