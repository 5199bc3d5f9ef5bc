"""Merkle trees of documents: pieces hash to paragraphs, paragraphs to sections, sections to a root.

A paragraph is a line; a section ends with an empty paragraph, with one whose hash begins with 0 to 3, and with the text, so that a change
moves no boundary but those near it; a piece is 32 code points, or fewer up to the end of a sentence, a mark and a space. Every character
of a text belongs to one piece or is the line feed between two paragraphs: equal roots mean equal texts. Each kind of node is hashed with
a letter of its own before the hashes of its children. Pieces, on which only comparisons of two documents depend, keep 12 of the digits.

Everything is a native expression over one row, linear in the text's length. Cases: a null text is an empty one, a single paragraph
without a piece; repeated rows have equal trees; empty tables give empty ones; other columns stay out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusloom.functions.text import let

from .common import parts_for

#: Documents of one range when they are put in order.
RANGE_DOCS = 20_000
#: Digits that a comparison of two documents keeps of a hash.
SHORT = 12
#: A piece, from its first character on.
_PIECE = r"(?s).{0,30}?[.!?。！？] |.{1,32}"
TREE = "struct<root:string,sections:array<struct<hash:string,paragraphs:array<struct<hash:string,pieces:array<string>>>>>>"


def _node(letter: str, children: Column) -> Column:
    return F.sha2(F.concat(F.lit(letter), F.array_join(children, "")), 256)


def _paragraph(line: Column) -> Column:
    hashes = F.transform(F.regexp_extract_all(line, F.lit(_PIECE), F.lit(0)), lambda s: F.sha2(s, 256))
    return let(hashes, lambda h: F.struct(_node("p", h).alias("hash"), F.transform(h, lambda x: F.substring(x, 1, SHORT)).alias("pieces")))


def tree(text: Column) -> Column:
    """The tree of a text, a TREE."""

    def sections(p: Column) -> Column:
        ends = F.filter(F.sequence(F.lit(0), F.size(p) - 1), lambda i: (i == F.size(p) - 1) | (F.get(p, i)["hash"] < "4") | (F.size(F.get(p, i)["pieces"]) == 0))
        return let(ends, lambda e: F.transform(e, lambda end, k: let(F.slice(p, F.coalesce(F.get(e, k - 1), F.lit(-1)) + 2, end - F.coalesce(F.get(e, k - 1), F.lit(-1))), section)))

    section = lambda own: F.struct(_node("s", F.transform(own, lambda x: x["hash"])).alias("hash"), own.alias("paragraphs"))
    made = let(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), _paragraph), sections)
    return let(made, lambda s: F.struct(_node("r", F.transform(s, lambda x: x["hash"])).alias("root"), s.alias("sections")))


def written(tree: Column) -> Column:
    """A tree as text: root|section=pieces.pieces/section=... with a full root and short hashes."""
    paragraph = lambda p: F.array_join(p["pieces"], "")
    section = lambda s: F.concat(F.substring(s["hash"], 1, SHORT), F.lit("="), F.array_join(F.transform(s["paragraphs"], paragraph), "."))
    return F.concat(tree["root"], F.lit("|"), F.array_join(F.transform(tree["sections"], section), "/"))


def _leaves(tree: Column) -> Column:
    """The pieces' hashes, each with how many equal ones came before it: a set that stands for a multiset."""
    flat = F.flatten(F.transform(tree["sections"], lambda s: F.flatten(F.transform(s["paragraphs"], lambda p: p["pieces"]))))

    def numbered(x: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(x) - 1), lambda i: (i == 0) | (F.get(x, i) != F.get(x, i - 1)))
        runs = lambda s: F.transform(s, lambda at, k: F.transform(F.slice(x, at + 1, F.coalesce(F.get(s, k + 1), F.size(x)) - at), lambda h, n: F.concat(h, n.cast("string"))))
        return F.when(F.size(x) > 0, F.flatten(let(starts, runs))).otherwise(F.expr("cast(array() as array<string>)"))

    return let(F.sort_array(flat), numbered)


def likeness(a: Column, b: Column) -> Column:
    """1 for equal roots; else twice the pieces that both trees have over all they have, 0 where neither has one."""
    both = F.struct(_leaves(a).alias("a"), _leaves(b).alias("b"))
    share = let(both, lambda x: F.coalesce(F.try_divide(2.0 * F.size(F.array_intersect(x["a"], x["b"])), (F.size(x["a"]) + F.size(x["b"])).cast("double")), F.lit(0.0)))
    return F.when(a["root"] == b["root"], F.lit(1.0)).otherwise(share)


def first_change(a: Column, b: Column) -> Column:
    """struct<section, paragraph> where two trees first differ, from 0; null for equal roots."""
    differ = lambda x, y: F.array_position(F.zip_with(F.transform(x, lambda n: n["hash"]), F.transform(y, lambda n: n["hash"]), lambda m, n: m.eqNullSafe(n)), False) - 1
    none = F.expr("cast(array() as array<struct<hash:string,pieces:array<string>>>)")
    inside = lambda t, k: F.coalesce(F.get(t["sections"], k.cast("int"))["paragraphs"], none)
    found = let(differ(a["sections"], b["sections"]), lambda k: F.struct(k.alias("section"), differ(inside(a, k), inside(b, k)).alias("paragraph")))
    return F.when(a["root"] != b["root"], found)


def edits(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, side, section, paragraph, hash): paragraphs of old that new doesn't have (side `old`), and the other way round.

    Trees are descended as tables: documents with equal roots go first, then sections that the other side has, then paragraphs. Keys are
    distinct; a key that only one side has differs in all of its paragraphs.
    """
    both = old.select(key, F.col("tree").alias("a")).join(new.select(key, F.col("tree").alias("b")), key, "full_outer").where(~F.col("a.root").eqNullSafe(F.col("b.root")))

    def one(own: str, other: str, side: str) -> DataFrame:
        hashes = lambda t: F.coalesce(F.transform(F.col(f"{t}.sections"), lambda s: s["hash"]), F.expr("cast(array() as array<string>)"))
        gone = both.where(F.col(own).isNotNull()).select(key, F.array_except(hashes(own), hashes(other)).alias("gone"), F.col(own).alias("own"), F.col(other).alias("other"))
        branch = gone.select(key, "gone", F.posexplode("own.sections").alias("section", "s"), "other").where(F.array_contains("gone", F.col("s.hash")))
        mine = branch.select(key, "section", F.posexplode("s.paragraphs").alias("paragraph", "p")).select(key, "section", "paragraph", F.col("p.hash").alias("hash"))
        theirs = gone.select(F.col(key).alias("_key"), F.explode("other.sections").alias("s")).select("_key", F.explode("s.paragraphs.hash").alias("_hash"))
        return mine.join(theirs, (F.col(key) == F.col("_key")) & (F.col("hash") == F.col("_hash")), "left_anti").withColumn("side", F.lit(side))

    return one("a", "b", "old").unionByName(one("b", "a", "new")).select(key, "side", "section", "paragraph", "hash")


def successors(docs: DataFrame) -> DataFrame:
    """(doc_id, text, tree, next_text, next_tree): each document of docs (doc_id, text) and the next by ascending doc_id; the first follows
    the last. Null ids come first; rows that tie in id go by a hash of the text.

    Texts are shuffled to ranges, and each range to a task; neighbours meet there, and the last of each range meets the first of the next
    one, a row each.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row")).withColumn("h", F.xxhash64("text"))
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), parts_for(docs.count(), RANGE_DOCS))
    order = ["doc_id", "h", "row"]
    # The window's own exchange would also carry the trees.
    ranged = rows.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()).repartition(n, "part")
    after = W.partitionBy("part").orderBy(*order)
    inner = ranged.withColumn("tree", tree(F.col("text"))).withColumns({"next_text": F.lead("text").over(after), "next_tree": F.lead("tree").over(after)})
    # The rows at the ranges' ends.
    ends = ranged.groupBy("part").agg(F.min_by(F.struct("doc_id", "text"), F.struct(*order)).alias("first"), F.max_by(F.struct("doc_id", "text"), F.struct(*order)).alias("last"))
    edge = ends.select("part", "last", "first")
    chain = edge.select("part").withColumn("next", F.coalesce(F.lead("part").over(W.partitionBy(F.lit(0)).orderBy("part")), F.min("part").over(W.partitionBy(F.lit(0)))))
    across = edge.select("part", F.col("last.doc_id").alias("doc_id"), F.col("last.text").alias("text")).join(chain, "part")
    met = across.join(edge.select(F.col("part").alias("next"), F.col("first.text").alias("next_text")), "next")
    outer = met.select("doc_id", "text", tree(F.col("text")).alias("tree"), "next_text", tree(F.col("next_text")).alias("next_tree"))
    return inner.where("next_text is not null").select(outer.columns).unionByName(outer)


def edited_copies(docs: DataFrame) -> DataFrame:
    """successors() with n_chars, edited (the text, whose last floor(n_chars / 4) code points are replaced by the next document's first as
    many, or all of it) and edited_tree."""
    n, m = F.length("text"), F.floor(F.length("text") / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - m), F.substring("next_text", F.lit(1), m))
    return successors(docs).withColumns({"n_chars": n.cast("long"), "edited": edited}).withColumn("edited_tree", tree(F.col("edited")))
