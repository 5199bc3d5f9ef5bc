"""Chunkers as Column expressions: a text column in, an array of struct<pos, content> out.

Lengths and positions are in code points throughout. A null or empty text has no chunks.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# What ends a sentence, what ended one in an older variant, and what ends a title or opens a chunk.
SENTENCE_END = "。！？,.?!"
SENTENCE_END_NARROW = "。！？"
TITLE_END = "。？ ！.?!\n"
CHUNK_START = ".?! 。？！\n"

_EMPTY = "cast(array() as array<struct<pos:int,content:string>>)"


def _class(chars: str) -> str:
    return "".join(re.escape(c) if c.isascii() and not c.isalnum() and c not in " \n" else c for c in chars)


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once per row: what a lambda takes from outside is evaluated at each of its calls."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def checked_window(size: int, overlap: int) -> None:
    if size < 1 or not 0 <= overlap < size:
        raise ValueError(f"a window of {size} can't overlap by {overlap}")


def _count(text: Column, size: Column, step: Column) -> Column:
    n = F.length(text)
    full = F.when(n < size, F.lit(0)).otherwise(F.floor((n - size) / step) + 1).cast("int")
    return full + F.when(full * step < n, 1).otherwise(0)


#: Windows up to this length are found by one pattern; longer ones are put together from blocks of this length.
BLOCK = 1024


def _starts(text: Column, size: Column, step: Column) -> Column:
    """The `size` code points from each multiple of `step` on: a match takes a step and looks ahead for the rest, so that no window is
    sought from the text's start."""
    pattern = F.concat(F.lit("(?s)(?=(.{1,"), size.cast("string"), F.lit("})).{1,"), step.cast("string"), F.lit("}"))
    return F.regexp_extract_all(text, pattern, 1)


def _long_starts(text: Column, size: Column, step: Column, total: Column) -> Column:
    """The first `total` of the same for long windows: each joins the blocks that it touches, and is cut out of them."""

    def one(blocks: Column, i: Column) -> Column:
        at = i * step.cast("long")
        first = F.floor(at / BLOCK)
        n = F.floor((at + size - 1) / BLOCK) - first + 1
        return F.substring(F.array_join(F.slice(blocks, (first + 1).cast("int"), n.cast("int")), ""), (at % BLOCK + 1).cast("int"), size)

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    return let(blocks, lambda b: F.transform(F.sequence(F.lit(0), total - 1), lambda i: one(b, i)))


def _cut(text: Column, size: Column, step: Column, most: int, lead: Column | None = None) -> Column:
    """Full windows every step, then what is left from the next start on. size is `most` or less. Linear in the text's length."""
    total = _count(text, size, step)
    prefix = (lambda c: c) if lead is None else (lambda c: F.concat(lead, c))
    found = F.slice(_starts(text, size, step), F.lit(1), total) if most <= BLOCK else _long_starts(text, size, step, total)
    pieces = F.transform(found, lambda c, i: F.struct(i.cast("int").alias("pos"), prefix(c).alias("content")))
    return F.when(total > 0, pieces).otherwise(F.expr(_EMPTY))


def windows(text: Column, size: int, overlap: int = 0) -> Column:
    """Windows of `size` that share `overlap` code points; the last may be shorter."""
    checked_window(size, overlap)
    return _cut(text, F.lit(size), F.lit(size - overlap), size)


def window_count(text: Column, size: int, overlap: int = 0) -> Column:
    """How many windows() there are."""
    checked_window(size, overlap)
    return F.coalesce(_count(text, F.lit(size), F.lit(size - overlap)), F.lit(0))


def pieces(text: Column, size: int = 50) -> Column:
    """Pieces of a fixed length."""
    return windows(text, size)


def title(text: Column, size: int) -> Column:
    """What stands before the first title end, and a space; empty if there is none or it exceeds a fifth of the window."""
    found = F.concat(F.regexp_extract(text, f"^([^{_class(TITLE_END)}]*)[{_class(TITLE_END)}]", 1), F.lit(" "))
    return F.when(text.rlike(f"[{_class(TITLE_END)}]") & (F.length(found) <= size / 5), found).otherwise(F.lit(""))


def titled_windows(text: Column, size: int, overlap: int = 0, keep_title: bool = True) -> Column:
    """The first window as it is, then the rest in windows that each begin with the title."""
    checked_window(size, overlap)
    if keep_title and overlap >= size - size // 5:
        raise ValueError("the overlap leaves no room for a title")
    lead = title(text, size) if keep_title else F.lit("")
    given = F.struct(F.substring(text, F.lit(size - overlap + 1), F.length(text)).alias("rest"), lead.alias("lead"))
    inner = lambda x: F.lit(size) - F.length(x["lead"])
    rest = let(given, lambda x: _cut(x["rest"], inner(x), inner(x) - overlap, size, x["lead"]))
    first = F.struct(F.lit(0).alias("pos"), F.substring(text, 1, size).alias("content"))
    shifted = F.transform(rest, lambda c: F.struct((c["pos"] + 1).alias("pos"), c["content"].alias("content")))
    return F.when(F.length(text) > 0, F.concat(F.array(first), shifted)).otherwise(F.expr(_EMPTY))


def sentences(text: Column, ends: str = SENTENCE_END) -> Column:
    """Runs of other characters with the end that follows. An unterminated tail and repeated ends match nothing.

    The pattern also accepts the end of the text, else the engine would try an unterminated tail from each of its characters;
    such a match is dropped.
    """
    e = _class(ends)
    return F.filter(F.regexp_extract_all(text, F.lit(f"([^{e}]+(?:[{e}]|\\z))"), 1), lambda s: s.rlike(f"[{e}]\\z"))


def packed(parts: Column, size: int, whole: Column | None = None, links: Column | None = None, least: Column | None = None, drop_empty: bool = True) -> Column:
    """Parts put together in order while they fit into `size`; a part that is too long stands alone.

    whole takes the parts' place where there are none. With links (a number between neighbours) parts also part where the link
    isn't above least. Only lengths are folded; the texts are joined once, from the places of the cuts.
    """
    if whole is not None:
        parts = let(parts, lambda p: F.when(F.size(p) > 0, p).otherwise(F.array(whole)))
    none = F.lit(None).cast("array<double>")
    given = F.struct(parts.alias("parts"), (none if links is None else links).alias("links"), (F.lit(None).cast("double") if least is None else least).alias("least"))
    return let(given, lambda g: let(_cuts(g, size, links is not None), lambda cuts: _joined(g["parts"], cuts, size, drop_empty or links is not None)))


def _cuts(given: Column, size: int, linked: bool) -> Column:
    """The parts that chunks begin with, from lengths alone."""
    start = F.struct(F.expr("cast(array() as array<int>)").alias("cuts"), F.lit(0).alias("used"), F.lit(0).alias("at"))

    def step(acc: Column, length: Column) -> Column:
        fits = acc["used"] + length <= size
        if linked:
            fits = fits & F.coalesce(F.get(given["links"], acc["at"] - 1) > given["least"], F.lit(False))
        fits = fits & (acc["at"] > 0)
        cuts = F.when(fits, acc["cuts"]).otherwise(F.concat(acc["cuts"], F.array(acc["at"])))
        used = F.when(fits, acc["used"] + length).otherwise(length)
        return F.struct(cuts.alias("cuts"), used.alias("used"), (acc["at"] + 1).alias("at"))

    return F.aggregate(F.transform(given["parts"], F.length), start, step, lambda acc: acc["cuts"])


def _joined(parts: Column, cuts: Column, size: int, drop_empty: bool) -> Column:
    content = F.transform(cuts, lambda c, k: F.struct(k.cast("int").alias("pos"), F.array_join(F.slice(parts, c + 1, F.coalesce(F.get(cuts, k + 1), F.size(parts)) - c), "").alias("content")))
    kept = F.filter(content, lambda c: c["content"] != "")
    if drop_empty:
        return kept
    leading = F.length(F.get(parts, F.lit(0))) > size
    empty = F.array(F.struct(F.lit(0).alias("pos"), F.lit("").alias("content")))
    return F.when(leading, F.concat(empty, F.transform(kept, lambda c: F.struct((c["pos"] + 1).alias("pos"), c["content"].alias("content"))))).otherwise(kept)


def greedy(text: Column, size: int, ends: str = SENTENCE_END, drop_empty: bool = True) -> Column:
    """Sentences packed into chunks of at most `size`; a text without a sentence is one."""
    return packed(sentences(text, ends), size, whole=text, drop_empty=drop_empty)


def gated(text: Column, chunks: Column, size: int) -> Column:
    """Texts shorter than `size` as they are, others by chunks."""
    return F.when(F.length(text) < size, F.array(F.struct(F.lit(0).alias("pos"), text.alias("content")))).otherwise(chunks)


def cut_at_marks(text: str, size: int, lead: str = "") -> list[str]:
    """Chunks that open with a punctuation mark or a space: each window ends before its last one, or at its size without any.

    Each cut depends on the one before; operators.chunking applies this to Arrow batches.
    """
    out, start, room = [], 0, size
    while start + room < len(text):
        cut = next((k for k in range(start + room, start, -1) if text[k] in CHUNK_START), start + room)
        out.append(lead + text[start:cut])
        start, room = cut, size - len(lead)
    return [*out, lead + text[start:]] if start < len(text) else out


def title_of(text: str, size: int) -> str:
    """title() for one string."""
    found = re.search(f"[{_class(TITLE_END)}]", text)
    return text[: found.start()] + " " if found and found.start() + 1 <= size / 5 else ""


# The same for one string each; operators.tablefunctions applies them row by row.


def windows_of(text: str, size: int, overlap: int = 0) -> list[str]:
    """windows() of one string."""
    step = size - overlap
    whole = 0 if len(text) < size else (len(text) - size) // step + 1
    return [text[i * step : i * step + size] for i in range(whole + (whole * step < len(text)))]


def sentences_of(text: str, ends: str = SENTENCE_END) -> list[str]:
    """sentences() of one string."""
    return [s for s in re.findall(f"[^{_class(ends)}]+(?:[{_class(ends)}]|\\Z)", text) if s[-1] in ends]


def greedy_of(text: str, size: int, ends: str = SENTENCE_END) -> list[str]:
    """greedy() of one string."""
    out: list[list[str]] = []
    used = 0
    for s in sentences_of(text, ends) or [text]:
        if out and used + len(s) <= size:
            out[-1].append(s)
            used += len(s)
        else:
            out.append([s])
            used = len(s)
    return [c for c in map("".join, out) if c]
