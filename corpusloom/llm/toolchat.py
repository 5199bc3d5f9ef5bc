"""Tool calls in chats: calls and results linked by identifier, put in topological order, validated and serialised.

DataFrame functions only. Identifiers count within their conversation. Results meet their calls by a shuffled hash join on the
identifier, of which each has one row on the built side; events without one take no part in it. An event may wait for one other event; its depth, the length of that chain,
comes from doubling pointers, so rounds grow with the logarithm of the longest chain. Arguments are parsed as variants, whose
objects hold their keys in order, and written without spaces: canonical JSON. Numbers are written by value: all digits of those
that a decimal of 38 digits holds, without zeros at the end, and the shortest form of a double for others. No step gathers a
conversation in one task: positions are running sums over ranges.

Defined results: of several calls of a conversation with an identifier that with the smallest turn is the call and the rest
are duplicates, as are later results of a call; rows that are equal in all columns are one event, seen twice, and share its status; a
result without a call is an orphan, a call without a result unanswered;
events that wait for each other in a circle have no depth and come last, marked cycle; arguments that aren't a JSON object, or
hold a number beyond a double's range, are invalid and written as null; a null conversation is one of its own; null roles and
texts are empty strings, null turns come first; an empty table gives an empty one. Further columns are ignored.
"""

from __future__ import annotations

import json
from math import ceil, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import running, staged

EVENT = ["conv_id", "turn", "kind", "event_id", "call_id", "after_id", "name", "arguments", "content"]


def conversation_events(messages: DataFrame) -> DataFrame:
    """messages (conv_id, turn, role, text) as events: a user's turn calls the tool `reply` with the text as its prompt, the
    assistant's next turn is that call's result, and anything else a message. Each turn waits for the one before it.

    A turn that is JSON with `tool_calls` (a list of id, name and arguments) or with `tool_call_id` and `content` becomes
    those calls or that result instead.
    """
    here = F.concat_ws("/", F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.coalesce(F.col("turn").cast("string"), F.lit("")))
    last = F.concat_ws("/", F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.coalesce((F.col("turn") - 1).cast("string"), F.lit("-")))
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    coded = F.when(F.startswith(text, F.lit("{")), F.from_json(text, "tool_calls array<struct<id string, name string, arguments string>>, tool_call_id string, content string"))
    rows = messages.select("conv_id", "turn", role.alias("role"), text.alias("text"), here.alias("here"), last.alias("last"), coded.alias("coded"))
    none = F.lit(None).cast("string")
    # Turns and calls are events of two kinds of names; a turn of calls also has its own, which the next turn waits for.
    turn, before = F.concat(F.lit("t"), F.col("here")), F.concat(F.lit("t"), F.col("last"))

    def event(kind: str, event_id: Column, call_id: Column, after: Column, name: Column, arguments: Column, content: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), event_id.alias("event_id"), call_id.alias("call_id"), after.alias("after_id"), name.alias("name"), arguments.alias("arguments"), content.alias("content"))

    plain = (
        F.when(F.col("role") == "user", event("call", turn, F.col("here"), before, F.lit("reply"), F.to_json(F.struct(F.col("turn"), F.col("text").alias("prompt")), {"ignoreNullFields": "false"}), none))
        .when(F.col("role") == "assistant", event("result", turn, F.col("last"), before, none, none, F.col("text")))
        .otherwise(event("message", turn, none, before, none, none, F.col("text")))
    )
    calls = F.transform("coded.tool_calls", lambda c: event("call", F.concat(F.lit("c"), c["id"]), c["id"], before, c["name"], c["arguments"], none))
    calls = F.concat(calls, F.array(event("turn", turn, none, before, none, none, none)))
    result = F.array(event("result", turn, F.col("coded.tool_call_id"), F.concat(F.lit("c"), F.col("coded.tool_call_id")), none, none, F.col("coded.content")))
    made = F.when(F.size("coded.tool_calls") > 0, calls).when(F.col("coded.tool_call_id").isNotNull(), result).otherwise(F.array(plain))
    return rows.select("conv_id", "turn", F.explode(made).alias("e")).select("conv_id", "turn", "e.*")


def _conv() -> Column:
    return F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("n"))


def link(events: DataFrame) -> DataFrame:
    """Adds status: linked, unanswered, orphan, duplicate or message."""
    rows = events.withColumn("_conv", _conv())
    named = rows.where("call_id is not null and kind in ('call', 'result')")
    order = F.struct("turn", "event_id", F.xxhash64("name", "arguments", "content").alias("h"))
    known = named.groupBy("_conv", "call_id").agg(*(F.min(F.when(F.col("kind") == kind, order)).alias(f"_{kind}") for kind in ("call", "result")))
    first = F.when(F.col("kind") == "call", F.col("_call")).otherwise(F.col("_result"))
    status = (
        F.when((F.col("kind") == "result") & F.col("_call").isNull(), "orphan")
        .when(~order.eqNullSafe(first), "duplicate")
        .when(F.col("_result").isNull(), "unanswered")
        .otherwise("linked")
    )
    met = named.join(known.hint("shuffle_hash"), ["_conv", "call_id"]).withColumn("status", status).select(*EVENT, "status")
    alone = F.when(F.col("kind") == "call", "unanswered").when(F.col("kind") == "result", "orphan").otherwise("message")
    return met.unionByName(rows.where("call_id is null or kind not in ('call', 'result')").withColumn("status", alone).select(*EVENT, "status"))


def depths(edges: DataFrame) -> DataFrame:
    """edges: (id, after), a row per id. (id, depth): events before it in its chain; null on or behind a circle."""
    ids = edges.select(F.col("id").alias("known"))
    now = edges.join(ids, F.col("after") == F.col("known"), "left").select("id", F.col("known").alias("jump"), F.when(F.col("known").isNull(), 0).otherwise(1).cast("long").alias("depth"))
    now = staged(now, "chat-depth")
    for _ in range(ceil(log2(max(2, now.count()))) + 1):
        waiting = now.where("jump is not null")
        if waiting.isEmpty():
            break
        ahead = now.select(F.col("id").alias("jump"), F.col("jump").alias("_jump"), F.col("depth").alias("_depth"))
        moved = waiting.join(ahead, "jump").select("id", F.col("_jump").alias("jump"), (F.col("depth") + F.col("_depth")).alias("depth"))
        now = staged(moved.unionByName(now.where("jump is null")), "chat-depth")
    return now.select("id", F.when(F.col("jump").isNull(), F.col("depth")).alias("depth"))


def ordered(linked: DataFrame) -> DataFrame:
    """Adds depth and position: the place, from 0, of each event in its conversation, after all that it waits for there."""
    conv = _conv()
    named = lambda c: F.concat(F.length(conv).cast("string"), F.lit(":"), conv, F.col(c))
    rows = staged(linked.withColumn("_conv", conv).withColumn("_id", named("event_id")).withColumn("_after", named("after_id")), "chat-linked")
    found = depths(rows.where("_id is not null").groupBy(F.col("_id").alias("id")).agg(F.min("_after").alias("after")))
    events = rows.where("kind <> 'turn'")
    deep = events.where("_id is not null").join(found, F.col("_id") == F.col("id")).drop("id")
    deep = deep.unionByName(events.where("_id is null").withColumn("depth", F.lit(None).cast("long")))
    last = F.coalesce("depth", F.lit(2**62))
    deep = deep.withColumns({"_last": last, "_one": F.lit(1), "_hash": F.xxhash64("name", "arguments", "content"), "_row": F.monotonically_increasing_id()})
    deep = staged(deep, "chat-events")
    placed = running(deep, ["_conv"], ["_last", "turn", "event_id", "kind", "_hash", "_row"], "_one", "_place", deep.count())
    status = F.when(F.col("depth").isNull() & F.col("event_id").isNotNull(), "cycle").otherwise(F.col("status"))
    return placed.withColumn("position", (F.col("_place") - 1).cast("long")).withColumn("status", status).select(*EVENT, "status", "depth", "position")


# A JSON text in pieces: strings, numbers, and what stands between them.
_PIECE = r'(?s)"(?:[^"\\]++|\\.)*+"|-?(?:0|[1-9][0-9]*+)(?:\.[0-9]+)?+(?:[eE][+-]?[0-9]+)?+|[^"0-9-]++|.'
_NUMBER = r"^-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?$"
#: Exponents up to which numbers are written out before they are parsed.
MOST_EXPONENT = 60


def _plain(piece: Column) -> Column:
    """A number without an exponent and without zeros at its end; other pieces as they are."""
    whole, part = F.regexp_extract(piece, r"^-?([0-9]+)", 1), F.regexp_extract(piece, r"\.([0-9]+)", 1)
    power = F.coalesce(F.regexp_extract(piece, r"[eE]([+-]?[0-9]+)$", 1).try_cast("int"), F.when(piece.rlike("[eE]"), F.lit(2**31 - 1)).otherwise(F.lit(0)))
    digits = F.concat(whole, part)
    point = F.length(whole) + F.greatest(F.least(power, F.lit(MOST_EXPONENT)), F.lit(-MOST_EXPONENT))
    left = F.when(point <= 0, F.lit("0")).otherwise(F.regexp_replace(F.rpad(digits, point, "0"), "^0+(?=[0-9])", ""))
    right = F.when(point <= 0, F.lpad(digits, F.length(digits) - point, "0")).otherwise(F.substring(digits, point + 1, F.length(digits)))
    right = F.regexp_replace(right, "0+$", "")
    value = F.concat(F.regexp_extract(piece, "^-?", 0), left, F.when(right == "", F.lit("")).otherwise(F.concat(F.lit("."), right)))
    small = (power >= -MOST_EXPONENT) & (power <= MOST_EXPONENT)
    return F.when(piece.rlike(_NUMBER) & piece.rlike("[.eE]"), F.when(digits.rlike("^0+$"), F.lit("0")).when(small, value).otherwise(piece)).otherwise(piece)


def canonical_numbers(text: Column) -> Column:
    """A JSON text whose equal numbers are written alike; null where one is beyond a double's range."""
    pieces = F.regexp_extract_all(text, F.lit(_PIECE), 0)
    beyond = F.exists(pieces, lambda p: p.rlike(_NUMBER) & (F.abs(p.try_cast("double")) == F.lit(float("inf"))))
    return F.when(text.rlike(r"[0-9][.eE]|[0-9]{300}"), F.when(~beyond, F.array_join(F.transform(pieces, _plain), ""))).otherwise(text)


def _valid(value: Column, schema: dict) -> Column:
    """Whether a variant fits a schema: type, required, properties, enum, minLength, maxLength, minimum, maximum."""
    kind = F.schema_of_variant(value)
    ok = {"object": F.startswith(kind, F.lit("OBJECT")), "array": F.startswith(kind, F.lit("ARRAY")), "string": kind == "STRING", "boolean": kind == "BOOLEAN", "integer": kind.rlike(r"^(BIGINT|DECIMAL\([0-9]+,0\))"), "number": kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), "null": kind == "VOID"}
    fits = ok[schema["type"]] if "type" in schema else F.lit(True)
    text, number = F.try_variant_get(value, "$", "string"), F.try_variant_get(value, "$", "double")
    for key, test in (("minLength", lambda x: F.length(text) >= x), ("maxLength", lambda x: F.length(text) <= x), ("minimum", lambda x: number >= x), ("maximum", lambda x: number <= x), ("enum", lambda x: F.to_json(value).isin([json.dumps(v, ensure_ascii=False) for v in x]))):
        if key in schema:
            fits = fits & F.coalesce(test(schema[key]), F.lit(False))
    for name, inner in schema.get("properties", {}).items():
        field = F.try_variant_get(value, f"$['{name}']", "variant")
        fits = fits & F.when(field.isNull(), F.lit(name not in schema.get("required", []))).otherwise(_valid(field, inner))
    return F.coalesce(fits, F.lit(False))


def serialised(placed: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """Adds valid (null but for calls) and json, canonical: keys in order, no spaces."""
    value = F.try_parse_json(canonical_numbers(F.col("arguments")))
    valid = F.lit(False)
    for name, schema in schemas.items():
        valid = F.when(F.col("name") == name, _valid(F.col("_value"), schema)).otherwise(valid)
    quoted = lambda c: F.when(c.isNull(), F.lit("null")).otherwise(F.substring(F.to_json(F.array(c)), F.lit(2), F.length(F.to_json(F.array(c))) - 2))
    arguments = F.when(F.startswith(F.schema_of_variant("_value"), F.lit("OBJECT")), F.to_json("_value"))
    call = F.concat(F.lit('{"arguments":'), F.coalesce(arguments, F.lit("null")), F.lit(',"id":'), quoted(F.col("call_id")), F.lit(',"name":'), quoted(F.col("name")), F.lit(',"type":"call"}'))
    result = F.concat(F.lit('{"content":'), quoted(F.col("content")), F.lit(',"tool_call_id":'), quoted(F.col("call_id")), F.lit(',"type":"result"}'))
    message = F.concat(F.lit('{"content":'), quoted(F.col("content")), F.lit(',"type":"message"}'))
    rows = placed.withColumn("_value", value)
    line = F.when(F.col("kind") == "call", call).when(F.col("kind") == "result", result).otherwise(message)
    return rows.withColumn("valid", F.when(F.col("kind") == "call", valid & arguments.isNotNull())).withColumn("json", line).drop("_value")


def tool_chats(messages: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """conv_id, turn, kind, call_id, status, depth, position, valid and json for each event of the messages."""
    events = staged(conversation_events(messages), "chat-messages")
    return serialised(ordered(link(events)), schemas).select("conv_id", "turn", "kind", "call_id", "status", "depth", "position", "valid", "json")
