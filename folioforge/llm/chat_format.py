"""Operator 7: chat formatting with tool-call linking.

Method: calls and results are hash-joined by identifier, calls are put in a
topological order of what they depend on, their arguments are validated against the
schemas of their tools, and every message is serialised as canonical JSON (keys
sorted, no spaces, characters as they are, whole floats as integers).

Messages stay one row each, with columns to sort a conversation by, so a conversation
of any length is never gathered in one task.  Identifiers are joined within their
conversation; the join's keys are (conversation, identifier), not the conversation.

A call's place is (turn, at); where all it needs stands before it, the place is the
order.  Else it is put right after the last call that it needs, directly or not: that
one's place is ``after``, and ``level`` counts the calls on the way to it.  Only calls
that come after a call with a need further on enter the loop that finds these; chains
of single needs are halved each round, so the rounds follow the logarithm of a chain.

Defined results: a call without a result and a result without a call are kept and
marked; of several calls with one identifier in a conversation the first (turn,
position) links, and of several results the first answers.  Calls that depend on
each other in a circle, and what needs them, come last, in the order of their places,
and are marked.  Arguments that aren't a JSON object (not JSON, nested over
``DEPTH`` deep, with a number that isn't finite or is too long to read) are invalid,
and serialised as the string they are; lone surrogates become U+FFFD.  Null text is an empty string;
null ids link with nothing; a null place comes first.  Repeated rows give repeated
rows.  Very long texts are serialised whole.  An empty table gives an empty table;
other columns of the inputs are not looked at.
"""

from __future__ import annotations

import functools
import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.llm import common as C

CALLS = "conv_id long, turn long, at int, call_id string, name string, arguments string, needs array<string>"
RESULT = (
    "conv_id long, turn long, at int, kind string, after_turn long, after_at int, level int, call_id string, linked boolean, valid boolean, "
    "errors array<string>, json string"
)
#: The level of calls in a circle.
CIRCULAR = 2147483647
#: Arguments may be nested so deep.
DEPTH = 200
#: Keywords of JSON Schema that are checked, and those that say nothing about a value.
CHECKED = frozenset(
    "type enum const minLength maxLength pattern minimum maximum exclusiveMinimum exclusiveMaximum multipleOf properties required additionalProperties "
    "minProperties maxProperties items minItems maxItems uniqueItems allOf anyOf oneOf not".split()
)
SILENT = frozenset("title description default examples deprecated readOnly writeOnly format $schema $id $comment".split())
KINDS = {"string": str, "boolean": bool, "object": dict, "array": list, "null": type(None)}


def plain(value, depth: int = 0):
    """The value with whole floats as integers; a ValueError where it nests too deep."""
    if depth > DEPTH:
        raise ValueError("nested too deep")
    if isinstance(value, dict):
        return {k: plain(v, depth + 1) for k, v in value.items()}
    if isinstance(value, list):
        return [plain(v, depth + 1) for v in value]
    if isinstance(value, float) and value.is_integer() and abs(value) < 1 << 53:
        return int(value)
    return value


def refused(text: str):
    raise ValueError(f"not a JSON number: {text}")


def finite(text: str) -> float:
    return value if math.isfinite(value := float(text)) else refused(text)


def parsed(text: str | None):
    """The value of a JSON text; the text itself where it is none."""
    try:
        return plain(json.loads(text if text is not None else "null", parse_constant=refused, parse_float=finite))
    except (ValueError, RecursionError):
        return text


def canonical(value) -> str:
    text = json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    try:
        text.encode()
    except UnicodeEncodeError:
        text = text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    return text


def is_kind(value, kind: str) -> bool:
    if kind == "integer":
        return isinstance(value, int) and not isinstance(value, bool)
    if kind == "number":
        return isinstance(value, (int, float)) and not isinstance(value, bool)
    return isinstance(value, KINDS[kind])


def check_schema(schema, where: str = "$") -> None:
    """A ValueError if a schema has a keyword or type that ``problems`` doesn't know."""
    if isinstance(schema, bool):
        return
    if unknown := sorted(set(schema) - CHECKED - SILENT):
        raise ValueError(f"{where}: unknown keywords {', '.join(unknown)}")
    for kind in kinds_of(schema):
        if kind not in KINDS and kind not in ("integer", "number"):
            raise ValueError(f"{where}: unknown type {kind}")
    below = dict(schema.get("properties", {})) | {k: schema[k] for k in ("items", "additionalProperties", "not") if k in schema}
    below |= {f"{k}[{i}]": x for k in ("allOf", "anyOf", "oneOf") for i, x in enumerate(schema.get(k, []))}
    for name, part in below.items():
        check_schema(part, f"{where}.{name}")


def kinds_of(schema: dict) -> list[str]:
    kinds = schema.get("type", [])
    return [kinds] if isinstance(kinds, str) else kinds


def problems(value, schema, where: str = "$") -> list[str]:
    """What in ``value`` the schema doesn't allow."""
    if isinstance(schema, bool):
        return [] if schema else [f"{where}: not allowed"]
    kinds = kinds_of(schema)
    if kinds and not any(is_kind(value, k) for k in kinds):
        return [f"{where}: not {'|'.join(kinds)}"]
    out = []
    if "enum" in schema and canonical(value) not in map(canonical, map(plain, schema["enum"])):
        out.append(f"{where}: not in enum")
    if "const" in schema and canonical(value) != canonical(plain(schema["const"])):
        out.append(f"{where}: not the constant")
    if isinstance(value, str):
        out += bounded(len(value), schema, where, "minLength", "maxLength", "too short", "too long")
        if "pattern" in schema and not re.search(schema["pattern"], value):
            out.append(f"{where}: not of the pattern")
    if is_kind(value, "number"):
        out += bounded(value, schema, where, "minimum", "maximum", "below minimum", "above maximum")
        if value <= schema.get("exclusiveMinimum", -math.inf) or value >= schema.get("exclusiveMaximum", math.inf):
            out.append(f"{where}: out of bounds")
        if "multipleOf" in schema and value % schema["multipleOf"]:
            out.append(f"{where}: not a multiple")
    if isinstance(value, dict):
        known, rest = schema.get("properties", {}), schema.get("additionalProperties", True)
        out += [f"{where}.{k}: missing" for k in schema.get("required", []) if k not in value]
        out += bounded(len(value), schema, where, "minProperties", "maxProperties", "too few properties", "too many properties")
        if rest is False:
            out += [f"{where}.{k}: unknown" for k in sorted(value) if k not in known]
        for k in sorted(value):
            if k in known:
                out += problems(value[k], known[k], f"{where}.{k}")
            elif not isinstance(rest, bool):
                out += problems(value[k], rest, f"{where}.{k}")
    if isinstance(value, list):
        out += bounded(len(value), schema, where, "minItems", "maxItems", "too few items", "too many items")
        if schema.get("uniqueItems") and len(set(map(canonical, value))) < len(value):
            out.append(f"{where}: repeated items")
        for i, x in enumerate(value) if "items" in schema else ():
            out += problems(x, schema["items"], f"{where}[{i}]")
    for part in schema.get("allOf", []):
        out += problems(value, part, where)
    if "anyOf" in schema and all(problems(value, part, where) for part in schema["anyOf"]):
        out.append(f"{where}: none of anyOf")
    if "oneOf" in schema and sum(not problems(value, part, where) for part in schema["oneOf"]) != 1:
        out.append(f"{where}: not one of oneOf")
    if "not" in schema and not problems(value, schema["not"], where):
        out.append(f"{where}: not allowed")
    return out


def bounded(x, schema: dict, where: str, low: str, high: str, under: str, over: str) -> list[str]:
    return [f"{where}: {under}"] * (x < schema.get(low, x)) + [f"{where}: {over}"] * (x > schema.get(high, x))


def place_of(turn: str, at: str) -> Column:
    return F.struct(F.col(turn).alias("turn"), F.col(at).alias("at"))


def order_calls(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, after, level) of the calls that don't stand in order by their place.

    State of an open call: what its place and its settled needs come to, the edges to
    needs that are open.  An edge is a function of the need's result (after, level):
    (after, level + hops) if that is beyond ``top``, else (top, at least ``least``).
    Such functions compose, so a call with one edge whose need has one edge skips it.
    """
    named = calls.where(F.col("call_id").isNotNull() & F.col("conv_id").isNotNull())
    named = named.groupBy("conv_id", "call_id").agg(F.min_by(F.struct(place_of("turn", "at").alias("place"), "needs"), place_of("turn", "at")).alias("first"))
    named = named.select("conv_id", "call_id", F.col("first.place").alias("place"), F.col("first.needs").alias("needs"))
    places = named.select("conv_id", "call_id", "place")
    edges = named.select("conv_id", "call_id", "place", F.explode("needs").alias("need")).distinct()
    edges = edges.join(places.toDF("conv_id", "need", "need_place"), ["conv_id", "need"])
    edges = C.written(edges.select("conv_id", "call_id", "place", "need", "need_place"), "edges")
    # What stands before the first call with a need further on is in order.
    since = C.written(edges.where("need_place >= place").groupBy("conv_id").agg(F.min("place").alias("since")), "since")
    empty = places.limit(0).select("conv_id", "call_id", F.col("place").alias("after"), F.lit(0).alias("level"))
    if since.isEmpty():
        return empty
    late = edges.join(since, "conv_id").where("place >= since")
    open_ = late.select("conv_id", "call_id").distinct()
    inner = late.join(open_.toDF("conv_id", "need"), ["conv_id", "need"], "left_semi")
    outer = late.join(open_.toDF("conv_id", "need"), ["conv_id", "need"], "left_anti").groupBy("conv_id", "call_id").agg(F.max("need_place").alias("high"))
    # A settled need further on puts the call one level after it.
    state = late.select("conv_id", "call_id", "place").distinct().join(outer, ["conv_id", "call_id"], "left")
    beyond = F.coalesce(F.col("high") > F.col("place"), F.lit(False))
    state = state.select("conv_id", "call_id", F.when(beyond, F.col("high")).otherwise(F.col("place")).alias("top"), beyond.cast("int").alias("least"))
    state = C.written(state, "state")
    links = C.written(inner.select("conv_id", "call_id", "need", F.lit(1).cast("long").alias("hops")), "links")
    done, spare, total = [], None, state.count()
    key, to_need = ["conv_id", "call_id"], ["conv_id", "need"]
    while True:
        out = links.groupBy(*key).agg(F.count("*").alias("edges"), F.min("need").alias("need"), F.max("hops").alias("hops"))
        held = C.written(state.join(out, key, "left").withColumn("edges", F.coalesce("edges", F.lit(0))), "held")
        # Settled: nothing open is needed.
        ready = C.written(held.where("edges = 0").select(*key, F.col("top").alias("after"), F.col("least").alias("level")), "ready")
        done.append(ready)
        if len(done) == 16:  # the plan of the result stays small
            merged = C.written(functools.reduce(DataFrame.unionByName, done), "ready")
            C.discard(*done[:-1])
            spare, done = ready, [merged]
        waiting = held.where("edges > 0")
        single = held.where("edges = 1").select("conv_id", F.col("call_id").alias("need"), F.col("need").alias("next"), F.col("top").alias("n_top"), F.col("least").alias("n_least"), F.col("hops").alias("n_hops"))
        # A need that is settled now settles its call in the next round, and isn't skipped to.
        single = single.join(ready.select("conv_id", F.col("call_id").alias("next")), ["conv_id", "next"], "left_anti")
        got = links.join(ready.select("conv_id", F.col("call_id").alias("need"), "after", "level"), to_need)
        best = got.groupBy(*key).agg(F.max(F.struct("after", (F.col("level") + F.col("hops")).cast("int").alias("level"))).alias("got"))
        rest = links.join(ready.select("conv_id", F.col("call_id").alias("need")), to_need, "left_anti")
        # One edge, to a call with one edge: skip it, and take over what it comes to.
        jump = waiting.where("edges = 1").join(single, to_need).select(
            *key, "next", (F.col("hops") + F.col("n_hops")).alias("hops"), F.struct(F.col("n_top").alias("after"), (F.col("n_least") + F.col("hops")).cast("int").alias("level")).alias("via"),
        )
        jump = C.written(jump, "jump")
        merged = waiting.select(*key, "top", "least").join(best, key, "left").join(jump.select(*key, "via"), key, "left")
        mine = F.struct(F.col("top").alias("after"), F.col("least").alias("level"))
        found = F.greatest(mine, F.col("got"), F.col("via"))
        new_state = C.written(merged.withColumn("found", found).select(*key, F.col("found.after").alias("top"), F.col("found.level").alias("least")), "state")
        kept = rest.join(jump.select(*key), key, "left_anti").select(*key, "need", "hops")
        # More hops than calls: a circle.
        new_links = C.written(kept.unionByName(jump.select(*key, F.col("next").alias("need"), "hops")), "links")
        moved = not ready.isEmpty() or not jump.isEmpty()
        turning = new_links.where(F.col("hops") > total).select(*key).distinct()
        C.discard(held, jump, state, links, *([spare] if spare is not None else []))
        spare = None
        state, links = new_state, new_links
        if not moved or state.isEmpty():
            break
        if not turning.isEmpty():  # what needs a circle stays open, and is found when nothing moves
            state, links = C.written(state.join(turning, key, "left_anti"), "state"), C.written(links.join(turning, key, "left_anti"), "links")
            C.discard(new_state, new_links)
    settled = C.written(functools.reduce(DataFrame.unionByName, done), "settled")
    C.discard(*done)
    circular = open_.join(settled.select(*key), key, "left_anti").join(places, key)
    return settled.unionByName(circular.select(*key, F.col("place").alias("after"), F.lit(CIRCULAR).alias("level")))


def link_calls(messages: DataFrame, calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """RESULT: one row for each message (kind: its role), call and result, with its canonical JSON.

    messages: conv_id, turn, role, text.  calls: CALLS.  results: conv_id, turn,
    call_id, text.  Sort a conversation by (level = CIRCULAR, after_turn, kind = 'result',
    kind = 'call', after_at, level, turn, at): within a turn, calls follow the message in
    topological order.  ``schemas`` maps tool names to JSON schemas; a call of another
    tool is invalid.
    """
    for name, schema in schemas.items():
        check_schema(schema, name)
    spark = C.prepared(messages.sparkSession)
    shared = spark.sparkContext.broadcast(schemas)
    key = ["conv_id", "call_id"]
    first = calls.where(F.col("call_id").isNotNull()).groupBy(*key).agg(F.min(F.struct("turn", "at")).alias("first"))
    answers = results.where(F.col("call_id").isNotNull()).groupBy(*key).agg(F.min("turn").alias("answer_turn"))
    c = calls.join(first, key, "left").join(answers, key, "left").join(order_calls(calls), key, "left")
    is_first = F.coalesce(F.struct("turn", "at") == F.col("first"), F.lit(False))
    moved = is_first & F.col("after").isNotNull()
    c = c.select(
        "conv_id", "turn", "at", F.lit("call").alias("kind"), F.when(moved, F.col("after.turn")).otherwise(F.col("turn")).alias("after_turn"),
        F.when(moved, F.col("after.at")).otherwise(F.col("at")).alias("after_at"), F.when(moved, F.col("level")).otherwise(F.lit(0)).alias("level"), "call_id",
        (is_first & F.col("answer_turn").isNotNull()).alias("linked"), "name", F.col("arguments").alias("text"), F.lit(None).cast("long").alias("of"),
    )
    zero = F.lit(0)
    here = [F.col("turn").alias("after_turn"), zero.alias("after_at"), zero.alias("level")]
    r = results.join(first, key, "left").join(answers, key, "left").select(
        "conv_id", "turn", zero.alias("at"), F.lit("result").alias("kind"), *here, "call_id",
        (F.col("first").isNotNull() & F.coalesce(F.col("turn") == F.col("answer_turn"), F.lit(False))).alias("linked"),
        F.lit(None).cast("string").alias("name"), "text", F.col("first.turn").alias("of"),
    )
    none = F.lit(None)
    m = messages.select(
        "conv_id", "turn", zero.alias("at"), F.lit("message").alias("kind"), *here, none.cast("string").alias("call_id"),
        none.cast("boolean").alias("linked"), F.col("role").alias("name"), "text", none.cast("long").alias("of"),
    )

    def format_(batch: pa.RecordBatch) -> Iterator[dict]:
        valid, errors, texts = [], [], []
        for kind, level, call_id, name, text, of in zip(*(batch.column(batch.schema.get_field_index(x)).to_pylist() for x in ("kind", "level", "call_id", "name", "text", "of")), strict=True):
            wrong, ok = None, None
            if kind == "call":
                value = parsed(text)
                if not isinstance(value, dict):
                    wrong = ["$: not a JSON object"]
                elif name not in shared.value:
                    wrong = ["unknown tool"]
                else:
                    wrong = problems(value, shared.value[name])
                if level == CIRCULAR:
                    wrong = [*wrong, "circular"]
                ok = not wrong
                row = {"arguments": value, "id": call_id, "name": name, "type": "call"}
            elif kind == "result":
                row = {"content": text or "", "id": call_id, "of_turn": of, "type": "result"}
            else:
                row = {"content": text or "", "role": name, "type": "message"}
            valid.append(ok)
            errors.append([canonical(x)[1:-1] if not x.isascii() else x for x in wrong] if wrong is not None else None)
            texts.append(canonical(row))
        same = {x: batch.column(batch.schema.get_field_index(x)) for x in ("conv_id", "turn", "at", "kind", "after_turn", "after_at", "level", "call_id", "linked")}
        yield same | {"valid": valid, "errors": pa.array(errors, pa.list_(pa.string())), "json": texts}

    return C.arrow_map(m.unionByName(c).unionByName(r), format_, RESULT)


#: The tools that stand for an answer and for a summary in plain conversations: see ``exchanges``.
REPLY = {
    "reply": {
        "type": "object", "required": ["prompt", "turn"], "additionalProperties": False,
        "properties": {"prompt": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}},
    },
    "title": {"type": "object", "required": ["last"], "additionalProperties": False, "properties": {"last": {"type": "integer", "minimum": 0}}},
}


def exchanges(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The calls and results of plain conversations.

    Each user turn calls ``reply`` with its text, under the identifier of the turn, and
    needs the call of the user turn before; the assistant's next turn is its result.  At
    the last user turn ``title`` is called first, but needs that turn's reply.
    """
    user = messages.where("role = 'user'")
    calls = user.select(
        "conv_id", "turn", F.lit(0).alias("at"), F.col("turn").cast("string").alias("call_id"), F.lit("reply").alias("name"),
        F.to_json(F.struct("turn", F.coalesce("text", F.lit("")).alias("prompt"))).alias("arguments"),
        F.when(F.col("turn") >= 2, F.array((F.col("turn") - 2).cast("string"))).otherwise(F.array().cast("array<string>")).alias("needs"),
    )
    last = user.groupBy("conv_id").agg(F.max("turn").alias("turn")).where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    titles = last.select(
        "conv_id", "turn", F.lit(-1).alias("at"), F.lit("title").alias("call_id"), F.lit("title").alias("name"),
        F.to_json(F.struct(F.col("turn").alias("last"))).alias("arguments"), F.array(F.col("turn").cast("string")).alias("needs"),
    )
    results = messages.where("role = 'assistant'").select("conv_id", "turn", (F.col("turn") - 1).cast("string").alias("call_id"), "text")
    return calls.unionByName(titles), results
