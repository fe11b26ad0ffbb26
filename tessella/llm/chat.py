"""Chat formatting by tool-call linking.

Every row of a conversation becomes events: tool calls, tool results, or a message.

* A text that is a JSON object with ``tool_calls`` (a list of objects with id, name, arguments and, if wanted, a list
  ``after`` of the calls it needs) gives a call for each.
* A row with the role ``tool``, or a text that is a JSON object with ``tool_call_id``, gives a result.
* With ``plain`` set, user turns without JSON are calls of the tool ``reply`` with the id "conversation:turn", which
  needs the user turn before the last answer, and the assistant turn after it is its result.
* Everything else is a message.

Results are joined to calls by conversation and identifier.  Calls are ordered topologically: where every needed call
stands in an earlier row, the order of turns is such an order already and the level is 0; only conversations in which a
call needs a later one are levelled, one round for each level.  Calls on a cycle get the level -1.  Arguments are
checked against JSON schemas, and every event is written as canonical JSON: sorted keys, no spaces, UTF-8.

Defined results: null roles are messages, null texts are empty, a null conv_id never links; of several results with
one identifier the first by turn and text is linked and ``n_results`` tells how many there are, and every other one that
differs from it is an event of its own (``more_result``), so that no text is lost and no identifier gathers a long list;
several calls with one identifier each get the result; results without a call are events of their own (``orphan_result``);
needed calls that do not exist are ignored in the order.  A schema with an unknown type is a ValueError.  Texts that are JSON
only with NaN or infinite numbers are messages.  An empty table gives no rows.
"""

from __future__ import annotations

import json
import math
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, steps, stored

SCHEMAS = {
    "reply": {
        "type": "object",
        "required": ["prompt"],
        "properties": {"prompt": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}},
        "additionalProperties": False,
    }
}
_TYPES = {
    "object": lambda v: isinstance(v, dict),
    "array": lambda v: isinstance(v, list),
    "string": lambda v: isinstance(v, str),
    "boolean": lambda v: isinstance(v, bool),
    "null": lambda v: v is None,
    "integer": lambda v: (isinstance(v, int) and not isinstance(v, bool)) or (isinstance(v, float) and v.is_integer()),
    "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool),
}


_LONE = re.compile("[\ud800-\udfff]")


def _escaped(text: str) -> str:
    """Half surrogate pairs, which UTF-8 cannot hold, as JSON escapes."""
    return _LONE.sub(lambda m: f"\\u{ord(m.group()):04x}", text)


def canonical(value: object) -> str:
    return _escaped(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))


def checked(schema: dict, at: str = "$") -> dict:
    """The schema, if all types that it names are known."""
    kinds = schema.get("type", [])
    for k in [kinds] if isinstance(kinds, str) else kinds:
        if k not in _TYPES:
            raise ValueError(f"{at}: unknown type {k}")
    for name, inner in schema.get("properties", {}).items():
        checked(inner, f"{at}.{name}")
    for name in ("items", "additionalProperties"):
        if isinstance(schema.get(name), dict):
            checked(schema[name], f"{at}.{name}")
    return schema


def violations(value: object, schema: dict, at: str = "$") -> list[str]:
    """What a value breaks of a schema: type, enum, const, required, properties, additionalProperties, items and bounds."""
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_TYPES[k](value) for k in kinds):
        return [f"{at}: not of type {'|'.join(kinds)}"]
    out = []
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: not one of the allowed values")
    if "const" in schema and value != schema["const"]:
        out.append(f"{at}: not the required value")
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0):
            out.append(f"{at}: shorter than {schema['minLength']}")
        if len(value) > schema.get("maxLength", len(value)):
            out.append(f"{at}: longer than {schema['maxLength']}")
    elif isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", value):
            out.append(f"{at}: less than {schema['minimum']}")
        if value > schema.get("maximum", value):
            out.append(f"{at}: more than {schema['maximum']}")
    elif isinstance(value, list):
        if not schema.get("minItems", 0) <= len(value) <= schema.get("maxItems", len(value)):
            out.append(f"{at}: number of items")
        for i, x in enumerate(value):
            out += violations(x, schema.get("items", {}), f"{at}[{i}]")
    elif isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        rest = schema.get("additionalProperties", True)
        for k in value:
            if k in known:
                out += violations(value[k], known[k], f"{at}.{k}")
            elif rest is False:
                out.append(f"{at}.{k}: not allowed")
            elif isinstance(rest, dict):
                out += violations(value[k], rest, f"{at}.{k}")
    return sorted(out)


def _number(text: str) -> float:
    value = float(text)
    if not math.isfinite(value):
        raise ValueError("JSON has no such number")
    return value


def _parsed(text: str) -> dict | None:
    """A text that is a JSON object; NaN and numbers beyond all bounds are no JSON."""
    if not text.lstrip()[:1] == "{":
        return None
    try:
        value = json.loads(text, parse_float=_number, parse_constant=_number)
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def events(conv: int | None, turn: int | None, role: str | None, text: str, plain: bool) -> list[tuple]:
    """(kind, call_id, name, payload JSON, after) of each event of a row."""
    value = _parsed(text)
    if value is not None and isinstance(value.get("tool_calls"), list):
        out = []
        for k, call in enumerate(value["tool_calls"]):
            call = call if isinstance(call, dict) else {}
            arguments = call.get("arguments")
            if isinstance(arguments, str):
                inner = _parsed(arguments)
                arguments = arguments if inner is None else inner
            after = [_escaped(str(a)) for a in call["after"]] if isinstance(call.get("after"), list) else []
            out.append(("call", _escaped(str(call.get("id", f"{conv}:{turn}:{k}"))), _escaped(str(call.get("name", ""))), canonical(arguments), after))
        return out
    if role == "tool" or (value is not None and "tool_call_id" in value):
        return [("result", _escaped(str((value or {}).get("tool_call_id", ""))), None, canonical(text if value is None else value.get("content")), [])]
    if plain and turn is not None and role == "user":
        return [("call", f"{conv}:{turn}", "reply", canonical({"prompt": text, "turn": turn}), [f"{conv}:{turn - 2}"])]
    if plain and turn is not None and role == "assistant":
        return [("result", f"{conv}:{turn - 1}", None, canonical(text), [])]
    return [("message", None, None, canonical(text), [])]


_EVENT = "conv_id long, turn long, ordinal int, role string, kind string, call_id string, name string, payload string, after array<string>"


def _split(plain: bool):
    def run(batches):
        for batch in batches:
            for part, texts in steps(batch, "text"):
                convs, turns, roles = (part.column(part.schema.get_field_index(c)).to_pylist() for c in ("conv_id", "turn", "role"))
                rows = [(c, t, k, r, *e) for c, t, r, x in zip(convs, turns, roles, texts) for k, e in enumerate(events(c, t, r, x, plain))]
                if rows:
                    types = [pa.int64(), pa.int64(), pa.int32(), *[pa.string()] * 5, pa.list_(pa.string())]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[x.split()[0] for x in _EVENT.split(", ")])

    return run


@lru_cache(maxsize=8)
def _schemas(text: str) -> dict:
    return json.loads(text)


_FORMATTED = "conv_id long, turn long, ordinal int, kind string, call_id string, level int, valid boolean, n_errors int, n_results long, result_turn long, json string"


def _written(schemas: str):
    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            columns = {n: batch.column(batch.schema.get_field_index(n)).to_pylist() for n in batch.schema.names}
            for i in range(batch.num_rows):
                c = {n: v[i] for n, v in columns.items()}
                body: dict = {"conv_id": c["conv_id"], "turn": c["turn"], "type": c["kind"]}
                valid, errors = None, []
                payload = json.loads(c["payload"])
                if c["kind"] == "call":
                    schema = _schemas(schemas).get(c["name"])
                    errors = [f"$: no tool named {c['name']}"] if schema is None else violations(payload, schema)
                    valid = not errors
                    body |= {"id": c["call_id"], "name": c["name"], "arguments": payload, "errors": errors, "result": None if c["result"] is None else json.loads(c["result"])}
                elif c["kind"] in ("orphan_result", "more_result"):
                    body |= {"id": c["call_id"], "result": payload}
                else:
                    body |= {"role": c["role"], "text": payload}
                out.append((c["conv_id"], c["turn"], c["ordinal"], c["kind"], c["call_id"], c["level"], valid, len(errors), c["n_results"], c["result_turn"], canonical(body)))
            types = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names=[x.split()[0] for x in _FORMATTED.split(", ")])

    return run


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of the calls that need levelling: those in conversations where a call needs a later one.

    ``calls`` has conv_id, turn, call_id, after.  A call's level is one more than the highest of those it needs; calls
    on a cycle, or behind one, get -1.
    """
    nodes = calls.where("conv_id is not null").groupBy("conv_id", "call_id").agg(F.min("turn").alias("turn"))
    needs = calls.select("conv_id", "call_id", F.explode("after").alias("need"))
    known = nodes.select("conv_id", F.col("call_id").alias("need"), F.col("turn").alias("need_turn"))
    edges = needs.join(known, ["conv_id", "need"]).join(nodes, ["conv_id", "call_id"]).select("conv_id", "call_id", "need", "turn", "need_turn").distinct()
    mixed_up = stored(edges.where("need_turn >= turn").select("conv_id").distinct())
    edges = stored(edges.join(mixed_up, "conv_id", "left_semi").select("conv_id", "call_id", "need"))
    left = stored(nodes.join(mixed_up, "conv_id", "left_semi").select("conv_id", "call_id"))
    done, level = left.limit(0).withColumn("level", F.lit(0)), 0
    while not left.isEmpty():
        ready = stored(left.join(edges.select("conv_id", "call_id").distinct(), ["conv_id", "call_id"], "left_anti"))
        if ready.isEmpty():
            return done.unionByName(left.withColumn("level", F.lit(-1)))
        done = done.unionByName(ready.withColumn("level", F.lit(level)))
        left = stored(left.join(ready, ["conv_id", "call_id"], "left_anti"))
        edges = stored(edges.join(ready.withColumnRenamed("call_id", "need"), ["conv_id", "need"], "left_anti"))
        level += 1
    return done


def format_chats(conversations: DataFrame, schemas: dict = SCHEMAS, plain: bool = True) -> DataFrame:
    """One row per event of (conv_id, turn, role, text), sorted into order by conv_id, level, turn, ordinal.

    Columns: conv_id, turn, ordinal, kind (call, more_result, orphan_result or message), call_id, level, valid (calls only), n_errors,
    n_results, result_turn, json.
    """
    for name, schema in schemas.items():
        checked(schema, name)
    rows = stored(map_arrow(conversations.select("conv_id", "turn", "role", "text"), _split(plain), _EVENT))
    calls = rows.where("kind = 'call'")
    results = (
        rows.where("kind = 'result' and conv_id is not null")
        .groupBy("conv_id", "call_id")
        .agg(F.min(F.struct("turn", "payload")).alias("first"), F.count("*").alias("n_results"))
        .select("conv_id", "call_id", F.col("first.payload").alias("result"), F.col("first.turn").alias("result_turn"), "n_results")
    )
    known = calls.where("conv_id is not null").select("conv_id", "call_id").distinct()
    linked = (
        calls.join(results, ["conv_id", "call_id"], "left")
        .join(levels(calls.select("conv_id", "turn", "call_id", "after")), ["conv_id", "call_id"], "left")
        .withColumn("level", F.coalesce("level", F.lit(0)))
        .withColumn("n_results", F.coalesce("n_results", F.lit(0).cast("long")))
    )
    orphans = rows.where("kind = 'result'").join(known, ["conv_id", "call_id"], "left_anti").withColumn("kind", F.lit("orphan_result"))
    firsts = results.join(known, ["conv_id", "call_id"]).select("conv_id", "call_id", F.col("result").alias("first"), "result_turn")
    more = (
        rows.where("kind = 'result'")
        .join(firsts, ["conv_id", "call_id"])
        .where(~(F.col("turn").eqNullSafe(F.col("result_turn")) & (F.col("payload") == F.col("first"))))
        .select(*rows.columns)
        .withColumn("kind", F.lit("more_result"))
    )
    others = orphans.unionByName(more).unionByName(rows.where("kind = 'message'")).select(
        "*", F.lit(None).cast("string").alias("result"), F.lit(None).cast("long").alias("result_turn"), F.lit(0).cast("long").alias("n_results"), F.lit(0).alias("level")
    )
    every = linked.unionByName(others).select("conv_id", "turn", "ordinal", "kind", "role", "call_id", "name", "payload", "level", "result", "result_turn", "n_results")
    return map_arrow(every, _written(json.dumps(schemas)), _FORMATTED)
