"""Chat formatting with linked tool calls.

Messages (conversation, turn, role, text) are read once into parts: plain text, calls and results. Calls stand in an
assistant's text as ``<tool_call>{"id": ..., "name": ..., "arguments": {...}}</tool_call>``, results in any text as
``<tool_result>{"id": ..., "content": ...}</tool_result>``. With ``turns_as_calls``, for corpora that record no
markup, each user turn is the call ``reply`` with its text as argument, and the assistant turn after it its result.

1. Calls and results are hash-joined by (conversation, identifier, occurrence): the k-th result of an identifier
   belongs to its k-th call.
2. Order. A result depends on its call; a call depends on the results that its arguments name as ``{"$ref": id}``. Each
   part's place is the largest turn among itself and what it depends on, its depth the length of the longest chain
   below it; (place, depth, turn, part) is a topological order that moves nothing without need. Rounds of a join over
   the references settle places, as many as the longest chain; parts on a cycle never settle and are reported.
3. Arguments are validated against the schema of the call's name (types, required, properties, enum, bounds, items).
4. Every part is serialised as canonical JSON: sorted keys, no spaces, no escapes but the necessary ones.

A row per part, and not per conversation, keeps a conversation of any length from meeting in one task.

Edge cases: null and empty texts are plain parts with empty content; markup that isn't JSON stays plain text; a call
without a result, and a result without a call, have linked = false and keep their turn; null ids of conversations are a
conversation like others; repeated rows are parts of their own, linked by occurrence; an unknown name, or one without
schema, is invalid; other columns are ignored.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, over_batches

_MARK = re.compile(r"<(tool_call|tool_result)>(.*?)</\1>", re.S)
_TYPES = {"string": str, "boolean": bool, "object": dict, "array": list, "null": type(None)}

Schema = dict[str, Any]


#: Levels of arrays and objects in markup; deeper markup stays text.
MAX_DEPTH = 64
_LONE = re.compile("[\ud800-\udfff]")


def encodable(text: str) -> str:
    """The text; half surrogates, which UTF-8 cannot hold, as escapes."""
    return _LONE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def canonical(value: Any) -> str:
    return encodable(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))


def _no_constant(name: str) -> Any:
    raise ValueError(f"{name} is not JSON")


def _finite(text: str) -> float:
    if not math.isfinite(value := float(text)):
        raise ValueError("the number is too large")
    return value


def decoded(text: str) -> Any:
    """The value of JSON text. ValueError for anything else: NaN and infinities, numbers beyond a double, more than MAX_DEPTH levels."""
    try:
        value = json.loads(text, parse_constant=_no_constant, parse_float=_finite)
    except RecursionError:
        raise ValueError("nested too deeply") from None
    level = [value]
    for _ in range(MAX_DEPTH):
        level = [x for v in level for x in (v.values() if isinstance(v, dict) else v if isinstance(v, list) else ())]
        if not level:
            return value
    raise ValueError("nested too deeply")


def errors(value: Any, schema: Schema, at: str = "$") -> list[str]:
    """What a value breaks of a schema; empty if nothing."""
    kind = schema.get("type")
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    if kind:
        fits = number and (kind == "number" or isinstance(value, int) or value.is_integer()) if kind in ("number", "integer") else isinstance(value, _TYPES[kind])
        if not fits:
            return [f"{at}: not {kind}"]
    out = []
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: not in enum")
    if isinstance(value, str) and not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", len(value)):
        out.append(f"{at}: length")
    if number and not schema.get("minimum", value) <= value <= schema.get("maximum", value):
        out.append(f"{at}: bounds")
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            out += errors(x, schema["items"], f"{at}[{i}]")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k, x in value.items():
            if k in known:
                out += errors(x, known[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{at}.{k}: unknown")
    return out


def references(value: Any) -> list[str]:
    """Identifiers that {"$ref": id} names anywhere inside."""
    if isinstance(value, dict):
        if set(value) == {"$ref"} and isinstance(value["$ref"], str):
            return [value["$ref"]]
        return [r for v in value.values() for r in references(v)]
    return [r for v in value for r in references(v)] if isinstance(value, list) else []


Part = tuple[str, str | None, str, bool | None, str | None, list[str]]


def parts(role: str | None, text: str | None, turn: int | None, schemas: dict[str, Schema], turns_as_calls: bool) -> list[Part]:
    """(kind, identifier, JSON, valid, errors, references) of one message."""

    def call(name: Any, identifier: str, arguments: Any) -> Part:
        wrong = errors(arguments, schemas[name]) if isinstance(name, str) and name in schemas else ["$: no schema"]
        body = {"arguments": arguments, "id": identifier, "name": name, "role": role, "type": "call"}
        return "call", encodable(identifier), canonical(body), not wrong, encodable("; ".join(wrong)) or None, [encodable(r) for r in references(arguments)]

    def result(identifier: str, content: Any) -> Part:
        return "result", encodable(identifier), canonical({"content": content, "id": identifier, "role": role, "type": "result"}), None, None, []

    def plain(content: str) -> Part:
        return "text", None, canonical({"content": content, "role": role, "type": "text"}), None, None, []

    text = text or ""
    if turns_as_calls and turn is not None and role in ("user", "assistant"):
        return [call("reply", str(turn), {"text": text})] if role == "user" else [result(str(turn - 1), text)]
    out: list[Part] = []
    at = 0
    for m in _MARK.finditer(text):
        try:
            body = decoded(m[2])
        except ValueError:
            continue
        if not isinstance(body, dict) or "id" not in body or m[1] == "tool_call" and (role != "assistant" or "name" not in body):
            continue
        if text[at : m.start()].strip():
            out.append(plain(text[at : m.start()].strip()))
        at = m.end()
        out.append(call(body["name"], str(body["id"]), body.get("arguments", {})) if m[1] == "tool_call" else result(str(body["id"]), body.get("content")))
    if text[at:].strip() or not out:
        out.append(plain(text[at:].strip() if out else text))
    return out


def format_chat(
    messages: DataFrame,
    schemas: dict[str, Schema],
    turns_as_calls: bool = False,
    conversation_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """conv_id, turn, part, role, kind, call_id, linked, valid, errors, place, depth (null on a cycle), json."""
    names = ["conv_id", "turn", "role", "part", "kind", "call_id", "json", "valid", "errors", "refs"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for conversation, turn, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows += [(conversation, turn, role, i, *p) for i, p in enumerate(parts(role, text, turn, schemas, turns_as_calls))]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.string(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    schema = "conv_id long, turn long, role string, part long, kind string, call_id string, json string, valid boolean, errors string, refs array<string>"
    m = messages.select(F.col(conversation_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    same = Window.partitionBy("conv_id", "kind", "call_id", F.when(F.col("call_id").isNull(), F.xxhash64("turn", "part", "json")))
    p = m.transform(over_batches, read, schema).withColumn("occurrence", F.row_number().over(same.orderBy("turn", "part", F.xxhash64("json"))))
    p = cut(p)

    key = ["conv_id", "call_id", "occurrence"]
    call = p.where("kind = 'call'").select(*[F.col(c).alias(f"_{c}") for c in key], F.col("turn").alias("_turn"), F.col("refs").alias("_refs"))
    done = p.where("kind = 'result'").select(*[F.col(c).alias(f"_{c}") for c in key]).withColumn("_answered", F.lit(True))
    on = F.col("conv_id").eqNullSafe(F.col("_conv_id")) & (F.col("call_id") == F.col("_call_id")) & (F.col("occurrence") == F.col("_occurrence"))
    drop = [f"_{c}" for c in key]

    # Places and depths of calls. Calls without references are settled at once.
    calls = p.where("kind = 'call'").select(*key, "turn", F.array_distinct("refs").alias("refs"))
    settled = calls.where(F.size("refs") == 0).select(*key, F.col("turn").alias("place"), F.lit(0).cast("long").alias("depth"))
    waiting = cut(calls.where(F.size("refs") > 0))
    if waiting.limit(1).count():
        settled, known = cut(settled), cut(calls.select("conv_id", "call_id").distinct().withColumnsRenamed({"conv_id": "_c", "call_id": "_i"}))
        edges = waiting.withColumn("ref", F.explode("refs")).join(known, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("ref") == F.col("_i")), "left")
        edges = cut(edges.select(*key, "turn", F.when(F.col("_i").isNotNull(), F.col("ref")).alias("ref")))  # unknown references bind nothing
        results = p.where("kind = 'result'").groupBy(F.col("conv_id").alias("_rc"), F.col("call_id").alias("_ri")).agg(F.max("turn").alias("_rturn"))
        while True:
            ends = settled.groupBy(F.col("conv_id").alias("_c"), F.col("call_id").alias("_i")).agg(F.max("place").alias("_place"), F.max("depth").alias("_depth"))
            ready = edges.join(ends, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("ref") == F.col("_i")), "left")
            ready = ready.join(results, F.col("conv_id").eqNullSafe(F.col("_rc")) & (F.col("ref") == F.col("_ri")), "left")
            ready = ready.withColumn("_open", F.col("ref").isNotNull() & F.col("_i").isNull())
            step = ready.groupBy(*key, "turn").agg(F.max("_open").alias("_open"), F.max(F.greatest("_place", "_rturn")).alias("_place"), F.max("_depth").alias("_depth")).where("NOT _open")
            new = step.select(*key, F.greatest("turn", "_place").alias("place"), F.coalesce(F.col("_depth") + 2, F.lit(0)).cast("long").alias("depth"))
            new = cut(new.join(settled.select(*[F.col(c).alias(f"_{c}") for c in key]), on, "left_anti"))
            if not new.limit(1).count():
                break
            settled = cut(settled.unionByName(new))

    at = settled.select(*[F.col(c).alias(f"_{c}") for c in key], F.col("place").alias("_place"), F.col("depth").alias("_depth"))
    texts = p.where("kind = 'text'").select("*", F.lit(None).cast("boolean").alias("linked"), F.col("turn").alias("place"), F.lit(0).cast("long").alias("depth"))
    of_calls = p.where("kind = 'call'").join(done.hint("shuffle_hash"), on, "left").drop(*drop).join(at, on, "left").drop(*drop)
    of_calls = of_calls.select(*p.columns, F.coalesce("_answered", F.lit(False)).alias("linked"), F.col("_place").alias("place"), F.col("_depth").alias("depth"))
    of_results = p.where("kind = 'result'").join(call.drop("_refs").hint("shuffle_hash"), on, "left").withColumn("linked", F.col("_call_id").isNotNull()).drop(*drop).join(at, on, "left").drop(*drop)
    place = F.when(F.col("linked"), F.greatest(F.col("turn"), F.col("_place"))).otherwise(F.col("turn"))
    place = F.when(F.col("linked") & F.col("_place").isNull(), F.lit(None)).otherwise(place)
    of_results = of_results.select(*p.columns, "linked", place.alias("place"), F.when(F.col("linked"), F.col("_depth") + 1).otherwise(F.lit(0)).cast("long").alias("depth"))
    out = texts.unionByName(of_calls).unionByName(of_results)
    return out.select("conv_id", "turn", "part", "role", "kind", "call_id", "linked", "valid", "errors", "place", "depth", "json")


#: The schema of the call that turns_as_calls makes.
REPLY: dict[str, Schema] = {"reply": {"type": "object", "required": ["text"], "properties": {"text": {"type": "string", "minLength": 1, "maxLength": 2000}}, "additionalProperties": False}}

ORACLE = r"""
WITH m AS (SELECT conv_id, turn, role, coalesce(text, '') AS text,
    CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'text' END AS kind,
    CASE role WHEN 'user' THEN turn WHEN 'assistant' THEN turn - 1 END AS call_no FROM conversations),
c AS (SELECT conv_id, turn FROM m WHERE kind = 'call'), r AS (SELECT conv_id, call_no FROM m WHERE kind = 'result')
SELECT conv_id, turn, role, kind, call_no::VARCHAR AS call_id,
    CASE kind WHEN 'call' THEN (conv_id, turn) IN (SELECT conv_id, call_no FROM r) WHEN 'result' THEN (conv_id, call_no) IN (SELECT conv_id, turn FROM c) ELSE false END AS linked,
    CASE kind WHEN 'call' THEN length(text) BETWEEN 1 AND 2000 END AS valid,
    turn AS place, CASE WHEN kind = 'result' AND (conv_id, call_no) IN (SELECT conv_id, turn FROM c) THEN 1 ELSE 0 END::BIGINT AS depth,
    CASE kind WHEN 'call' THEN '{"arguments":{"text":' || to_json(text) || '},"id":"' || call_no || '","name":"reply","role":' || to_json(role) || ',"type":"call"}'
        WHEN 'result' THEN '{"content":' || to_json(text) || ',"id":"' || call_no || '","role":' || to_json(role) || ',"type":"result"}'
        ELSE '{"content":' || to_json(text) || ',"role":' || to_json(role) || ',"type":"text"}' END AS json
FROM m
"""
